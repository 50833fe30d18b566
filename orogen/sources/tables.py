"""Grids, meshes and constraints as partitioned Parquet, in place of binary files.

Parquet's statistics give what directories and block tables give a binary file:
a window reads the blocks that it touches and the columns that it needs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument
from orogen.operators.grid import halved
from orogen.operators.view import block_sums, broken_blocks
from orogen.schema import Grid, GridMeta

BLOCK_ROWS = 64


def save_grid(grid: Grid, path: str, *, levels: int = 0) -> None:
    """Heights in blocks of rows, checksums, metadata and pyramid levels."""
    spark = grid.df.sparkSession
    blocks = grid.df.withColumn("block", F.expr(f"row div {BLOCK_ROWS}"))
    blocks.repartitionByRange("block").sortWithinPartitions("row", "col").write.parquet(f"{path}/values")
    block_sums(grid, BLOCK_ROWS).write.parquet(f"{path}/sums")
    m = grid.meta
    spark.createDataFrame([(json.dumps({"width": m.width, "height": m.height, "gt": m.gt, "crs": m.crs, "generation": m.generation}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    for k in range(1, levels + 1):
        grid = halved(grid)
        grid.df.write.parquet(f"{path}/level={k}")


def load_grid(spark: SparkSession, path: str) -> Grid:
    """Lazily: only metadata are read."""
    d = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Grid(spark.read.parquet(f"{path}/values").select("row", "col", "z"), GridMeta(d["width"], d["height"], tuple(d["gt"]), d["crs"], d["generation"]))


def load_window(spark: SparkSession, path: str, col: int, row: int, width: int, height: int) -> DataFrame:
    """A window's nodes; blocks that it doesn't touch are skipped by their statistics."""
    v = spark.read.parquet(f"{path}/values")
    v = v.where(F.col("block").between(row // BLOCK_ROWS, (row + height - 1) // BLOCK_ROWS))
    return v.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)).select("row", "col", "z")


def verify_grid(spark: SparkSession, path: str) -> DataFrame:
    """Blocks whose heights don't have the stored checksum; none in a sound table."""
    return broken_blocks(load_grid(spark, path), spark.read.parquet(f"{path}/sums"), BLOCK_ROWS)


def save_mesh(vertices: DataFrame, path: str) -> None:
    vertices.select("id", "x", "y", "z").write.parquet(path)


def load_mesh_points(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if set(df.columns) != {"id", "x", "y", "z"}:
        raise InvalidArgument("not a table of vertices")
    return df


def save_constraints(constraints: DataFrame, path: str) -> None:
    """Vertices with their constraint's box, clustered by id, so that windows and ids prune."""
    box = constraints.groupBy("cid").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    constraints.join(box, "cid").repartitionByRange("cid").sortWithinPartitions("cid", "seq").write.parquet(path)
    _payload_sums(constraints).write.parquet(f"{path}.sums")


def _payload_sums(constraints: DataFrame) -> DataFrame:
    """Per constraint the number of its vertices and a checksum of all that they hold, whatever their order in files."""
    one = F.pmod(F.xxhash64("cid", "kind", "closed", "seq", "x", "y", "z"), F.lit(1 << 31))
    return constraints.groupBy("cid").agg(F.count(F.lit(1)).alias("points"), F.sum(one).alias("checksum"))


def verify_constraints(spark: SparkSession, path: str) -> DataFrame:
    """Ids of constraints that aren't as they were saved: changed, lost or added; none in a sound table."""
    now = _payload_sums(spark.read.parquet(path)).select("cid", F.struct("points", "checksum").alias("now"))
    then = spark.read.parquet(f"{path}.sums").select("cid", F.struct("points", "checksum").alias("then"))
    return now.join(then, "cid", "full").where(~F.col("now").eqNullSafe(F.col("then"))).select("cid")


def load_constraints(spark: SparkSession, path: str) -> DataFrame:
    """All constraints, after their checksums have been verified."""
    if verify_constraints(spark, path).limit(1).count():
        raise InvalidArgument("a constraint's checksum is wrong")
    return spark.read.parquet(path).select("cid", "kind", "closed", "seq", "x", "y", "z")


def query_constraints(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Ids and kinds of constraints whose closed boxes meet the rectangle."""
    t = spark.read.parquet(path)
    return t.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax)).groupBy("cid", "kind").agg(F.count(F.lit(1)).alias("points"))


def read_constraint(spark: SparkSession, path: str, cid: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("cid") == cid).select("cid", "kind", "closed", "seq", "x", "y", "z")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
