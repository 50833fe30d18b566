"""The driver's tables as terrain objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.schema import Grid, GridMeta

GT = (500000.0, 10.0, 0.0, 3200000.0, 0.0, -10.0)
SHEARED = (100.0, 2.0, 0.5, 200.0, -0.25, 1.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(df: DataFrame, key: str, width: int, z, gt) -> Grid:
    last = df.agg(F.max(key)).first()[0]
    rows = df.select(F.expr(f"{key} div {width}").alias("row"), (F.col(key) % width).alias("col"), z.alias("z"))
    return Grid(rows, GridMeta(width, last // width + 1, gt))


def orders(spark: SparkSession, sf_dir: str, gt: tuple = GT) -> Grid:
    return _grid(table(spark, sf_dir, "orders"), "o_orderkey", 150, F.col("o_totalprice").cast("double"), gt)


def design(spark: SparkSession, sf_dir: str, gt: tuple = GT) -> Grid:
    return _grid(table(spark, sf_dir, "orders"), "o_orderkey", 150, (F.col("o_custkey") % 500).cast("double") * 1000.0, gt)


def orders_nd(spark: SparkSession, sf_dir: str, gt: tuple = GT) -> Grid:
    gap = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 7 == 0)
    return _grid(table(spark, sf_dir, "orders"), "o_orderkey", 150, F.when(~gap, F.col("o_totalprice").cast("double")), gt)


def parts(spark: SparkSession, sf_dir: str, gt: tuple = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)) -> Grid:
    return _grid(table(spark, sf_dir, "part"), "p_partkey", 50, F.col("p_size").cast("double"), gt)


def lattice(df: DataFrame, key: str, z: str) -> DataFrame:
    """(id, x, y, z) on the lattice that puts nearly every key at a place of its own; of 90,000 keys two share one."""
    k = F.col(key).cast("long")
    x = (k * k * 7 + k * 15485863) % 100003
    y = (k * k * k + k * 32452843) % 100019
    return df.select((k + 1).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.col(z).cast("double").alias("z"))


def places(points: DataFrame) -> DataFrame:
    """One point for each place, that with the smallest id: meshes refuse two."""
    return points.groupBy("x", "y").agg(F.min(F.struct("id", "z")).alias("p")).select("p.id", "x", "y", "p.z")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


def constraints(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Breaklines between the lattice places of suppliers twenty apart, twenty of them; ``whole``: between all suppliers, by pairs."""
    p = suppliers(spark, sf_dir)
    if whole:
        cid, seq = F.expr("(id - 1) div 2 + 1"), (F.col("id") - 1) % 2
        return p.select(cid.alias("cid"), F.lit(1).alias("kind"), F.lit(False).alias("closed"), seq.alias("seq"), "x", "y", F.lit(0.0).alias("z"))
    p = p.where("id <= 40")
    a = p.where("id <= 20").select(F.col("id").alias("cid"), F.lit(0).cast("long").alias("seq"), "x", "y", F.lit(0.0).alias("z"))
    b = p.where("id > 20").select((F.col("id") - 20).alias("cid"), F.lit(1).cast("long").alias("seq"), "x", "y", F.lit(0.0).alias("z"))
    return a.unionByName(b).select("cid", F.lit(1).alias("kind"), F.lit(False).alias("closed"), "seq", "x", "y", "z")


def rings(spark: SparkSession) -> DataFrame:
    """An outer boundary and a hole in the lattice's square."""
    rows = []
    for cid, kind, ring in ((1, 2, [(10000, 12000), (90000, 15000), (85000, 88000), (20000, 80000)]), (2, 3, [(40000, 40000), (60000, 42000), (55000, 61000)])):
        rows += [(cid, kind, True, i, float(x), float(y), 0.0) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "cid long, kind int, closed boolean, seq long, x double, y double, z double")


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, op, id, x, y, z): events as edits of places; every tenth removes."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id").cast("long")
    op = F.when(F.col("event_id") % 10 == 0, "remove").when(F.col("event_id") % 3 == 0, "add").otherwise("update")
    return e.select(F.col("event_id").cast("long").alias("order"), op.alias("op"), k.alias("id"), ((k * k * 7 + k * 15485863) % 100003).cast("double").alias("x"), ((k * k * k + k * 32452843) % 100019).cast("double").alias("y"), F.col("value").cast("double").alias("z"))
