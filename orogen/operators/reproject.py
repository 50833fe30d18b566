"""Meshes and grids in another coordinate system."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument
from orogen.functions import crs
from orogen.functions.geometry import node_col, node_row, world_x, world_y
from orogen.operators import mesh as tin
from orogen.operators.grid import nodes, sample, sample_kernel
from orogen.schema import Grid, GridMeta, Mesh


def mesh(m: Mesh, target: str) -> Mesh:
    """Vertices transformed and triangulated anew."""
    return tin.build(crs.transform_points(m.vertices, m.crs, target), crs.normalize(target))


def suggested(spark: SparkSession, meta: GridMeta, target: str, steps: int = 20) -> GridMeta:
    """A north-up geometry in another system that holds the grid's outline, with square cells and as many on its diagonal.

    The outline lies half a step beyond the outermost nodes; ``steps`` points
    of each side and the corners are transformed.
    """
    ends = lambda n: [-0.5 + n * k / steps for k in range(steps + 1)]
    ring = {(c, r) for c in ends(meta.width) for r in (-0.5, meta.height - 0.5)} | {(c, r) for c in (-0.5, meta.width - 0.5) for r in ends(meta.height)}
    x, y = crs.transformed(meta.crs, target, F.col("x"), F.col("y"))
    outline = spark.createDataFrame([meta.world(c, r) for c, r in sorted(ring)], "x double, y double").select(x.alias("x"), y.alias("y"))
    xmin, ymin, xmax, ymax = outline.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not all(v is not None and math.isfinite(v) for v in (xmin, ymin, xmax, ymax)):
        raise InvalidArgument("the grid's outline can't be transformed")
    size = math.hypot(xmax - xmin, ymax - ymin) / math.hypot(meta.width, meta.height)
    width, height = (max(1, int(d / size + 0.5)) for d in (xmax - xmin, ymax - ymin))
    return GridMeta(width, height, (xmin + size / 2, size, 0.0, ymax - size / 2, 0.0, -size), crs.normalize(target))


def grid(g: Grid, target: GridMeta, method: str = "bilinear") -> Grid:
    """The grid's heights at the nodes of a geometry in another system: nodes go back and are sampled.

    ``method``: ``nearest``, ``bilinear``, ``cubic``, ``cubicspline`` or ``lanczos``.
    """
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    x, y = crs.transformed(target.crs, g.meta.crs, world_x(target, c, r), world_y(target, c, r))
    at = nodes(g.df.sparkSession, target).select("row", "col", x.alias("x"), y.alias("y"))
    if method == "bilinear":
        return Grid(sample(g, at).select("row", "col", "z"), target)
    if method != "nearest":
        return Grid(sample_kernel(g, at, method).select("row", "col", "z"), target)
    near = at.withColumn("sr", F.floor(node_row(g.meta, F.col("x"), F.col("y")) + 0.5)).withColumn("sc", F.floor(node_col(g.meta, F.col("x"), F.col("y")) + 0.5))
    src = g.df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z")
    return Grid(near.join(src, ["sr", "sc"], "left").select("row", "col", "z"), target)
