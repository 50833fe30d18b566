"""Cut and fill between two aligned grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument
from orogen.functions.geometry import num
from orogen.operators.grid import cells
from orogen.schema import Grid, same_crs


def aligned(a: Grid, b: Grid) -> None:
    """Refuses grids whose nodes don't coincide."""
    scale = max(1.0, *map(abs, a.meta.gt), *map(abs, b.meta.gt))
    if (a.meta.width, a.meta.height) != (b.meta.width, b.meta.height) or any(abs(p - q) > 1e-12 * scale for p, q in zip(a.meta.gt, b.meta.gt, strict=True)):
        raise InvalidArgument("the grids are not aligned")
    same_crs(a.meta.crs, b.meta.crs)


def difference(existing: Grid, design: Grid, existing_factor: float = 1.0, design_factor: float = 1.0) -> Grid:
    """Node by node: existing less design, null where either is. One equi-join."""
    aligned(existing, design)
    other = design.df.select("row", "col", F.col("z").alias("d"))
    df = existing.df.join(other, ["row", "col"]).select("row", "col", (num(existing_factor) * F.col("z") - num(design_factor) * F.col("d")).alias("z"))
    return Grid(df, existing.meta.edited())


def _volumes(area: Column, d: tuple[Column, Column, Column]) -> tuple[Column, Column, Column, Column]:
    """net, squared integral, cut and fill of a triangle whose corners differ by d."""
    a, b, c = d
    net = area * (a + b + c) / 3.0
    squared = area / 6.0 * (a * a + b * b + c * c + a * b + b * c + c * a)
    above = [(x > 0).cast("int") for x in d]
    below = [(x < 0).cast("int") for x in d]
    ups, downs = above[0] + above[1] + above[2], below[0] + below[1] + below[2]

    def tip(p: Column, q: Column, r: Column) -> Column:
        # Only read where p has one sign and q, r the other or none, so no divisor is zero there.
        return area * F.try_divide(p, p - q) * F.try_divide(p, p - r) * p / 3.0

    peak = F.when(a > 0, tip(a, b, c)).when(b > 0, tip(b, a, c)).otherwise(tip(c, a, b))
    pit = -F.when(a < 0, tip(a, b, c)).when(b < 0, tip(b, a, c)).otherwise(tip(c, a, b))
    zero = num(0)
    cut = F.when(downs == 0, F.greatest(zero, net)).when(ups == 0, zero).when(ups == 1, peak).otherwise(F.greatest(zero, net + pit))
    fill = F.when(downs == 0, zero).when(ups == 0, F.greatest(zero, -net)).when(ups == 1, F.greatest(zero, peak - net)).otherwise(pit)
    return net, squared, cut, fill


def triangles(existing: Grid, design: Grid, existing_factor: float = 1.0, design_factor: float = 1.0, *, partial: bool = False) -> DataFrame:
    """Per cell two triangles (tri 0 and 1) with net, squared, cut, fill and their range; nulls where skipped.

    Without ``partial`` a cell with a missing corner is skipped whole.
    """
    diff = difference(existing, design, existing_factor, design_factor)
    area = num(abs(existing.meta.det) * 0.5)
    around = cells(diff.df, "z")
    if not partial:
        whole = F.col("z00").isNotNull() & F.col("z10").isNotNull() & F.col("z01").isNotNull() & F.col("z11").isNotNull()
        around = around.withColumn("z00", F.when(whole, F.col("z00"))).withColumn("z11", F.when(whole, F.col("z11")))
    corner = lambda a, b, c, t: F.struct(F.lit(t).alias("tri"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    split = around.select("row", "col", F.explode(F.array(corner("z00", "z10", "z11", 0), corner("z00", "z11", "z01", 1))).alias("t")).select("row", "col", "t.*")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    net, squared, cut, fill = _volumes(area, (F.col("a"), F.col("b"), F.col("c")))
    low, high = F.least("a", "b", "c"), F.greatest("a", "b", "c")
    return split.select("row", "col", "tri", *(F.when(ok, e).alias(n) for e, n in ((net, "net"), (F.greatest(num(0), squared), "squared"), (cut, "cut"), (fill, "fill"), (low, "low"), (high, "high"))))


def summary(existing: Grid, design: Grid, existing_factor: float = 1.0, design_factor: float = 1.0, *, partial: bool = False) -> DataFrame:
    """One row of counts, areas, volumes and difference statistics."""
    m = existing.meta
    area = abs(m.det) * 0.5
    cells_ = (m.width - 1) * (m.height - 1)
    t = triangles(existing, design, existing_factor, design_factor, partial=partial)
    s = t.agg(F.count("net").alias("valid_triangle_count"), F.sum("cut").alias("cut"), F.sum("fill").alias("fill"), F.sum("net").alias("net"), F.sum("squared").alias("squared"), F.min("low").alias("minimum_difference"), F.max("high").alias("maximum_difference"))
    valid = num(area) * F.col("valid_triangle_count")
    total = math.fabs(m.det) * cells_
    return s.select(
        F.lit(cells_).cast("long").alias("cell_count"), "valid_triangle_count", (F.lit(2 * cells_) - F.col("valid_triangle_count")).cast("long").alias("skipped_triangle_count"),
        num(total).alias("total_plan_area"), valid.alias("valid_plan_area"), F.coalesce(F.try_divide(valid, num(total)), num(0)).alias("coverage_ratio"),
        F.coalesce("cut", num(0)).alias("cut_volume"), F.coalesce("fill", num(0)).alias("fill_volume"), F.coalesce("net", num(0)).alias("net_volume"),
        "minimum_difference", "maximum_difference", F.try_divide("net", valid).alias("mean_difference"), F.sqrt(F.try_divide("squared", valid)).alias("rmse_difference"))
