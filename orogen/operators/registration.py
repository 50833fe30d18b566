"""Shifts between surfaces: Halton samples, candidate search, adaptive error."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument, NotFound
from orogen.functions.geometry import num
from orogen.operators.grid import nodes, sample
from orogen.functions.geometry import world_x, world_y
from orogen.schema import Grid, same_crs


def radical_inverse(index: Column, base: int, digits: int = 40) -> Column:
    """Halton's radical inverse of a whole number, as the sum of its digits' parts from the largest."""
    start = F.struct(index.cast("long").alias("i"), num(1).alias("f"), num(0).alias("v"))

    def step(acc: Column, _: Column) -> Column:
        f = acc["f"] / num(base)
        more = acc["i"] > 0
        return F.struct(F.floor(acc["i"] / base).alias("i"), F.when(more, f).otherwise(acc["f"]).alias("f"), F.when(more, acc["v"] + f * (acc["i"] % base).cast("double")).otherwise(acc["v"]).alias("v"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda acc: acc["v"])


def halton(spark: SparkSession, count: int) -> DataFrame:
    """(idx, h2, h3) of the first points, from 1."""
    df = spark.range(1, count + 1).select(F.col("id").alias("idx"))
    digits = max(1, count.bit_length())
    return df.select("idx", radical_inverse(F.col("idx"), 2, digits).alias("h2"), radical_inverse(F.col("idx"), 3, digits).alias("h3"))


def samples(grid: Grid, count: int) -> DataFrame:
    """(idx, x, y, z) at Halton points of the bounds; null outside or beside a missing node."""
    xmin, ymin, xmax, ymax = grid.meta.bounds()
    p = halton(grid.df.sparkSession, count).select("idx", (num(xmin) + F.col("h2") * num(xmax - xmin)).alias("x"), (num(ymin) + F.col("h3") * num(ymax - ymin)).alias("y"))
    return sample(grid, p).select("idx", "x", "y", "z")


def scores(points: DataFrame, moving: Grid, shifts: list[tuple[float, float]], *, estimate_z: bool) -> DataFrame:
    """(dx, dy, n, dz, rmse) of candidate shifts, all in one aggregation."""
    cand = F.array(*[F.struct(num(dx).alias("dx"), num(dy).alias("dy")) for dx, dy in shifts])
    asked = points.where("z is not null").select("idx", "x", "y", F.col("z").alias("zr"), F.explode(cand).alias("c")).select("idx", "zr", F.col("c.dx").alias("dx"), F.col("c.dy").alias("dy"), (F.col("x") - F.col("c.dx")).alias("x"), (F.col("y") - F.col("c.dy")).alias("y"))
    d = sample(moving, asked).where("z is not null").select("dx", "dy", (F.col("zr") - F.col("z")).alias("d"))
    s = d.groupBy("dx", "dy").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.avg(F.col("d") * F.col("d")).alias("square"))
    dz = F.col("mean") if estimate_z else num(0)
    left = F.col("square") - F.col("mean") * F.col("mean") if estimate_z else F.col("square")
    return s.select("dx", "dy", "n", dz.alias("dz"), F.sqrt(F.greatest(num(0), left)).alias("rmse"))


@dataclass(frozen=True)
class Registration:
    dx: float
    dy: float
    dz: float
    rmse_before: float | None
    rmse_after: float
    overlap: float
    valid: int
    candidates: int
    iterations: int


def register(reference: Grid, moving: Grid, *, most: float | None = None, least: float | None = None, budget: int = 4096, minimum: int = 64, estimate_z: bool = True) -> Registration:
    """The shift of ``moving`` that fits ``reference`` best: a coarse grid of shifts, then ever finer ones around the best.

    Samples are taken once; each level of the search is one aggregation over
    samples and candidates. Equal errors give the shorter shift.
    """
    same_crs(reference.meta.crs, moving.meta.crs)
    pixel = math.sqrt(abs(reference.meta.det))
    most, least = most or 5 * pixel, least or pixel / 32
    if not 0 < least <= most:
        raise InvalidArgument("the search scales are wrong")
    points = samples(reference, budget).where("z is not null").persist()
    total = points.count()
    if total < minimum:
        raise NotFound("too few samples of the reference")
    before = scores(points, moving, [(0.0, 0.0)], estimate_z=False).first()
    step = most / 2
    tried = [(x * step, y * step) for y in range(-2, 3) for x in range(-2, 3)]
    best, candidates, turns = None, 0, 0
    while True:
        rows = scores(points, moving, tried, estimate_z=estimate_z).where(F.col("n") >= minimum).collect()  # at most 25 rows
        candidates, turns = candidates + len(tried), turns + 1
        for r in sorted(rows, key=lambda r: (r["dy"], r["dx"])):
            slack = 1e-14 * max(1.0, r["rmse"], best["rmse"] if best else 0)
            if best is None or r["rmse"] < best["rmse"] - slack or (abs(r["rmse"] - best["rmse"]) <= slack and math.hypot(r["dx"], r["dy"]) < math.hypot(best["dx"], best["dy"])):
                best = r
        if best is None:
            raise NotFound("the surfaces overlap too little")
        step /= 2
        if step < least:
            break
        hold = lambda v: min(max(v, -most), most)
        tried = list(dict.fromkeys((hold(best["dx"] + x * step), hold(best["dy"] + y * step)) for y in (-1, 0, 1) for x in (-1, 0, 1) if x or y))
    return Registration(best["dx"], best["dy"], best["dz"], before["rmse"] if before and before["n"] >= minimum else None, best["rmse"], best["n"] / total, best["n"], candidates, turns)


def apply(moving: Grid, reference: Grid, dx: float, dy: float, dz: float) -> Grid:
    """``moving`` shifted by (dx, dy, dz), on the reference's nodes."""
    same_crs(reference.meta.crs, moving.meta.crs)
    m = reference.meta
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    at = nodes(reference.df.sparkSession, m).select("row", "col", (world_x(m, c, r) - num(dx)).alias("x"), (world_y(m, c, r) - num(dy)).alias("y"))
    return Grid(sample(moving, at).select("row", "col", (F.col("z") + num(dz)).alias("z")), m)


def error(reference: Grid, moving: Grid, *, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0, minimum: int = 1024, budget: int = 65_536, target: float | None = None) -> DataFrame:
    """One row of error statistics at Halton points; stops at the first multiple of 256 valid samples whose standard error is low enough."""
    same_crs(reference.meta.crs, moving.meta.crs)
    ref = samples(reference, budget).select("idx", (F.col("x") - num(dx)).alias("x"), (F.col("y") - num(dy)).alias("y"), F.col("z").alias("zr"))
    both = sample(moving, ref).select("idx", (F.col("zr") - (F.col("z") + num(dz))).alias("e")).where("e is not null")
    # The sample budget bounds this window.
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s2 = F.col("e") * F.col("e")
    both = both.withColumn("n", F.row_number().over(w)).withColumn("s2", F.sum(s2).over(run)).withColumn("s4", F.sum(s2 * s2).over(run))
    mean2 = F.col("s2") / F.col("n")
    var = F.greatest(num(0), F.col("s4") / F.col("n") - mean2 * mean2)
    se = F.when(mean2 == 0, num(0)).otherwise(F.sqrt(var / F.col("n")) / (2.0 * F.sqrt(F.nullif(mean2, num(0)))))
    both = both.withColumn("se", se)
    stop = F.min(F.when((F.col("n") >= minimum) & (F.col("n") % 256 == 0) & (F.col("se") <= num(target if target is not None else -1.0)), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    both = both.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("n") <= F.col("stop")))
    out = both.agg(
        F.count(F.lit(1)).alias("valid_count"), F.max("stop").isNotNull().alias("converged"), F.min("e").alias("minimum_error"), F.max("e").alias("maximum_error"), F.avg("e").alias("mean_error"), F.avg(F.abs("e")).alias("mean_absolute_error"),
        F.sqrt(F.avg(s2)).alias("rmse"), F.max(F.abs("e")).alias("maximum_absolute_error"), F.max_by("se", "n").alias("rmse_standard_error"), F.coalesce(F.max("stop"), F.lit(0)).alias("stop"), F.max("idx").alias("last"))
    attempted = F.when(F.col("converged"), F.col("last")).otherwise(F.lit(budget)).cast("long")
    return out.withColumn("attempted_count", attempted).withColumn("overlap_ratio", F.col("valid_count") / F.col("attempted_count")).drop("stop", "last")
