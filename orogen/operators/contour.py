"""Contours: levels, segments of triangles, stitching, and points for rebuilding a surface."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen import scratch
from orogen.errors import EmptySurface, InvalidArgument, LimitExceeded
from orogen.functions.geometry import num, world_x, world_y
from orogen.operators.grid import cells
from orogen.plans.components import components
from orogen.plans.tiles import grid_for
from orogen.schema import Grid, Mesh

MOST_LEVELS = 1_000_000
#: Segments of a tile, and about as many of a call that walks lines.
STITCHED = 1 << 14


def levels(zmin: float, zmax: float, interval: float | None = None, base: float = 0.0, explicit: list[float] | None = None) -> list[float]:
    """Sorted distinct levels: the given ones, or base + k * interval within the range."""
    if explicit is not None:
        return sorted(set(map(float, explicit)))
    if not interval or interval <= 0:
        raise InvalidArgument("the contour interval must be positive")
    first, last = -(-(zmin - base) // interval), (zmax - base) // interval
    if last - first >= MOST_LEVELS:
        raise LimitExceeded("too many contour levels")
    return [base + k * interval for k in range(int(first), int(last) + 1)]


def level_rows(low: Column, high: Column, interval: float, base: float) -> Column:
    """Levels between two heights as an array, so that no range join is needed."""
    first, last = F.ceil((low - num(base)) / num(interval)), F.floor((high - num(base)) / num(interval))
    ks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    return F.transform(ks, lambda k: num(base) + k.cast("double") * num(interval))


def segments(triangles: DataFrame, interval: float | None = None, base: float = 0.0, explicit: list[float] | None = None, tolerance: float = 1e-12) -> DataFrame:
    """The triangles' other columns with ``level`` and x1, y1, x2, y2 of each crossing.

    A corner is above a level only if it is strictly higher, so flats on a
    level give nothing. Crossings stand in the order of the edges ab, bc, ca.
    """
    own = [c for c in triangles.columns if c not in {f"{k}{d}" for k in "abc" for d in "xyz"}]
    low, high = F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz")
    if explicit is not None:
        many = F.filter(F.array(*[num(v) for v in levels(0, 0, explicit=explicit)]), lambda v: (v >= low) & (v <= high))
    else:
        many = level_rows(low, high, interval, base)
    df = triangles.withColumn("level", F.explode(many))

    def crossing(p: str, q: str) -> Column:
        t = F.try_divide(F.col("level") - F.col(f"{p}z"), F.col(f"{q}z") - F.col(f"{p}z"))
        at = lambda d: F.col(f"{p}{d}") + t * (F.col(f"{q}{d}") - F.col(f"{p}{d}"))
        differ = (F.col(f"{p}z") > F.col("level")) != (F.col(f"{q}z") > F.col("level"))
        return F.when(differ, F.struct(at("x").alias("x"), at("y").alias("y")))

    hits = F.filter(F.array(crossing("a", "b"), crossing("b", "c"), crossing("c", "a")), lambda h: h.isNotNull())
    df = df.withColumn("h", hits).where(F.size("h") == 2)
    first, second = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    long_enough = (first["x"] - second["x"]) * (first["x"] - second["x"]) + (first["y"] - second["y"]) * (first["y"] - second["y"]) > tolerance * tolerance
    return df.where(long_enough).select(*own, "level", first["x"].alias("x1"), first["y"].alias("y1"), second["x"].alias("x2"), second["y"].alias("y2"))


def grid_triangles(grid: Grid) -> DataFrame:
    """(row, col, tri) and corners of the two triangles of every complete cell."""
    m = grid.meta
    around = cells(grid.df, "z").where(" and ".join(f"z{k} is not null" for k in ("00", "10", "01", "11")))
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    node = {k: (world_x(m, c + dc, r + dr), world_y(m, c + dc, r + dr), F.col(f"z{k}")) for k, dc, dr in (("00", 0.0, 0.0), ("10", 1.0, 0.0), ("01", 0.0, 1.0), ("11", 1.0, 1.0))}
    one = lambda t, ks: F.struct(F.lit(t).alias("tri"), *(node[k][i].alias(n + d) for n, k in zip("abc", ks, strict=True) for i, d in enumerate("xyz")))
    return around.select("row", "col", F.explode(F.array(one(0, ("00", "10", "11")), one(1, ("00", "11", "01")))).alias("t")).select("row", "col", "t.*")


def from_grid(grid: Grid, interval: float | None = None, base: float = 0.0, explicit: list[float] | None = None) -> DataFrame:
    return segments(grid_triangles(grid), interval, base, explicit)


def from_mesh(mesh: Mesh, interval: float | None = None, base: float = 0.0, explicit: list[float] | None = None) -> DataFrame:
    return segments(mesh.triangles, interval, base, explicit)


def stitch(parts: DataFrame, tolerance: float) -> DataFrame:
    """Polylines of the segments (level, x1, y1, x2, y2): (level, line, closed, pts).

    Ends snap to a lattice. Chains start at nodes that don't join two segments,
    the smallest first; the rest are loops and repeat their first point.
    Segments that hang together meet in one call; a level's others don't.
    """
    key = lambda v: F.floor(F.col(v) / num(tolerance) + 0.5)
    keyed = scratch.stored(parts.select("level", "x1", "y1", "x2", "y2", *(key(v).alias(f"k{v}") for v in ("x1", "y1", "x2", "y2"))), "segments")
    n, x0, y0, x1, y1 = keyed.agg(F.count(F.lit(1)), F.min("x1"), F.min("y1"), F.max("x1"), F.max("y1")).first()
    tiles = grid_for(n, x0 or 0.0, y0 or 0.0, x1 or 0.0, y1 or 0.0, per_tile=STITCHED)
    links = keyed.withColumns({"u": F.xxhash64("level", "kx1", "ky1"), "v": F.xxhash64("level", "kx2", "ky2"), "tc": tiles.column(F.col("x1")), "tr": tiles.row(F.col("y1"))})
    dealt = components(links, "u", "v", ["level", "tc", "tr"]).withColumn("g", F.pmod(F.xxhash64("component"), F.lit(max(1, math.ceil(n / STITCHED)))))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kx1", "ky1", "kx2", "ky2", "x1", "y1"], kind="stable")
        at: dict[tuple, list[int]] = {}
        ends, place = [], {}
        for i, r in enumerate(pdf.itertuples()):
            a, b = (r.kx1, r.ky1), (r.kx2, r.ky2)
            ends.append((a, b))
            place.setdefault(a, (r.x1, r.y1))
            place.setdefault(b, (r.x2, r.y2))
            at.setdefault(a, []).append(i)
            at.setdefault(b, []).append(i)
        used = [False] * len(ends)
        lines = []

        def follow(node: tuple) -> list[tuple]:
            path = [node]
            while True:
                nxt = next((i for i in at[node] if not used[i]), None)
                if nxt is None or (len(path) > 1 and len(at[node]) != 2):
                    return path
                used[nxt] = True
                a, b = ends[nxt]
                node = b if a == node else a
                path.append(node)
                if node == path[0]:
                    return path

        for start in sorted(n for n in at if len(at[n]) != 2) + sorted(at):
            while any(not used[i] for i in at[start]):
                lines.append(follow(start))
        level = pdf["level"].iloc[0]
        return pd.DataFrame({
            "level": level, "loop": [len(at[p[0]]) == 2 for p in lines], "kx": [p[0][0] for p in lines], "ky": [p[0][1] for p in lines], "turn": range(len(lines)),
            "closed": [len(p) > 2 and p[0] == p[-1] for p in lines], "pts": [[{"x": float(place[n][0]), "y": float(place[n][1]), "z": float(level)} for n in p] for p in lines]})

    lines = scratch.stored(dealt.groupBy("level", "g").applyInPandas(walk, "level double, loop boolean, kx long, ky long, turn long, closed boolean, pts array<struct<x: double, y: double, z: double>>"), "lines")
    place = ["level", "loop", "kx", "ky", "turn"]
    # Lines are numbered without their points.
    numbers = lines.select(*place, (F.row_number().over(Window.partitionBy("level").orderBy(*place)) - 1).cast("long").alias("line"))
    return lines.join(numbers, place).select("level", "line", "closed", "pts")


def line_statistics(lines: DataFrame) -> DataFrame:
    """Per polyline its number of points and length."""
    step = lambda i: F.sqrt((F.col("pts")[i + 1]["x"] - F.col("pts")[i]["x"]) * (F.col("pts")[i + 1]["x"] - F.col("pts")[i]["x"]) + (F.col("pts")[i + 1]["y"] - F.col("pts")[i]["y"]) * (F.col("pts")[i + 1]["y"] - F.col("pts")[i]["y"]))
    steps = F.transform(F.sequence(F.lit(0), F.size("pts") - 2), step)
    return lines.select("level", "line", "closed", F.size("pts").cast("long").alias("points"), F.aggregate(steps, num(0), lambda s, x: s + x).alias("length"))


def summary(lines: DataFrame) -> DataFrame:
    """One row: lines, vertices, range of levels and XY bounds."""
    p = lines.select("level", "line", F.explode("pts").alias("p"))
    return p.agg(F.countDistinct("level", "line").alias("line_count"), F.count(F.lit(1)).alias("vertex_count"), F.min("level").alias("minimum_level"), F.max("level").alias("maximum_level"), F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))


def densified(lines: DataFrame, longest: float | None = None) -> DataFrame:
    """(line_id, seq, part, x, y, z): vertices of lines (line_id, elevation, closed, pts), long segments divided; z is the line's elevation."""
    n = F.size("pts")
    count = F.when(F.col("closed") & ((F.col("pts")[n - 1]["x"] != F.col("pts")[0]["x"]) | (F.col("pts")[n - 1]["y"] != F.col("pts")[0]["y"])), n).otherwise(n - 1)
    seg = lines.withColumn("seq", F.explode(F.sequence(F.lit(0), count - 1)))
    p, q = F.col("pts")[F.col("seq")], F.col("pts")[(F.col("seq") + 1) % n]
    seg = seg.select("line_id", "elevation", "seq", (F.col("seq") == count - 1).alias("last"), p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy"))
    length = F.sqrt((F.col("qx") - F.col("px")) * (F.col("qx") - F.col("px")) + (F.col("qy") - F.col("py")) * (F.col("qy") - F.col("py")))
    parts = F.greatest(F.lit(1), F.ceil(length / num(longest)).cast("int")) if longest else F.lit(1)
    seg = seg.withColumn("n", parts)
    stop = F.when(F.col("last"), F.col("n")).otherwise(F.col("n") - 1)
    seg = seg.withColumn("part", F.explode(F.sequence(F.lit(0), stop)))
    t = F.col("part") / F.col("n")
    return seg.select("line_id", "seq", "part", (F.col("px") + t * (F.col("qx") - F.col("px"))).alias("x"), (F.col("py") + t * (F.col("qy") - F.col("py"))).alias("y"), F.col("elevation").alias("z"))


def surface_points(lines: DataFrame, longest: float | None = None, *, meeting: str = "refuse") -> DataFrame:
    """(id, x, y, z) of contour vertices, equal places merged.

    Where contours of different heights meet, ``meeting`` decides: ``refuse``
    raises, ``keep`` gives a point for each height, ``middle`` one point halfway
    between the lowest and the highest.
    """
    if meeting not in ("refuse", "keep", "middle"):
        raise InvalidArgument("meeting contours are refused, kept or put in the middle")
    p = densified(lines, longest)
    place = ["x", "y", "z"] if meeting == "keep" else ["x", "y"]
    merged = p.groupBy(*place).agg(F.min("z").alias("low"), F.max("z").alias("top"), F.min(F.struct("line_id", "seq", "part")).alias("first"))
    clash = F.abs(F.col("top") - F.col("low")) > 1e-10 * F.greatest(num(1), F.abs("low"), F.abs("top"))
    if meeting == "refuse" and merged.where(clash).limit(1).count():
        raise InvalidArgument("contours of different heights meet")
    z = F.when(clash, F.col("low") + (F.col("top") - F.col("low")) / 2).otherwise(F.col("low"))
    key = F.struct("first.line_id", "first.seq", "first.part")
    out = merged.select(F.xxhash64(key).alias("id"), "x", "y", z.alias("z"))
    if not out.limit(3).count() >= 3:
        raise EmptySurface("too few contour points")
    return out
