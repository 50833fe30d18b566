"""Profiles, polygons and volumes over a datum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument
from orogen.functions.geometry import num
from orogen.operators.grid import sample
from orogen.schema import Grid

Ring = list[tuple[float, float]]


def profile_points(spark: SparkSession, start: tuple[float, float], end: tuple[float, float], count: int = 401) -> DataFrame:
    """(idx, distance, x, y) of equally spaced points of a line."""
    if count < 2 or not all(map(math.isfinite, (*start, *end))):
        raise InvalidArgument("a profile needs two finite ends and two points")
    t = F.col("idx").cast("double") / num(count - 1)
    length = math.sqrt((end[0] - start[0]) ** 2 + (end[1] - start[1]) ** 2)
    return spark.range(count).select(F.col("id").cast("int").alias("idx")).select("idx", (num(length) * t).alias("distance"), (num(start[0]) + num(end[0] - start[0]) * t).alias("x"), (num(start[1]) + num(end[1] - start[1]) * t).alias("y"))


def profile(grid: Grid, start: tuple[float, float], end: tuple[float, float], count: int = 401) -> DataFrame:
    """Profile points with ``z``, ``valid`` and ``grade_percent`` from the point before."""
    points = profile_points(grid.df.sparkSession, start, end, count)
    df = sample(grid, points).select("idx", "distance", "x", "y", "z", F.col("z").isNotNull().alias("valid"))
    return with_grade(df)


def with_grade(df: DataFrame) -> DataFrame:
    # One line's points: their number is a parameter, so one window is small.
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    step = F.col("distance") - F.lag("distance").over(w)
    return df.withColumn("grade_percent", F.when(step > 0, (F.col("z") - F.lag("z").over(w)) / step * 100.0))


def profile_statistics(samples: DataFrame) -> DataFrame:
    """One row of a profile's heights, ascent, descent and steepest grade; gaps break the chain."""
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    d = samples.withColumn("dz", F.col("z") - F.lag("z").over(w)).withColumn("step", F.col("distance") - F.lag("distance").over(w))
    on = F.col("dz").isNotNull() & (F.col("step") > 0)
    zero = num(0)
    out = d.agg(
        F.count(F.lit(1)).alias("sample_count"), F.count("z").alias("valid_count"), (F.max("distance") - F.min("distance")).alias("horizontal_distance"),
        F.min_by("z", "idx").alias("start_z"), F.max_by("z", "idx").alias("end_z"), F.min("z").alias("minimum_z"), F.max("z").alias("maximum_z"),
        F.coalesce(F.sum(F.when(on & (F.col("dz") >= 0), F.col("dz"))), zero).alias("ascent"), F.coalesce(F.sum(F.when(on & (F.col("dz") < 0), -F.col("dz"))), zero).alias("descent"),
        F.coalesce(F.sum(F.when(on, F.col("step"))), zero).alias("sampled_distance"), F.coalesce(F.max(F.when(on, F.abs(F.col("dz") / F.col("step")) * 100.0)), zero).alias("maximum_grade_percent"))
    return out.withColumn("elevation_difference", F.col("end_z") - F.col("start_z"))


def polygon_metrics(vertices: DataFrame) -> DataFrame:
    """Per polygon (poly, seq, x, y): area by the shoelace about its first vertex, and perimeter."""
    w = Window.partitionBy("poly").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    e = vertices.select("poly", "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny"), F.first("x").over(whole).alias("x0"), F.first("y").over(whole).alias("y0"))
    turn = (F.col("x") - F.col("x0")) * (F.col("ny") - F.col("y0")) - (F.col("nx") - F.col("x0")) * (F.col("y") - F.col("y0"))
    side = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    return e.groupBy("poly").agg((F.abs(F.sum(turn)) * 0.5).alias("area"), F.sum(side).alias("perimeter"))


def _cross(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _meet(a, b, c, d) -> bool:
    p, q, r, s = _cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b)
    if ((p > 0) != (q > 0) or p == 0 or q == 0) and ((r > 0) != (s > 0) or r == 0 or s == 0):
        within = lambda u, v, w: min(u[0], v[0]) <= w[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= w[1] <= max(u[1], v[1])
        if p and q and r and s:
            return True
        return any((t == 0 and within(*k)) for t, k in ((p, (a, b, c)), (q, (a, b, d)), (r, (c, d, a)), (s, (c, d, b))))
    return False


def is_simple(ring: Ring) -> bool:
    """Whether a ring is finite, has an area, and no edges meet but neighbours at their ends."""
    n = len(ring)
    if n < 3 or not all(math.isfinite(v) for p in ring for v in p):
        return False
    x, y = zip(*ring, strict=True)
    size = max(max(x) - min(x), max(y) - min(y), 1e-300)
    if any(math.dist(ring[i], ring[(i + 1) % n]) <= 1e-12 * size for i in range(n)):
        return False
    if abs(sum(_cross(ring[0], ring[i], ring[(i + 1) % n]) for i in range(n))) <= 1e-12 * size * size:
        return False
    return not any(_meet(ring[i], ring[i + 1], ring[j], ring[(j + 1) % n]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i)


def crossings(edges: DataFrame) -> DataFrame:
    """Pairs (poly, i, j), i < j, of a polygon's edges (poly, seq, n, ax, ay, bx, by) that aren't neighbours and meet."""
    a = edges.select("poly", "n", F.col("seq").alias("i"), *(F.col(c).alias(f"p_{c}") for c in ("ax", "ay", "bx", "by")))
    b = edges.select("poly", F.col("seq").alias("j"), *(F.col(c).alias(f"q_{c}") for c in ("ax", "ay", "bx", "by")))
    o = lambda s, t: (F.col(f"{s}_bx") - F.col(f"{s}_ax")) * (F.col(t[1]) - F.col(f"{s}_ay")) - (F.col(f"{s}_by") - F.col(f"{s}_ay")) * (F.col(t[0]) - F.col(f"{s}_ax"))
    c1, c2, c3, c4 = o("p", ("q_ax", "q_ay")), o("p", ("q_bx", "q_by")), o("q", ("p_ax", "p_ay")), o("q", ("p_bx", "p_by"))
    apart = (F.col("i") + 1 < F.col("j")) & ((F.col("j") + 1) % F.col("n") != F.col("i"))
    return a.join(b, "poly").where(apart & (c1 * c2 < 0) & (c3 * c4 < 0)).select("poly", "i", "j")


def ears(ring: Ring) -> list[tuple[tuple[float, float], ...]]:
    """A simple polygon as n - 2 counter-clockwise triangles."""
    if not is_simple(ring):
        raise InvalidArgument("the polygon is not simple")
    left = list(ring) if sum(_cross(ring[0], ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))) > 0 else ring[::-1]
    out = []
    while len(left) > 3:
        for i in range(len(left)):
            a, b, c = left[i - 1], left[i], left[(i + 1) % len(left)]
            if _cross(a, b, c) <= 0:
                continue
            if any(min(_cross(a, b, p), _cross(b, c, p), _cross(c, a, p)) >= 0 for p in left if p not in (a, b, c)):
                continue
            out.append((a, b, c))
            del left[i]
            break
        else:
            raise InvalidArgument("the polygon can't be cut into triangles")
    return [*out, tuple(left)]


def micro_triangles(spark: SparkSession, parts: list[tuple[tuple[float, float], ...]], target: int) -> DataFrame:
    """(ear, i, j, up) and corners of the small triangles that each ear is divided into."""
    areas = [abs(_cross(*e)) * 0.5 for e in parts]
    total = sum(areas)
    rows = [(k, *(float(v) for p in e for v in p), max(1, math.ceil(math.sqrt(a / total * target)))) for k, (e, a) in enumerate(zip(parts, areas, strict=True))]
    df = spark.createDataFrame(rows, "ear int, ax double, ay double, bx double, by double, cx double, cy double, n int")
    df = df.withColumn("i", F.explode(F.expr("sequence(0, n - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, n - 1 - i)")))
    df = df.withColumn("up", F.explode(F.when(F.expr("i + j + 1 < n"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    at = lambda di, dj, d: F.col(f"a{d}") + (F.col(f"b{d}") - F.col(f"a{d}")) * ((F.col("i") + di) / F.col("n")) + (F.col(f"c{d}") - F.col(f"a{d}")) * ((F.col("j") + dj) / F.col("n"))
    corner = {"p": ((0, 0), (1, 0)), "q": ((1, 0), (1, 1)), "r": ((0, 1), (0, 1))}
    cols = [F.when(F.col("up") == 0, at(*k[0], d)).otherwise(at(*k[1], d)).alias(name + d) for name, k in corner.items() for d in "xy"]
    return df.select("ear", "i", "j", "up", *cols)


def polygon_volume(grid: Grid, ring: Ring, datum: float, target: int = 20_000) -> DataFrame:
    """One row: areas, heights, cut and fill of a polygon's surface over a datum, by small triangles."""
    micro = micro_triangles(grid.df.sparkSession, ears(ring), target)
    mid = lambda d: (F.col(f"p{d}") + F.col(f"q{d}") + F.col(f"r{d}")) / 3.0
    points = F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y")) for k, x, y in (("p", F.col("px"), F.col("py")), ("q", F.col("qx"), F.col("qy")), ("r", F.col("rx"), F.col("ry")), ("m", mid("x"), mid("y")))])
    asked = micro.select("*", F.explode(points).alias("s")).select("*", F.col("s.k").alias("k"), F.col("s.x").alias("x"), F.col("s.y").alias("y")).drop("s")
    key = ["ear", "i", "j", "up"]
    flat = sample(grid, asked).groupBy(*key, "px", "py", "qx", "qy", "rx", "ry").agg(*(F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}") for k in "pqrm"))
    c = F.coalesce
    zp, zq, zr, zm = (c(F.col(f"z{k}"), F.col("zm")) for k in "pqrm")
    ux, uy, vx, vy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py"), F.col("rx") - F.col("px"), F.col("ry") - F.col("py")
    uz, vz = zq - zp, zr - zp
    nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    flat = flat.where(F.col("zm").isNotNull()).withColumn("plan", F.abs(nz) * 0.5).withColumn("slant", F.sqrt(nx * nx + ny * ny + nz * nz) * 0.5)
    flat = flat.withColumn("mean", (zp + zq + zr) / 3.0).withColumn("low", F.least(zp, zq, zr, zm)).withColumn("high", F.greatest(zp, zq, zr, zm)).where("plan > 0")
    signed = (F.col("mean") - num(datum)) * F.col("plan")
    s = flat.agg(F.count(F.lit(1)).alias("valid_count"), F.sum("plan").alias("plan_area"), F.sum("slant").alias("surface_area"), F.min("low").alias("minimum_z"), F.max("high").alias("maximum_z"), F.try_divide(F.sum(F.col("mean") * F.col("plan")), F.sum("plan")).alias("mean_z"), F.coalesce(F.sum(F.when(signed >= 0, signed)), num(0)).alias("cut_volume"), F.coalesce(F.sum(F.when(signed < 0, -signed)), num(0)).alias("fill_volume"))
    return s.withColumn("net_cut_volume", F.col("cut_volume") - F.col("fill_volume"))


def nice_interval(span: float) -> float:
    """A contour interval of 1, 2, 5 or 10 times a power of ten for about twelve levels."""
    if not span > 0 or not math.isfinite(span):
        return 1.0
    raw = span / 12.0
    power = 10.0 ** math.floor(math.log10(raw))
    return next(f for f in (1.0, 2.0, 5.0, 10.0) if raw / power <= f or f == 10.0) * power


def nice_intervals(df: DataFrame, span: str) -> DataFrame:
    """Adds ``interval`` to rows with a height range."""
    raw = F.col(span) / 12.0
    power = F.pow(num(10), F.floor(F.log10(raw)).cast("double"))
    shape = raw / power
    nice = F.when(shape <= 1, num(1)).when(shape <= 2, num(2)).when(shape <= 5, num(5)).otherwise(num(10)) * power
    return df.withColumn("interval", F.when(F.col(span) > 0, nice).otherwise(num(1)))


def ray_hits(triangles: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float]) -> DataFrame:
    """Triangles that a ray meets, with the distance ``t`` in lengths of its direction."""
    o, d = [num(v) for v in origin], [num(v) for v in direction]
    e = [[F.col(f"{k}{x}") - F.col(f"a{x}") for x in "xyz"] for k in "bc"]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    h = cross(d, e[1])
    det = dot(e[0], h)
    s = [o[i] - F.col(f"a{x}") for i, x in enumerate("xyz")]
    q = cross(s, e[0])
    u, v, t = (F.try_divide(x, det) for x in (dot(s, h), dot(d, q), dot(e[1], q)))
    df = triangles.withColumn("u", u).withColumn("v", v).withColumn("t", t)
    return df.where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") + F.col("v") <= 1) & (F.col("t") >= 0))


def chunk_ranges(triangles: DataFrame, size: int = 16_384) -> DataFrame:
    """(chunk, first, count) of contiguous blocks of triangles ordered by ids."""
    n = triangles.count()
    chunks = max(1, -(-n // size)) if n else 0
    spark = triangles.sparkSession
    first = F.col("id") * size
    return spark.range(chunks).select(F.col("id").alias("chunk"), first.alias("first"), F.least(F.lit(size).cast("long"), F.lit(n) - first).alias("count"))
