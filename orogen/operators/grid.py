"""Grid operators: windows, sampling, terrain derivatives, resampling, clipping, overviews."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from orogen.errors import EmptySurface, InvalidArgument, NotFound
from orogen.functions.geometry import aspect_degrees, clamp, gradient_x, gradient_y, node_col, node_row, num, slope_degrees, world_x, world_y
from orogen.schema import EPS, Grid, GridMeta, same_crs


def along_row() -> WindowSpec:
    return Window.partitionBy("row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy("col").orderBy("row")


def nodes(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """(row, col) of every node; rows are made where they are used, without a shuffle."""
    n = spark.range(meta.width * meta.height)
    return n.select(F.expr(f"id div {meta.width}").alias("row"), (F.col("id") % meta.width).alias("col"))


def create(spark: SparkSession, meta: GridMeta, *, nodata: bool = True) -> Grid:
    """A grid without heights, or of zeros."""
    z = F.lit(None).cast("double") if nodata else num(0)
    return Grid(nodes(spark, meta).withColumn("z", z), meta)


def from_values(df: DataFrame, meta: GridMeta, nodata: float | None = None) -> Grid:
    """A grid of (row, col, z), with the NoData value, NaN and infinities as null."""
    z = F.col("z").cast("double")
    bad = F.isnan(z) | (F.abs(z) == float("inf"))
    if nodata is not None:
        bad = bad | (z == num(nodata))
    return Grid(df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.when(~bad, z).alias("z")), meta)


def info(grid: Grid) -> DataFrame:
    """One row: size, valid nodes, range and bounds."""
    xmin, ymin, xmax, ymax = map(num, grid.meta.bounds())
    return grid.df.agg(
        F.count(F.lit(1)).alias("node_count"), F.count("z").alias("valid_count"), F.min("z").alias("minimum"), F.max("z").alias("maximum"),
    ).select(F.lit(grid.meta.width).cast("long").alias("width"), F.lit(grid.meta.height).cast("long").alias("height"), "*", xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def _inside(meta: GridMeta, col: int, row: int, width: int, height: int) -> None:
    if min(col, row) < 0 or min(width, height) < 1 or col + width > meta.width or row + height > meta.height:
        raise InvalidArgument("the window leaves the grid")


def read_window(grid: Grid, col: int, row: int, width: int, height: int) -> DataFrame:
    _inside(grid.meta, col, row, width, height)
    return grid.df.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def write_window(grid: Grid, values: DataFrame) -> Grid:
    """The grid with the (row, col, z) of ``values`` put in; a null z clears a node."""
    new = values.select("row", "col", F.col("z").alias("new"), F.lit(True).alias("set"))
    df = grid.df.join(new, ["row", "col"], "left").select("row", "col", F.when(F.col("set"), F.col("new")).otherwise(F.col("z")).alias("z"))
    return Grid(df, grid.meta.edited())


def positions(grid: Grid) -> DataFrame:
    """Nodes with their world coordinates."""
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    return grid.df.select("row", "col", world_x(grid.meta, c, r).alias("x"), world_y(grid.meta, c, r).alias("y"), "z")


def gradients(grid: Grid, z_factor: float = 1.0) -> DataFrame:
    """(row, col, zx, zy): central differences inside, one-sided at the border; null unless all five nodes are valid.

    Two window passes, dealt by row and by column.
    """
    m = grid.meta
    if m.width < 2 or m.height < 2:
        raise EmptySurface("terrain derivatives need two rows and two columns")
    c, r, z = F.col("col"), F.col("row"), F.col("z")
    df = grid.df.withColumn("left", F.when(c == 0, z).otherwise(F.lag("z").over(along_row()))).withColumn("right", F.when(c == m.width - 1, z).otherwise(F.lead("z").over(along_row())))
    df = df.withColumn("above", F.when(r == 0, z).otherwise(F.lag("z").over(along_col()))).withColumn("below", F.when(r == m.height - 1, z).otherwise(F.lead("z").over(along_col())))
    col_span = F.when((c == 0) | (c == m.width - 1), num(1)).otherwise(num(2))
    row_span = F.when((r == 0) | (r == m.height - 1), num(1)).otherwise(num(2))
    by_col = num(z_factor) * (F.col("right") - F.col("left")) / col_span
    by_row = num(z_factor) * (F.col("below") - F.col("above")) / row_span
    valid = z.isNotNull()
    return df.select("row", "col", F.when(valid, gradient_x(m, by_col, by_row)).alias("zx"), F.when(valid, gradient_y(m, by_col, by_row)).alias("zy"))


def slope(grid: Grid, z_factor: float = 1.0) -> Grid:
    df = gradients(grid, z_factor).select("row", "col", slope_degrees(F.col("zx"), F.col("zy")).alias("z"))
    return Grid(df, grid.meta.edited())


def aspect(grid: Grid, z_factor: float = 1.0) -> Grid:
    df = gradients(grid, z_factor).select("row", "col", aspect_degrees(F.col("zx"), F.col("zy")).alias("z"))
    return Grid(df, grid.meta.edited())


def hillshade(grid: Grid, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> Grid:
    """Brightness 0 to 255 under a distant sun."""
    a, h = math.radians(azimuth), math.radians(altitude)
    sun = math.sin(a) * math.cos(h), math.cos(a) * math.cos(h), math.sin(h)
    zx, zy = F.col("zx"), F.col("zy")
    light = (-zx * num(sun[0]) - zy * num(sun[1]) + num(sun[2])) / F.sqrt(zx * zx + zy * zy + 1.0)
    bright = F.when(light.isNotNull(), num(255) * F.greatest(num(0), light))
    return Grid(gradients(grid, z_factor).select("row", "col", bright.alias("z")), grid.meta.edited())


def cells(df: DataFrame, *values: str) -> DataFrame:
    """Complete cells: for each value v of a node its v00, v10 (next column), v01 (next row), v11."""
    for v in values:
        df = df.withColumn(f"{v}00", F.col(v)).withColumn(f"{v}10", F.lead(v).over(along_row()))
    df = df.withColumn("__right", F.lead("col").over(along_row()))
    for v in values:
        df = df.withColumn(f"{v}01", F.lead(f"{v}00").over(along_col())).withColumn(f"{v}11", F.lead(f"{v}10").over(along_col()))
    df = df.withColumn("__below", F.lead("row").over(along_col()))
    return df.where(F.col("__right").isNotNull() & F.col("__below").isNotNull()).drop("__right", "__below", *values)


def cell_of(meta: GridMeta, points: DataFrame, x: str, y: str, slack: float = 64.0) -> DataFrame:
    """Adds the cell (``cr``, ``cc``) and the place in it (``u``, ``v``) of points; null outside the grid."""
    far_c, far_r = float(meta.width - 1), float(meta.height - 1)
    df = points.withColumn("__c", node_col(meta, F.col(x), F.col(y))).withColumn("__r", node_row(meta, F.col(x), F.col(y)))
    tolerance = num(EPS * slack) * F.greatest(num(max(1.0, far_c, far_r)), F.abs("__c"), F.abs("__r"))
    within = (F.col("__c") >= -tolerance) & (F.col("__c") <= num(far_c) + tolerance) & (F.col("__r") >= -tolerance) & (F.col("__r") <= num(far_r) + tolerance)
    df = df.withColumn("__c", F.when(within, clamp(F.col("__c"), 0, far_c))).withColumn("__r", F.when(within, clamp(F.col("__r"), 0, far_r)))
    df = df.withColumn("cc", F.least(F.floor("__c"), F.lit(meta.width - 2))).withColumn("cr", F.least(F.floor("__r"), F.lit(meta.height - 2)))
    return df.withColumn("u", F.col("__c") - F.col("cc")).withColumn("v", F.col("__r") - F.col("cr")).drop("__c", "__r")


def _bilinear() -> Column:
    u, v = F.col("u"), F.col("v")
    return (1.0 - u) * (1.0 - v) * F.col("z00") + u * (1.0 - v) * F.col("z10") + (1.0 - u) * v * F.col("z01") + u * v * F.col("z11")


def sample(grid: Grid, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points with bilinear ``z``, gradient, slope and aspect (0 where flat); null outside or beside a missing node.

    One equi-join on the cell that holds each point.
    """
    m = grid.meta
    if m.width < 2 or m.height < 2:
        raise EmptySurface("sampling needs two rows and two columns")
    around = cells(grid.df, "z").select(F.col("row").alias("cr"), F.col("col").alias("cc"), "z00", "z10", "z01", "z11")
    df = cell_of(m, points, x, y).join(around, ["cr", "cc"], "left")
    u, v = F.col("u"), F.col("v")
    by_col = (1.0 - v) * (F.col("z10") - F.col("z00")) + v * (F.col("z11") - F.col("z01"))
    by_row = (1.0 - u) * (F.col("z01") - F.col("z00")) + u * (F.col("z11") - F.col("z10"))
    df = df.withColumn("z", _bilinear()).withColumn("dz_dx", gradient_x(m, by_col, by_row)).withColumn("dz_dy", gradient_y(m, by_col, by_row))
    steep = F.sqrt(F.col("dz_dx") * F.col("dz_dx") + F.col("dz_dy") * F.col("dz_dy"))
    flat = steep <= EPS * 64
    df = df.withColumn("slope", slope_degrees(F.col("dz_dx"), F.col("dz_dy"))).withColumn("aspect", F.when(flat, num(0)).otherwise(aspect_degrees(F.col("dz_dx"), F.col("dz_dy"))))
    return df.drop("cr", "cc", "u", "v", "z00", "z10", "z01", "z11")


def _lanczos(t: Column) -> Column:
    sinc = lambda a: F.when(a == 0.0, num(1)).otherwise(F.sin(a) / a)
    a = t * math.pi
    return F.when(F.abs(t) < 3.0, sinc(a) * sinc(a / 3.0)).otherwise(num(0))


def _weights(method: str, t: Column) -> dict[int, Column]:
    """Weights of the nodes around a place ``t`` between nodes 0 and 1, by node."""
    if method == "cubic":
        return {-1: t * (t * (1.0 - t * 0.5) - 0.5), 0: t * t * (t * 1.5 - 2.5) + 1.0, 1: t * (t * (2.0 - t * 1.5) + 0.5), 2: t * t * (t * 0.5 - 0.5)}
    if method == "cubicspline":
        s = 1.0 - t
        return {-1: s * s * s / 6.0, 0: (t * t * (t * 3.0 - 6.0) + 4.0) / 6.0, 1: (s * s * (s * 3.0 - 6.0) + 4.0) / 6.0, 2: t * t * t / 6.0}
    if method == "lanczos":
        return {k: _lanczos(t - num(k)) for k in range(-2, 4)}
    raise InvalidArgument(f"unknown resampling method {method!r}")


def sample_kernel(grid: Grid, points: DataFrame, method: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points with ``z`` by a kernel of 4 x 4 nodes (``cubic``, ``cubicspline``) or 6 x 6 (``lanczos``); null outside the grid.

    ``cubic`` (Catmull-Rom) falls back to bilinear, null beside a missing node,
    where one of the sixteen is missing or off the grid. The others divide by
    the weights of the nodes that have heights, and are null under 1e-6 of
    them. One equi-join on the cell, as in :func:`sample`.
    """
    m = grid.meta
    if m.width < 2 or m.height < 2:
        raise EmptySurface("sampling needs two rows and two columns")
    across, down = _weights(method, F.col("u")), _weights(method, F.col("v"))
    away = lambda c, k, w: (F.lead(c, k) if k >= 0 else F.lag(c, -k)).over(w)
    z = {(j, i): f"__z{j - min(down)}_{i - min(across)}" for j in down for i in across}
    df = grid.df.select("row", "col", *(away("z", i, along_row()).alias(f"__r{i - min(across)}") for i in across))
    df = df.select(F.col("row").alias("cr"), F.col("col").alias("cc"), *(away(f"__r{i - min(across)}", j, along_col()).alias(name) for (j, i), name in z.items()))
    # The weights are columns below the join, so that each is computed once.
    named = {f"__u{i - min(across)}": w for i, w in across.items()} | {f"__v{j - min(down)}": w for j, w in down.items()}
    df = cell_of(m, points, x, y).withColumns(named).join(df, ["cr", "cc"], "left")
    across, down = {i: F.col(f"__u{i - min(across)}") for i in across}, {j: F.col(f"__v{j - min(down)}") for j in down}
    if method == "cubic":
        total = sum((down[j] * sum((across[i] * F.col(z[j, i]) for i in across), num(0)) for j in down), num(0))
        u, v = F.col("u"), F.col("v")
        near = (1.0 - v) * ((1.0 - u) * F.col(z[0, 0]) + u * F.col(z[0, 1])) + v * ((1.0 - u) * F.col(z[1, 0]) + u * F.col(z[1, 1]))
        value = F.coalesce(total, near)
    else:
        weight = sum((down[j] * sum((F.when(F.col(z[j, i]).isNotNull(), across[i]).otherwise(num(0)) for i in across), num(0)) for j in down), num(0))
        total = sum((down[j] * sum((F.coalesce(across[i] * F.col(z[j, i]), num(0)) for i in across), num(0)) for j in down), num(0))
        value = F.when(weight > 1e-6, F.try_divide(total, weight))
    return df.withColumn("z", value).drop("cr", "cc", "u", "v", *z.values(), *named)


def sample_edges(grid: Grid, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """As :func:`sample`, but grids of one row or one column have heights along it too, level across it.

    Points count as inside up to 1e-9 of a step beyond the outermost nodes.
    """
    m, df = grid.meta, grid.df
    if m.width == 1:
        df = df.unionByName(df.withColumn("col", F.col("col") + 1))
    if m.height == 1:
        df = df.unionByName(df.withColumn("row", F.col("row") + 1))
    wide = replace(m, width=max(m.width, 2), height=max(m.height, 2))
    inside = lambda at, n: at.between(-1e-9, n - 1 + 1e-9)
    held = inside(node_col(m, F.col(x), F.col(y)), m.width) & inside(node_row(m, F.col(x), F.col(y)), m.height)
    out = sample(Grid(df, wide), points, x, y)
    made = [c for c in out.columns if c not in points.columns]
    return out.select(*points.columns, *(F.when(held, F.col(c)).alias(c) for c in made))


def resample(grid: Grid, target: GridMeta, method: str = "bilinear", *, renormalize: bool = False) -> Grid:
    """The grid's heights at the nodes of another geometry (``nearest`` or ``bilinear``).

    ``renormalize`` divides by the weights of the valid corners instead of
    giving null beside a missing one.
    """
    m = grid.meta
    same_crs(m.crs, target.crs)
    spark = grid.df.sparkSession
    g, t, d = m.gt, target.gt, m.det
    c0, r0 = ((t[0] - g[0]) * g[5] - (t[3] - g[3]) * g[2]) / d, ((t[3] - g[3]) * g[1] - (t[0] - g[0]) * g[4]) / d
    steps = (t[1] * g[5] - t[4] * g[2]) / d, (t[4] * g[1] - t[1] * g[4]) / d, (t[2] * g[5] - t[5] * g[2]) / d, (t[5] * g[1] - t[2] * g[4]) / d
    far_c, far_r = float(m.width - 1), float(m.height - 1)
    scale = max(1.0, far_c, far_r, abs(c0), abs(r0), abs(steps[0]) * target.width, abs(steps[1]) * target.width, abs(steps[2]) * target.height, abs(steps[3]) * target.height)
    tol = EPS * scale * 128
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    df = nodes(spark, target)
    df = df.withColumn("c", num(c0) + row * num(steps[2]) + col * num(steps[0])).withColumn("r", num(r0) + row * num(steps[3]) + col * num(steps[1]))
    within = F.col("c").between(-tol, far_c + tol) & F.col("r").between(-tol, far_r + tol)
    df = df.withColumn("c", F.when(within, clamp(F.col("c"), 0, far_c))).withColumn("r", F.when(within, clamp(F.col("r"), 0, far_r)))
    src = grid.df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z")
    if method == "nearest":
        df = df.withColumn("sr", F.floor(F.col("r") + 0.5)).withColumn("sc", F.floor(F.col("c") + 0.5))
        return Grid(df.join(src, ["sr", "sc"], "left").select("row", "col", "z"), target)
    if method != "bilinear":
        raise InvalidArgument(f"unknown resampling method {method!r}")
    if m.width < 2 or m.height < 2:
        raise EmptySurface("bilinear resampling needs two rows and two columns")
    around = cells(grid.df, "z").select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z00", "z10", "z01", "z11")
    df = df.withColumn("sr", F.least(F.floor("r"), F.lit(m.height - 2))).withColumn("sc", F.least(F.floor("c"), F.lit(m.width - 2)))
    df = df.withColumn("u", F.col("c") - F.col("sc")).withColumn("v", F.col("r") - F.col("sr")).join(around, ["sr", "sc"], "left")
    u, v = F.col("u"), F.col("v")
    weights = [(1.0 - u) * (1.0 - v), u * (1.0 - v), (1.0 - u) * v, u * v]
    total, weight = num(0), num(0)
    for w, z in zip(weights, ("z00", "z10", "z01", "z11"), strict=True):
        total = total + (F.when(F.col(z).isNotNull(), w * F.col(z)).otherwise(num(0)) if renormalize else w * F.col(z))
        weight = weight + (F.when(F.col(z).isNotNull(), w).otherwise(num(0)) if renormalize else w)
    return Grid(df.select("row", "col", F.when(u.isNotNull() & (weight > EPS * 16), F.try_divide(total, weight)).alias("z")), target)


def _ring(points: list[tuple[float, float]], meta: GridMeta) -> tuple[list[tuple[float, float]], float, float]:
    """Checks a ring in node space; gives it with its length and area tolerances."""
    if len(points) < 3:
        raise InvalidArgument("a clip polygon needs three points")
    xs, ys = zip(*points, strict=True)
    scale = max(1.0, *map(abs, (min(xs), max(xs), min(ys), max(ys))), float(meta.width), float(meta.height))
    length, area = EPS * scale * 128, EPS * scale * 128 * scale
    n = len(points)
    if any(math.dist(points[i], points[(i + 1) % n]) <= length for i in range(n)):
        raise InvalidArgument("a clip polygon has equal points side by side")
    turns = ((points[(i + 1) % n][0] - points[i][0]) * (points[(i + 2) % n][1] - points[(i + 1) % n][1]) - (points[(i + 1) % n][1] - points[i][1]) * (points[(i + 2) % n][0] - points[(i + 1) % n][0]) for i in range(n))
    if max(xs) - min(xs) <= length or max(ys) - min(ys) <= length or not any(abs(t) > area for t in turns):
        raise InvalidArgument("a clip polygon has no area")
    return points, length, area


def ring_contains(ring: list[tuple[float, float]], x: Column, y: Column, length: float = 0.0, area: float = 0.0) -> Column:
    """Even-odd test of points against a ring; its border counts as inside. Edges are an array literal: no join."""
    edges = F.array(*[F.struct(num(a[0]).alias("ax"), num(a[1]).alias("ay"), num(b[0]).alias("bx"), num(b[1]).alias("by")) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)])

    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        between = (x >= F.least(e["ax"], e["bx"]) - length) & (x <= F.greatest(e["ax"], e["bx"]) + length) & (y >= F.least(e["ay"], e["by"]) - length) & (y <= F.greatest(e["ay"], e["by"]) + length)
        return (F.abs(cross) <= area) & between

    def crosses(e: Column) -> Column:
        at = e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    return F.exists(edges, on) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def clip(grid: Grid, polygon: list[tuple[float, float]], *, crop: bool = False, invert: bool = False, node_space: bool = False) -> Grid:
    """Heights of the nodes in (or with ``invert`` outside) a world polygon; the others become null.

    ``crop`` keeps only the window of the polygon's bounds and moves the origin.
    """
    if crop and invert:
        raise InvalidArgument("an inverted clip can't be cropped")
    m = grid.meta
    points = list(polygon) if node_space else [m.node(x, y) for x, y in polygon]
    ring, length, area = _ring(points, m)
    xs, ys = zip(*ring, strict=True)
    df, meta = grid.df, m
    if crop:
        c0, c1 = math.ceil(max(0.0, min(xs) - length)), math.floor(min(m.width - 1.0, max(xs) + length))
        r0, r1 = math.ceil(max(0.0, min(ys) - length)), math.floor(min(m.height - 1.0, max(ys) + length))
        if c0 > c1 or r0 > r1:
            raise NotFound("the clip polygon holds no node")
        df = df.where(F.col("col").between(c0, c1) & F.col("row").between(r0, r1))
        x0, y0 = m.world(c0, r0)
        meta = replace(m, width=c1 - c0 + 1, height=r1 - r0 + 1, gt=(x0, m.gt[1], m.gt[2], y0, m.gt[4], m.gt[5]))
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    near = x.between(min(xs) - length, max(xs) + length) & y.between(min(ys) - length, max(ys) + length)
    chosen = near & ring_contains(ring, x, y, length, area)
    chosen = ~chosen if invert else chosen
    # A lambda would read a new "row" of the same select, so the mask comes first.
    df = df.withColumn("z", F.when(chosen, F.col("z")))
    if crop:
        df = df.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "z")
    return Grid(df, meta.edited())


def overview(grid: Grid, out_width: int, out_height: int, method: str = "average", *, strict: bool = False, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(bin_row, bin_col, value, valid, nodata) of a window (col, row, width, height) drawn in fewer nodes.

    One aggregation by integer bins; ``nearest`` picks a node for each bin and
    may also enlarge. ``strict`` makes a bin null if any of its nodes is.
    """
    c0, r0, w, h = window or (0, 0, grid.meta.width, grid.meta.height)
    df = read_window(grid, c0, r0, w, h).select((F.col("row") - r0).alias("r"), (F.col("col") - c0).alias("c"), "z")
    if method == "nearest":
        at = lambda i, s, o: F.least(F.expr(f"((2 * {i} + 1) * {s}L) div (2 * {o}L)"), F.lit(s - 1))
        bins = nodes(grid.df.sparkSession, GridMeta(out_width, out_height)).select(F.col("row").alias("bin_row"), F.col("col").alias("bin_col"))
        bins = bins.withColumn("r", at("bin_row", h, out_height)).withColumn("c", at("bin_col", w, out_width))
        out = bins.join(df, ["r", "c"])
        known = F.col("z").isNotNull().cast("long")
        return out.select("bin_row", "bin_col", F.col("z").alias("value"), known.alias("valid"), (1 - known).alias("nodata"))
    if out_width > w or out_height > h:
        raise InvalidArgument("an aggregate overview can't enlarge")
    into = lambda i, s, o: F.expr(f"(({i} + 1) * {o}L - 1) div {s}L")
    agg = {"average": F.avg, "minimum": F.min, "maximum": F.max}[method]
    out = df.groupBy(into("r", h, out_height).alias("bin_row"), into("c", w, out_width).alias("bin_col")).agg(
        agg("z").alias("value"), F.count("z").alias("valid"), (F.count(F.lit(1)) - F.count("z")).alias("nodata"))
    return out.withColumn("value", F.when(F.col("nodata") == 0, F.col("value"))) if strict else out


def overview_statistics(grid: Grid, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    c0, r0, w, h = window or (0, 0, grid.meta.width, grid.meta.height)
    return read_window(grid, c0, r0, w, h).agg(F.count("z").alias("valid"), (F.count(F.lit(1)) - F.count("z")).alias("nodata"), F.min("z").alias("minimum"), F.max("z").alias("maximum"), F.avg("z").alias("mean"))


def halved(grid: Grid) -> Grid:
    """The next pyramid level: means of the valid nodes of 2 x 2 blocks."""
    df = grid.df.groupBy(F.expr("row div 2").alias("row"), F.expr("col div 2").alias("col")).agg(F.avg("z").alias("z"))
    g = grid.meta.gt
    meta = replace(grid.meta, width=-(-grid.meta.width // 2), height=-(-grid.meta.height // 2), gt=(g[0] + 0.5 * (g[1] + g[2]), 2 * g[1], 2 * g[2], g[3] + 0.5 * (g[4] + g[5]), 2 * g[4], 2 * g[5]))
    return Grid(df, meta)


def pyramid(grid: Grid, smallest: int = 512) -> list[Grid]:
    """Levels from half size down, until the longer side has at most ``smallest`` nodes."""
    out = []
    while max(grid.meta.width, grid.meta.height) > smallest:
        grid = halved(grid)
        out.append(grid)
    return out


def pyramid_overview(levels: list[Grid], grid: Grid, out_width: int, out_height: int) -> DataFrame:
    """An approximate average overview from the coarsest level that is still as fine as the output."""
    fit = [g for g in [grid, *levels] if g.meta.width >= out_width and g.meta.height >= out_height]
    return overview(fit[-1], out_width, out_height)
