"""Views of grids: windows of world rectangles, tile tables, progressive frames, fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument, NotFound
from orogen.operators.grid import nodes, overview, read_window
from orogen.schema import Grid, GridMeta

Window4 = tuple[int, int, int, int]


def view_window(meta: GridMeta, xmin: float, ymin: float, xmax: float, ymax: float, padding: int = 0) -> tuple[Window4, bool]:
    """The nodes (col, row, width, height) that a world rectangle needs, and whether it was clipped."""
    ring = [meta.node(x, y) for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))]
    limits = ((-0.5, meta.width - 0.5), (-0.5, meta.height - 0.5))
    clipped = any(not low <= p[k] <= high for p in ring for k, (low, high) in enumerate(limits))
    for k, (low, high) in enumerate(limits):
        for edge, sign in ((low, 1), (high, -1)):
            kept = []
            for p, q in zip(ring[-1:] + ring[:-1], ring, strict=True):
                inside = sign * (p[k] - edge) >= 0, sign * (q[k] - edge) >= 0
                if inside[0] != inside[1]:
                    t = (edge - p[k]) / (q[k] - p[k])
                    at = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
                    at[k] = edge
                    kept.append(tuple(at))
                if inside[1]:
                    kept.append(q)
            ring = kept
            if not ring:
                raise NotFound("the view doesn't meet the grid")
    def span(values: list[float], n: int) -> tuple[int, int]:
        low = min(max(math.floor(min(values)), 0), n - 1)
        high = min(max(math.ceil(max(values)), 0), n - 1)
        return max(low - padding, 0), min(high + padding, n - 1)

    c0, c1 = span([p[0] for p in ring], meta.width)
    r0, r1 = span([p[1] for p in ring], meta.height)
    return (c0, r0, c1 - c0 + 1, r1 - r0 + 1), clipped


def lod_scale(window: Window4, out_width: int, out_height: int) -> int:
    """The largest power of two not above the smaller reduction."""
    ratio, scale = min(window[2] // out_width, window[3] // out_height), 1
    while scale * 2 <= ratio:
        scale *= 2
    return scale


def tile_table(grid: Grid, scale: int, tile: int = 128) -> DataFrame:
    """(tile_row, tile_col, r, c, value): averages of scale x scale blocks in tiles; one aggregation.

    Blocks at the far edges are stretched as an overview of the tile's own
    nodes stretches them.
    """
    m, span = grid.meta, tile * scale
    df = grid.df.select(F.expr(f"row div {span}").alias("tile_row"), F.expr(f"col div {span}").alias("tile_col"), F.expr(f"row % {span}").alias("r"), F.expr(f"col % {span}").alias("c"), "z")
    high = F.least(F.lit(span), F.lit(m.height) - F.col("tile_row") * span)
    wide = F.least(F.lit(span), F.lit(m.width) - F.col("tile_col") * span)
    df = df.withColumn("h", high).withColumn("w", wide).withColumn("oh", F.ceil(high / scale)).withColumn("ow", F.ceil(wide / scale))
    df = df.withColumn("br", F.expr("((r + 1) * oh - 1) div h")).withColumn("bc", F.expr("((c + 1) * ow - 1) div w"))
    return df.groupBy("tile_row", "tile_col", "h", "w", "oh", "ow", F.col("br").alias("r"), F.col("bc").alias("c")).agg(F.avg("z").alias("value"))


def read_view(grid: Grid, window: Window4, out_width: int, out_height: int, scale: int | None = None, tile: int = 128, tiles: DataFrame | None = None) -> DataFrame:
    """(out_row, out_col, value): pixels of a window picked from tiles. An equi-join of pixels with tile cells.

    ``tiles`` may be a persisted :func:`tile_table` of the same scale, which serves any window.
    """
    c0, r0, w, h = window
    scale = scale or lod_scale(window, out_width, out_height)
    if scale & (scale - 1):
        raise InvalidArgument("the scale must be a power of two")
    span = tile * scale
    table = tile_table(grid, scale, tile) if tiles is None else tiles
    pick = lambda i, s, o, at: F.expr(f"{at}L + least({s - 1}L, ((2 * {i} + 1) * {s}L) div (2 * {o}L))")
    px = nodes(grid.df.sparkSession, GridMeta(out_width, out_height)).select(F.col("row").alias("out_row"), F.col("col").alias("out_col"))
    px = px.withColumn("sy", pick("out_row", h, out_height, r0)).withColumn("sx", pick("out_col", w, out_width, c0))
    px = px.withColumn("tile_row", F.expr(f"sy div {span}")).withColumn("tile_col", F.expr(f"sx div {span}"))
    th = F.least(F.lit(span), F.lit(grid.meta.height) - F.col("tile_row") * span)
    tw = F.least(F.lit(span), F.lit(grid.meta.width) - F.col("tile_col") * span)
    px = px.withColumn("h", th).withColumn("w", tw).withColumn("oh", F.ceil(th / scale)).withColumn("ow", F.ceil(tw / scale))
    px = px.withColumn("r", F.expr(f"least(oh - 1, ((sy % {span}) * oh) div h)")).withColumn("c", F.expr(f"least(ow - 1, ((sx % {span}) * ow) div w)"))
    return px.join(table.select("tile_row", "tile_col", "r", "c", "value"), ["tile_row", "tile_col", "r", "c"]).select("out_row", "out_col", "value")


def progressive(grid: Grid, window: Window4, out_width: int, out_height: int, frames: int = 3, tile: int = 128) -> DataFrame:
    """(sequence, scale, out_row, out_col, value): coarse frames first, the target's scale last."""
    target = lod_scale(window, out_width, out_height)
    out = None
    for k in range(frames):
        scale = target << (frames - 1 - k)
        f = read_view(grid, window, out_width, out_height, scale, tile).select(F.lit(k).alias("sequence"), F.lit(scale).alias("scale"), "*")
        out = f if out is None else out.unionByName(f)
    return out


def view(grid: Grid, box: tuple[float, float, float, float], out_width: int, out_height: int, method: str = "average") -> DataFrame:
    """An overview of the window that a world rectangle needs."""
    window, _ = view_window(grid.meta, *box)
    return overview(grid, min(out_width, window[2]) if method != "nearest" else out_width, min(out_height, window[3]) if method != "nearest" else out_height, method, window=window)


def fingerprint(grid: Grid, samples: int = 64) -> DataFrame:
    """One row that changes with the grid's size, transform, CRS, generation or sampled heights."""
    m = grid.meta
    step = lambda n: max(1, n // samples)
    picked = grid.df.where((F.col("row") % step(m.height) == 0) & (F.col("col") % step(m.width) == 0))
    head = f"{m.width},{m.height},{m.gt},{m.crs},{m.generation}"
    return picked.agg(F.count(F.lit(1)).alias("samples"), F.bit_xor(F.xxhash64("row", "col", F.coalesce("z", F.lit(-9e99)))).alias("h")).select("samples", F.xxhash64(F.lit(head), "h").alias("fingerprint"))


def block_sums(grid: Grid, block_rows: int = 64) -> DataFrame:
    """(block, nodes, crc): a checksum of each block of rows, whatever the order of its nodes."""
    word = F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string"), F.coalesce(F.col("z").cast("decimal(30,6)").cast("string"), F.lit("-")))
    return grid.df.groupBy(F.expr(f"row div {block_rows}").alias("block")).agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.crc32(word.cast("binary"))).alias("crc"))


def broken_blocks(grid: Grid, stored: DataFrame, block_rows: int = 64) -> DataFrame:
    """Blocks whose checksum isn't the stored one."""
    return block_sums(grid, block_rows).join(stored.select("block", "crc"), ["block", "crc"], "left_anti").select("block")


def window_blocks(window: Window4, width: int, block_values: int) -> list[int]:
    """Blocks of row-major values that a window's rows touch."""
    c, r, w, h = window
    out = set()
    for row in range(r, r + h):
        out.update(range((row * width + c) // block_values, (row * width + c + w - 1) // block_values + 1))
    return sorted(out)


def window_blocks_table(spark, window: Window4, width: int, block_values: int) -> DataFrame:
    """The same as a table: rows exploded to the blocks they touch."""
    c, r, w, h = window
    rows = spark.range(r, r + h).select(F.col("id").alias("row"))
    first, last = F.expr(f"(row * {width} + {c}) div {block_values}"), F.expr(f"(row * {width} + {c + w - 1}) div {block_values}")
    return rows.select(F.explode(F.sequence(first, last)).alias("block")).distinct()


def compacted(tiles: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last record of each key of an append-only tile table."""
    rest = [c for c in tiles.columns if c not in key]
    return tiles.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*key, "r.*")


class ViewCache:
    """Persisted tile tables by grid fingerprint and scale; the least recently used go when there are too many or too many bytes.

    A table that is larger than the limit by itself isn't kept.
    """

    def __init__(self, most: int = 8, most_bytes: int | None = None) -> None:
        self.most, self.most_bytes, self.hits, self.misses = most, most_bytes, 0, 0
        self.held: dict[tuple, tuple[DataFrame, int]] = {}

    def tiles(self, grid: Grid, scale: int, tile: int = 128) -> DataFrame:
        key = (fingerprint(grid).first()["fingerprint"], scale, tile)
        if key in self.held:
            self.hits += 1
            self.held[key] = self.held.pop(key)
            return self.held[key][0]
        self.misses += 1
        df = tile_table(grid, scale, tile).persist()
        df.count()
        # Once it is filled, the plan of a persisted table knows its size.
        self.held[key] = df, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        while len(self.held) > self.most or (self.most_bytes is not None and self.bytes > self.most_bytes):
            self.held.pop(next(iter(self.held)))[0].unpersist()
        return df

    @property
    def bytes(self) -> int:
        return sum(size for _, size in self.held.values())

    def read(self, grid: Grid, window: Window4, out_width: int, out_height: int, tile: int = 128) -> DataFrame:
        scale = lod_scale(window, out_width, out_height)
        return read_view(grid, window, out_width, out_height, scale, tile, self.tiles(grid, scale, tile))

    def statistics(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "tables": len(self.held), "bytes": self.bytes}

    def clear(self) -> None:
        for df, _ in self.held.values():
            df.unpersist()
        self.held.clear()


def prefetch(grid: Grid, window: Window4) -> DataFrame:
    """Marks a window for caching on its first use."""
    return read_window(grid, *window).persist()
