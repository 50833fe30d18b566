"""Warping kernels against sums node by node, and tile packages over sessions."""

import glob
import math

import pytest
from pyspark.sql import functions as F

from orogen.errors import CorruptedData, InvalidArgument, StaleQuery
from orogen.operators import grid, reproject, view
from orogen.schema import Grid, GridMeta
from orogen.sources.tile_package import TilePackage


def make(spark, f, width=12, height=10):
    rows = [(r, c, f(r, c)) for r in range(height) for c in range(width)]
    return Grid(spark.createDataFrame(rows, "row long, col long, z double"), GridMeta(width, height))


def rough(r, c):
    return None if (r, c) == (5, 6) else float((r * 37 + c * 91) % 23)


def at(spark, points):
    return spark.createDataFrame(points, "x double, y double")


def weight(method, d):
    d = abs(d)
    if method == "cubic":
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
    if method == "cubicspline":
        return 2 / 3 - d * d + d**3 / 2 if d <= 1 else (2 - d) ** 3 / 6 if d < 2 else 0.0
    s = lambda a: math.sin(a) / a if a else 1.0
    return s(math.pi * d) * s(math.pi * d / 3) if d < 3 else 0.0


def expected(method, x, y, width=12, height=10):
    if not (0 <= x <= width - 1 and 0 <= y <= height - 1):
        return None
    cc, cr, n = min(math.floor(x), width - 2), min(math.floor(y), height - 2), 3 if method == "lanczos" else 2
    z = {(r, c): rough(r, c) if 0 <= r < height and 0 <= c < width else None for r in range(cr - n + 1, cr + n + 1) for c in range(cc - n + 1, cc + n + 1)}
    if method == "cubic" and None in z.values():
        u, v = x - cc, y - cr
        corners = [(z[cr + j, cc + i], (u if i else 1 - u) * (v if j else 1 - v)) for i in (0, 1) for j in (0, 1)]
        return None if any(h is None for h, _ in corners) else sum(h * w for h, w in corners)
    held = [(h, weight(method, x - c) * weight(method, y - r)) for (r, c), h in z.items() if h is not None]
    total = sum(w for _, w in held)
    return sum(h * w for h, w in held) / total if total > 1e-6 else None


@pytest.mark.parametrize("method", ["cubic", "cubicspline", "lanczos"])
def test_kernels_against_plain_sums(spark, method):
    points = [(k % 13 * 0.93, k // 13 * 0.87) for k in range(160)] + [(0.0, 0.0), (11.0, 9.0), (4.0, 4.0), (-0.5, 3.0), (11.5, 2.0), (6.0, 5.0), (3.0, 3.0), (3.0, 3.0)]
    out = grid.sample_kernel(make(spark, rough), at(spark, points), method).select("x", "y", "z").collect()
    assert len(out) == len(points)
    for x, y, z in out:
        want = expected(method, x, y)
        assert (z is None) == (want is None) and (z is None or math.isclose(z, want, abs_tol=1e-9)), (x, y, z, want)


def test_cubic_keeps_planes_and_other_columns(spark):
    g = make(spark, lambda r, c: 3.0 * c - 2.0 * r + 1.0)
    points = at(spark, [(0.25, 0.5), (5.5, 4.75), (11.0, 9.0)]).withColumn("z0", F.lit(7))
    for p in grid.sample_kernel(g, points, "cubic").collect():
        assert math.isclose(p["z"], 3 * p["x"] - 2 * p["y"] + 1, abs_tol=1e-9) and p["z0"] == 7


def test_kernel_faults(spark):
    with pytest.raises(InvalidArgument):
        grid.sample_kernel(make(spark, rough), at(spark, [(1.0, 1.0)]), "gauss")
    assert grid.sample_kernel(make(spark, rough), at(spark, []), "lanczos").count() == 0


def test_suggested_geometry_holds_the_grid(spark):
    meta = GridMeta(40, 30, (11.0, 0.01, 0.0, 48.0, 0.0, -0.01), "EPSG:4326")
    same = reproject.suggested(spark, meta, "EPSG:4326")
    assert (same.width, same.height) == (40, 30) and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(same.gt, meta.gt, strict=True))
    utm = reproject.suggested(spark, meta, "EPSG:32632")
    xmin, ymin, xmax, ymax = utm.bounds()
    inner = spark.createDataFrame([meta.world(c, r) for c in (0, 39) for r in (0, 29)], "x double, y double")
    from orogen.functions import crs
    for x, y in crs.transform_points(inner, "EPSG:4326", "EPSG:32632").select("x", "y").collect():
        assert xmin - utm.gt[1] <= x <= xmax + utm.gt[1] and ymin - utm.gt[1] <= y <= ymax + utm.gt[1]


def cells(df):
    return sorted(map(tuple, df.select("tile_row", "tile_col", "r", "c", "value").collect()), key=str)


def test_package_outlives_its_maker(spark, tmp_path):
    g, path = make(spark, rough), f"file://{tmp_path}/tiles"
    want = cells(view.tile_table(g, 2, 4))
    assert cells(TilePackage(g, path).tiles(2, 4)) == want
    again = TilePackage(g, path)
    assert cells(again.tiles(2, 4)) == want and again.statistics()["hits"] == 1
    assert sorted(map(tuple, again.read((0, 0, 12, 10), 6, 5, 4).collect())) == sorted(map(tuple, view.read_view(g, (0, 0, 12, 10), 6, 5, 2, 4).collect()))


def test_stale_packages(spark, tmp_path):
    path = f"file://{tmp_path}/tiles"
    TilePackage(make(spark, rough), path).tiles(2, 4)
    other = make(spark, lambda r, c: 1.0)
    with pytest.raises(StaleQuery):
        TilePackage(other, path)
    p = TilePackage(other, path, on_stale="reset")
    assert {v for *_, v in cells(p.tiles(2, 4))} == {1.0} and p.statistics()["stale"] == 1
    with pytest.raises(InvalidArgument):
        TilePackage(other, path, on_corrupt="hope")


def test_corrupt_tiles_are_made_anew_and_compacted(spark, tmp_path):
    g, path = make(spark, rough), f"file://{tmp_path}/tiles"
    TilePackage(g, path).tiles(2, 4)
    want = cells(view.tile_table(g, 2, 4))
    held = len({w[:2] for w in want})
    # A record more than its sum knows of: one tile is wrong. One that no sum names isn't read at all.
    records = f"{path}/generation=0/records"
    spark.read.parquet(records).where("tile_row = 0 and tile_col = 0").limit(1).withColumn("r", F.lit(99).cast("long")).write.mode("append").parquet(records)
    spark.read.parquet(records).where("tile_row = 1").limit(1).withColumn("version", F.lit(9).cast("long")).write.mode("append").parquet(records)
    assert [tuple(r) for r in TilePackage(g, path).broken(2, 4).collect()] == [(0, 0)]
    with pytest.raises(CorruptedData):
        TilePackage(g, path).tiles(2, 4)
    p = TilePackage(g, path, on_corrupt="reset")
    assert cells(p.tiles(2, 4)) == want
    assert p.statistics() == {"hits": 1, "misses": 0, "stale": 0, "corrupted": 1, "records": held + 1, "tiles": held}
    p.compact()
    assert p.statistics()["records"] == held and cells(TilePackage(g, path).tiles(2, 4)) == want
    assert not glob.glob(f"{tmp_path}/tiles/generation=0")
