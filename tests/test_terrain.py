"""Closed-form answers of the terrain operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument, NotFound
from orogen.functions import crs
from orogen.functions.predicates import Delaunay, Plane
from orogen.operators import cdt, contour, convert, earthwork, grid, measure, mesh, registration, view
from orogen.schema import Grid, GridMeta
from orogen.sources import text

UNIT = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def make(spark, values, gt=UNIT):
    rows = [(r, c, None if v is None else float(v)) for r, row in enumerate(values) for c, v in enumerate(row)]
    return Grid(spark.createDataFrame(rows, "row long, col long, z double"), GridMeta(len(values[0]), len(values), gt))


def heights(g):
    return {(r["row"], r["col"]): r["z"] for r in g.df.collect()}


def test_earthwork_constant(spark):
    gt = (100.0, 2.0, 0.0, 200.0, 0.0, 3.0)
    s = earthwork.summary(make(spark, [[10] * 3] * 3, gt), make(spark, [[8] * 3] * 3, gt)).first()
    assert (s.total_plan_area, s.cut_volume, s.fill_volume, s.rmse_difference, s.valid_triangle_count) == (24, 48, 0, 2, 8)


def test_earthwork_crossing(spark):
    s = earthwork.summary(make(spark, [[1, -1], [-1, 1]]), make(spark, [[0, 0], [0, 0]])).first()
    assert s.cut_volume == pytest.approx(5 / 12) and s.fill_volume == pytest.approx(1 / 12) and s.net_volume == pytest.approx(1 / 3) and s.rmse_difference == pytest.approx(math.sqrt(1 / 3))


def test_earthwork_missing_node(spark):
    a, b = make(spark, [[1, None], [1, 1]]), make(spark, [[0, 0], [0, 0]])
    strict, part = earthwork.summary(a, b).first(), earthwork.summary(a, b, partial=True).first()
    assert (strict.valid_triangle_count, strict.skipped_triangle_count, strict.mean_difference) == (0, 2, None)
    assert (part.valid_triangle_count, part.skipped_triangle_count, part.coverage_ratio, part.cut_volume) == (1, 1, 0.5, 0.5)


def test_earthwork_rotated(spark):
    gt = (500000.0, 2.0, 1.0, 3200000.0, -1.0, 3.0)
    s = earthwork.summary(make(spark, [[5, 5]] * 2, gt), make(spark, [[3, 3]] * 2, gt)).first()
    assert (s.total_plan_area, s.cut_volume) == (7, 14)


def test_overview(spark):
    v = [[10 * r + c for c in range(6)] for r in range(4)]
    v[0][1] = v[3][5] = None
    g = make(spark, v)
    avg = {(r.bin_row, r.bin_col): r.value for r in grid.overview(g, 3, 2).collect()}
    assert [avg[k] for k in sorted(avg)] == pytest.approx([7, 7.5, 9.5, 25.5, 27.5, 83 / 3])
    s = grid.overview_statistics(g).first()
    assert (s.valid, s.nodata) == (22, 2) and s["mean"] == pytest.approx(384 / 22)
    near = {(r.bin_row, r.bin_col): r.value for r in grid.overview(g, 3, 2, "nearest").collect()}
    assert [near[k] for k in sorted(near)] == [11, 13, 15, 31, 33, None]


def test_clip(spark):
    gt = (100.0, 2.0, 0.5, 200.0, -0.25, 1.5)
    g = make(spark, [[100 * r + c for c in range(6)] for r in range(5)], gt)
    ring = [g.meta.world(c, r) for c, r in ((1, 1), (4, 1), (4, 3), (1, 3))]
    assert sum(v is not None for v in heights(grid.clip(g, ring)).values()) == 12
    assert sum(v is not None for v in heights(grid.clip(g, ring, invert=True)).values()) == 18
    small = grid.clip(g, ring, crop=True)
    assert (small.meta.width, small.meta.height) == (4, 3) and heights(small)[0, 0] == 101


def test_view_window():
    m = GridMeta(10, 8)
    assert view.view_window(m, 2.2, 1.2, 5.8, 4.8) == ((2, 1, 5, 5), False)
    with pytest.raises(NotFound):
        view.view_window(m, 100, 100, 110, 110)


def test_resample_plane(spark):
    gt = (100.0, 2.0, 0.5, 200.0, -0.25, 1.5)
    m = GridMeta(4, 4, gt)
    g = make(spark, [[2 * m.world(c, r)[0] - 3 * m.world(c, r)[1] + 5 for c in range(4)] for r in range(4)], gt)
    x, y = m.world(0.25, 0.5)
    t = GridMeta(5, 4, (x, 1.0, 0.25, y, -0.125, 0.75))
    for r in grid.positions(grid.resample(g, t)).collect():
        assert r.z == pytest.approx(2 * r.x - 3 * r.y + 5)
    hole = make(spark, [[0, 2], [4, None]])
    middle = GridMeta(1, 1, (0.5, 1.0, 0.0, 0.5, 0.0, 1.0))
    assert heights(grid.resample(hole, middle))[0, 0] is None
    assert heights(grid.resample(hole, middle, renormalize=True))[0, 0] == 2


def test_exact_clip(spark):
    pts = spark.createDataFrame([(i + 1, float(x), float(y), float(x + 2 * y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])], "id long, x double, y double, z double")
    got = convert.clip_exact(mesh.build(pts).triangles, [(0, 0), (4, 0), (4, 4), (0, 4)], [[(1, 1), (3, 1), (3, 3), (1, 3)]]).collect()
    assert sum(r.area for r in got) == pytest.approx(12)
    assert all(p.z == pytest.approx(p.x + 2 * p.y) for r in got for ring in r.rings for p in ring.pts)


def test_registration(spark):
    gt = (0.0, 0.5, 0.0, 0.0, 0.0, 0.5)
    f = lambda x, y: 0.05 * x * x + 0.03 * y * y + 0.02 * x * y + 0.1 * x
    ref = make(spark, [[f(c / 2, r / 2) for c in range(21)] for r in range(21)], gt)
    mov = make(spark, [[f(c / 2 + 1, r / 2 - 0.5) - 2 for c in range(21)] for r in range(21)], gt)
    r = registration.register(ref, mov, most=2.0, least=0.5, budget=256, minimum=32)
    assert (r.dx, r.dy) == (1.0, -0.5) and r.dz == pytest.approx(2, abs=0.05) and r.rmse_after < 0.05


def test_noding_heights(spark):
    rows = [(1, 1, False, 0, 0.0, 0.0, 0.0), (1, 1, False, 1, 10.0, 10.0, 10.0), (2, 1, False, 0, 0.0, 10.0, 10.0), (2, 1, False, 1, 10.0, 0.0, 0.0)]
    c = spark.createDataFrame(rows, "cid long, kind int, closed boolean, seq long, x double, y double, z double")
    got = cdt.noded(c, policy="split").where("cid = 1").orderBy("seq").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(0, 0, 0), (5, 5, 5), (10, 10, 10)]
    with pytest.raises(InvalidArgument):
        cdt.noded(c)
    with pytest.raises(InvalidArgument):
        cdt.noded(c.withColumn("z", F.when(F.col("cid") == 1, 100.0).otherwise(F.col("z"))), policy="split")


def test_constrained_plane(spark):
    pts = spark.createDataFrame([(r * 7 + c + 1, float(c), float(r), 100.0 + 2 * c + 3 * r) for r in range(7) for c in range(7)], "id long, x double, y double, z double")
    ring = lambda cid, kind, a, b: [(cid, kind, True, i, float(x), float(y), 100.0 + 2 * x + 3 * y) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    cons = spark.createDataFrame(ring(1, 2, 0, 6) + ring(2, 3, 2, 4), "cid long, kind int, closed boolean, seq long, x double, y double, z double")
    _, marked, _ = cdt.build(pts, cons)
    asked = spark.createDataFrame([(1, 1.2, 1.4), (2, 3.0, 3.0)], "qid long, x double, y double")
    got = {r.qid: r for r in cdt.sample(marked, asked).collect()}
    assert got[1].z == pytest.approx(106.6) and got[1].dz_dx == pytest.approx(2) and got[1].dz_dy == pytest.approx(3) and got[2].z is None


def test_segment_recovery(spark):
    random.seed(4)
    rows = [(i + 1, float(random.randrange(1000)), float(random.randrange(1000)), 0.0) for i in range(120)]
    rows = list({(x, y): (i, x, y, z) for i, x, y, z in rows}.values())
    pts = spark.createDataFrame(rows, "id long, x double, y double, z double")
    line = [(1, 1, False, 0, -5.0, 3.0, 0.0), (1, 1, False, 1, 1005.0, 990.0, 0.0), (2, 1, False, 0, -5.0, 400.0, 0.0), (2, 1, False, 1, 420.0, 300.0, 0.0)]
    cons = spark.createDataFrame(line, "cid long, kind int, closed boolean, seq long, x double, y double, z double")
    m, marked, used = cdt.build(pts, cons, policy="split")
    ends = {(r.x, r.y): r.id for r in m.vertices.collect()}
    have = {(r.u, r.v) for r in mesh.edges(m).collect()}
    for s in cdt.segments(used).collect():
        assert tuple(sorted((ends[s.ax, s.ay], ends[s.bx, s.by]))) in have
    hull = mesh.edges(m).where("faces = 1").count()
    assert m.triangles.count() == 2 * m.vertices.count() - 2 - hull and marked.count() == m.triangles.count()


def test_delaunay_edits_keep_the_mesh_sound(spark):
    random.seed(9)
    pts = spark.createDataFrame([(i + 1, random.uniform(-100, 100), random.uniform(-100, 100), 0.0) for i in range(60)], "id long, x double, y double, z double")
    m = mesh.build(pts)
    m, _ = mesh.insert_point(m, 3.5, 4.5, 1.0)
    m, _ = mesh.delete_vertex(m, 17)
    v = mesh.validate(m).first()
    assert (v.crowded_edges, v.not_delaunay, v.euler) == (0, 0, True)
    with pytest.raises(InvalidArgument):
        mesh.insert_point(m, 3.5, 4.5, 2.0)


def test_tiles_agree_with_one_kernel(spark):
    random.seed(2)
    rows = [(i + 1, random.uniform(0, 50), random.uniform(0, 50), 0.0) for i in range(900)]
    pts = spark.createDataFrame(rows, "id long, x double, y double, z double")
    one = {(r.a, r.b, r.c) for r in mesh.build(pts).triangles.collect()}
    many = {(r.a, r.b, r.c) for r in mesh.build(pts, tile_points=30).triangles.collect()}
    assert one == many


def test_cocircular_ties_do_not_depend_on_order():
    import numpy as np

    cells = [(x, y) for x in range(6) for y in range(6)]
    found = []
    for seed in range(3):
        order = list(range(36))
        random.Random(seed).shuffle(order)
        p = Plane([i + 1 for i in order], np.array([cells[i][0] for i in order], float), np.array([cells[i][1] for i in order], float))
        found.append({tuple(sorted(order[k] for k in t)) for t in Delaunay(p).triangles()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 50


def test_profile_statistics(spark):
    rows = [(0, 0.0, 0.0), (1, 5.0, 5.0), (2, 10.0, 1.0), (3, 15.0, None), (4, 20.0, 2.0)]
    s = measure.profile_statistics(spark.createDataFrame(rows, "idx int, distance double, z double")).first()
    assert (s.valid_count, s.sampled_distance, s.ascent, s.descent, s.maximum_grade_percent) == (4, 10, 5, 4, 100)


def test_polygons():
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 0.5), (0.0, 1.0)]
    assert measure.is_simple(ring) and len(measure.ears(ring)) == 3
    assert not measure.is_simple([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)])
    assert measure.nice_interval(100) == 10.0 and measure.nice_interval(0) == 1.0


def test_polygon_volume(spark):
    g = make(spark, [[x + y for x in range(3)] for y in range(3)])
    s = measure.polygon_volume(g, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], 0.0, 200).first()
    assert s.surface_area == pytest.approx(math.sqrt(3)) and s.mean_z == pytest.approx(1) and s.cut_volume == pytest.approx(1)


def test_contours_of_a_cone_close(spark):
    g = make(spark, [[math.hypot(c - 5, r - 5) for c in range(11)] for r in range(11)])
    lines = contour.stitch(contour.from_grid(g, explicit=[2.5]), 1e-9).collect()
    assert len(lines) == 1 and lines[0].closed and lines[0].pts[0] == lines[0].pts[-1]


def test_levels():
    assert contour.levels(2.0, 9.0, 3.0, 1.0) == [4.0, 7.0]
    assert contour.levels(0, 0, explicit=[5, 1, 5]) == [1.0, 5.0]


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(1, 116.4, 39.9), (2, 118.9, -0.5)], "id long, x double, y double")
    back = crs.transform_points(crs.transform_points(df, "EPSG:4326", "EPSG:32650"), "EPSG:32650", "EPSG:4326")
    for a, b in zip(df.orderBy("id").collect(), back.orderBy("id").collect(), strict=True):
        assert (a.x, a.y) == pytest.approx((b.x, b.y), abs=1e-8)
    assert crs.is_same("4326", "WGS84") and not crs.is_same("EPSG:4326", "EPSG:3857")


def test_xyz_reader(spark, tmp_path):
    p = tmp_path / "a.xyz"
    p.write_text("# head\n1 2 3\n4,5;6 # tail\n\n7\t8\t9e1\n")
    assert sorted((r.x, r.y, r.z) for r in text.read_xyz(spark, str(p)).collect()) == [(1, 2, 3), (4, 5, 6), (7, 8, 90)]
    p.write_text("1 2\n")
    with pytest.raises(Exception, match="not three numbers"):
        text.read_xyz(spark, str(p)).collect()


def test_ascii_grid(spark, tmp_path):
    p = tmp_path / "a.asc"
    p.write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -1\n1 2 3\n4 -1 6\n")
    g = text.read_ascii_grid(spark, str(p))
    assert g.meta.gt == (11.0, 2.0, 0.0, 23.0, 0.0, -2.0) and heights(g)[1, 1] is None and heights(g)[0, 2] == 3


def test_argument_errors(spark):
    with pytest.raises(InvalidArgument):
        GridMeta(2, 2, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    with pytest.raises(InvalidArgument):
        mesh.build(spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0)], "id long, x double, y double, z double"))
