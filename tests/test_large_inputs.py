"""What only larger tables bring: meeting contours, shared places, taken ids, many crossings."""

import random

import pytest
from pyspark.sql import functions as F

from orogen import catalog, fixtures
from orogen.errors import InvalidArgument
from orogen.operators import cdt, contour, convert, mesh
from orogen.plans.tiles import grid_for
from orogen.schema import GridMeta

LINE = "line_id long, elevation double, closed boolean, pts array<struct<x: double, y: double, z: double>>"


def crossing_lines(spark):
    line = lambda i, *pts: (i, i * 10.0, False, [(float(x), float(y), 0.0) for x, y in pts])
    return spark.createDataFrame([line(0, (0, 0), (2, 2)), line(1, (0, 2), (1, 1), (2, 0))], LINE)


def test_meeting_contours_keep_both_heights(spark):
    points = lambda **how: {(r.x, r.y, r.z) for r in contour.surface_points(crossing_lines(spark), 1.5, **how).collect()}
    own = {(0.0, 0.0, 0.0), (2.0, 2.0, 0.0), (0.0, 2.0, 10.0), (2.0, 0.0, 10.0)}
    assert points(meeting="keep") == own | {(1.0, 1.0, 0.0), (1.0, 1.0, 10.0)}
    assert points(meeting="middle") == own | {(1.0, 1.0, 5.0)}
    with pytest.raises(InvalidArgument):
        points()


def test_contour_points_where_lines_meet(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_lines", lambda *_: crossing_lines(spark).withColumn("pts", F.transform("pts", lambda p: F.struct((p["x"] * 3000).alias("x"), (p["y"] * 3000).alias("y"), p["z"].alias("z")))))
    rows = catalog.QUERIES["v4_contour_points"](spark, "").collect()
    assert sorted((r.x, r.y, r.z) for r in rows if r.x == 3000) == [(3000, 3000, 0), (3000, 3000, 10)]


def sticks(spark, n, seed):
    r = random.Random(seed)
    ends = [(r.randrange(1000), r.randrange(1000), *(r.choice([(r.randrange(1000), r.randrange(1000)), (500, r.randrange(1000)), (r.randrange(1000), 250)]))) for _ in range(n)]
    ends = [(a, b, c, d) for a, b, c, d in ends if (a, b) != (c, d)] + [(0, 0, 900, 900), (300, 300, 700, 700), (100, 100, 200, 200), (500, 0, 500, 1000), (500, 999, 500, 400), (0, 1000, 1000, 0)]
    return ends, spark.createDataFrame([(i, float(a), float(b), 0.0, float(c), float(d), 0.0) for i, (a, b, c, d) in enumerate(ends)], "sid long, ax double, ay double, az double, bx double, by double, bz double")


def test_meetings_are_found_once_and_never_broadcast(spark, monkeypatch):
    ends, df = sticks(spark, 400, 5)
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    cross, over = [], []
    for i, (*p, a, b) in enumerate(ends):
        q = (a, b)
        for j in range(i + 1, len(ends)):
            r, s = ends[j][:2], ends[j][2:]
            o = [side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)]
            if (q[0] - p[0]) * (s[1] - r[1]) != (q[1] - p[1]) * (s[0] - r[0]):
                if o[0] * o[1] <= 0 and o[2] * o[3] <= 0 and not {tuple(p), q} & {r, s}:
                    cross.append((i, j))
            elif o[0] == 0 and max(min(tuple(p), q), min(r, s)) < min(max(tuple(p), q), max(r, s)):
                over.append((i, j))
    pairs = lambda rows: sorted((x.sid_a, x.sid_b) for x in rows)
    assert pairs(cdt.crossings(df).collect()) == cross and len(cross) > 10_000
    assert pairs(cdt.overlaps(df).collect()) == over and len(over) > 2
    monkeypatch.setattr(cdt, "MET", 7)  # crowded tiles, dealt by pairs of blocks
    assert pairs(cdt.crossings(df).collect()) == cross and pairs(cdt.overlaps(df).collect()) == over
    assert "Join" not in cdt.crossings(df)._jdf.queryExecution().toString()


def test_a_segment_is_listed_where_it_passes(spark):
    """Boxes of long segments cover the square of the tiles that the segments pass: at 30,000 segments, more than a driver holds."""
    ends, df = sticks(spark, 400, 6)
    tiles = grid_for(10_000, 0, 0, 1000, 1000, 4)
    assert cdt.passed(df, tiles).count() < 1.2 * sum(1 + (abs(a - c) + abs(b - d)) / 20 for a, b, c, d in ends)


def test_grid_from_contours_that_meet(spark):
    meta = GridMeta(3, 3, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    got = {(r.row, r.col): r.z for r in convert.grid_from_contours(crossing_lines(spark), meta, 1.5, meeting="middle").df.collect()}
    assert got == {(0, 0): 0, (0, 1): 5, (0, 2): 10, (1, 0): 5, (1, 1): 5, (1, 2): 5, (2, 0): 10, (2, 1): 5, (2, 2): 0}
    with pytest.raises(InvalidArgument):
        convert.grid_from_contours(crossing_lines(spark), meta, 1.5)


def test_customers_that_share_a_place_are_one_vertex(spark, tmp_path):
    keys = [*range(30), 12479, 89610]  # the last two share a place
    spark.createDataFrame([(k, k * 1.5) for k in keys], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.a, r.b, r.c) for r in catalog.QUERIES["t1_delaunay_tiled"](spark, str(tmp_path)).collect()}
    points = fixtures.customers(spark, str(tmp_path)).where("id <> 89611")
    assert got == {(r.a, r.b, r.c) for r in mesh.build(points).triangles.collect()}
    assert {i for t in got for i in t} == {*range(1, 31), 12480}
    with pytest.raises(InvalidArgument):
        mesh.build(fixtures.customers(spark, str(tmp_path)))


def test_an_added_constraint_leaves_the_one_of_its_id(spark):
    rows = lambda *r: spark.createDataFrame([(c, 1, False, s, float(x), 0.0, 0.0) for c, s, x in r], "cid long, kind int, closed boolean, seq long, x double, y double, z double")
    log = lambda *r: spark.createDataFrame([(o, op, c, 1, False, 0, float(x), 0.0, 0.0) for o, op, c, x in r], "order long, op string, cid long, kind int, closed boolean, seq long, x double, y double, z double")
    edits = log((1, "add", 1, 5), (2, "add", 2, 6), (3, "update", 2, 7), (4, "add", 2, 8), (5, "remove", 3, 0), (6, "add", 3, 9), (7, "update", 4, 1), (8, "remove", 4, 0), (9, "add", 5, 2))
    got = sorted((r.cid, r.x) for r in cdt.apply_edits(rows((1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (6, 0, 3)), edits).collect())
    assert got == [(1, 0), (1, 5), (2, 7), (2, 8), (3, 9), (5, 2), (6, 3)]


def test_noding_joins_nothing_and_keeps_no_crossings(spark):
    lines = [((0, 0), (8, 8)), ((0, 8), (8, 0)), ((4, 0), (4, 8)), ((0, 2), (8, 2))]  # three meet in (4, 4)
    rows = [(c, 1, False, s, float(x), float(y), 0.0) for c, line in enumerate(lines) for s, (x, y) in enumerate(line)]
    out = cdt.noded(spark.createDataFrame(rows, "cid long, kind int, closed boolean, seq long, x double, y double, z double"), policy="split")
    assert "Join" not in out._jdf.queryExecution().toString() and out.storageLevel.useMemory is False
    got = sorted((r.cid, r.seq, r.x, r.y) for r in out.collect() if (r.kind, r.closed) == (1, False))
    want = [[(0, 0), (2, 2), (4, 4), (8, 8)], [(0, 8), (4, 4), (6, 2), (8, 0)], [(4, 0), (4, 2), (4, 4), (4, 8)], [(0, 2), (2, 2), (4, 2), (6, 2), (8, 2)]]
    assert got == [(c, i, x, y) for c, line in enumerate(want) for i, (x, y) in enumerate(line)]


def sql_rows(name, keys, folder):
    """What the query's SQL gives of suppliers with these keys, and a folder with their table for the query itself."""
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        con.sql(f"create table supplier as select unnest({keys})::bigint as s_suppkey, 0e0 as s_acctbal")
        con.sql(f"copy supplier to '{folder}/supplier.parquet'")
        return sorted(con.sql(catalog.ORACLE_SQL[name]).fetchall())


def test_noding_keeps_an_end_that_lies_on_another_segment(spark, tmp_path):
    """Of the pairs of 60,000 suppliers two have an end on another's segment: 3427 on 25333, 28841 on 25277."""
    want = sql_rows("c8_noding", [k for c in (3427, 25277, 25333, 28841) for k in (2 * c - 2, 2 * c - 1)], tmp_path)
    assert [r[1] for r in want if r[0] == 3427 and r[2:] == (70899.0, 59431.0)] == [1, 2]
    assert sorted(map(tuple, catalog.QUERIES["c8_noding"](spark, str(tmp_path)).collect())) == want


def test_noding_keeps_each_meeting(spark):
    lines = [((0, 0), (8, 8)), ((0, 8), (8, 0)), ((4, 0), (4, 8)), ((0, 0), (0, 8)), ((0, 8), (8, 8), (9, 20))]  # three meet in (4, 4), others at their ends
    rows = [(c, 1, False, s, float(x), float(y), 0.0) for c, line in enumerate(lines) for s, (x, y) in enumerate(line)]
    out = cdt.noded(spark.createDataFrame(rows, "cid long, kind int, closed boolean, seq long, x double, y double, z double"), policy="split", meeting="keep")
    got = sorted((r.cid, r.seq, r.x, r.y) for r in out.collect() if (r.kind, r.closed) == (1, False))
    want = [[(0, 0), (0, 0), (4, 4), (4, 4), (8, 8), (8, 8), (8, 8)], [(0, 8), (0, 8), (0, 8), (4, 4), (4, 4), (8, 0)], [(4, 0), (4, 4), (4, 4), (4, 8), (4, 8)], [(0, 0), (0, 0), (0, 8), (0, 8), (0, 8)], [(0, 8), (0, 8), (0, 8), (4, 8), (8, 8), (8, 8), (8, 8), (9, 20)]]
    assert got == [(c, i, x, y) for c, line in enumerate(want) for i, (x, y) in enumerate(line)]
    with pytest.raises(InvalidArgument):
        cdt.noded(out, meeting="twice")
