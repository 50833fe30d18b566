"""Components over tiles, and what is dealt by them, against one call for all."""

import random

import pytest
from pyspark.sql import functions as F

from orogen.operators import cdt, contour
from orogen.plans.components import components, numbered


def brute(links):
    low = {}

    def find(n):
        while low.setdefault(n, n) != n:
            n = low[n]
        return n

    for u, v, *_ in links:
        a, b = find(u), find(v)
        low[max(a, b)] = min(a, b)
    return {frozenset(n for n in low if find(n) == r) for r in {find(n) for n in low}}


def test_components_across_tiles(spark):
    r = random.Random(3)
    links = [(i, i + 1, i // 3) for i in range(200)]  # a chain through 67 tiles
    links += [(1000 + r.randrange(60), 1000 + r.randrange(60), r.randrange(9)) for _ in range(45)]
    links += [(2000, 2000, 1), (2000, 2000, 1)]
    links += [(3000, 3001 + i, i) for i in range(20)]  # one node in twenty tiles
    df = spark.createDataFrame(links, "u long, v long, tile int")
    got = {}
    rows = components(df, "u", "v", ["tile"]).collect()
    for x in rows:
        got.setdefault(x.component, set()).update((x.u, x.v))
    assert len(rows) == len(links) and set(map(frozenset, got.values())) == brute(links)
    assert components(df.where("false"), "u", "v", ["tile"]).count() == 0


def test_numbers_follow_the_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(40), i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "id", F.lit(7)).collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.id)] == sorted(rows) and {x.id for x in got} == set(range(8, 308))
    assert numbered(spark.createDataFrame([], "a int, b int"), ["a", "b"], "id", F.lit(7)).count() == 0


def segments(n, seed):
    """Closed and open lattice paths, some of which meet in a node, on two levels."""
    r, rows = random.Random(seed), set()
    for _ in range(n):
        x, y, level = r.randrange(40), r.randrange(40), float(r.randrange(2))
        for _ in range(r.randrange(1, 30)):
            dx, dy = r.choice([(1, 0), (0, 1), (-1, 0), (0, -1)])
            a, b = sorted([(x, y), (x + dx, y + dy)])
            rows.add((level, float(a[0]), float(a[1]), float(b[0]), float(b[1])))
            x, y = x + dx, y + dy
    return sorted(rows)


def test_lines_do_not_depend_on_tiles(spark, monkeypatch):
    rows = segments(25, 2)
    df = spark.createDataFrame(rows, "level double, x1 double, y1 double, x2 double, y2 double")
    read = lambda: sorted((x.level, x.line, x.closed, tuple((p.x, p.y) for p in x.pts)) for x in contour.stitch(df, 1e-6).collect())
    whole = read()
    monkeypatch.setattr(contour, "STITCHED", 12)
    assert read() == whole
    parts = [(v, *sorted(p)) for v, _, _, pts in whole for p in zip(pts, pts[1:])]
    assert sorted((v, *a, *b) for v, a, b in parts) == rows  # every segment once
    for level in (0.0, 1.0):
        assert sorted(x[1] for x in whole if x[0] == level) == list(range(sum(x[0] == level for x in whole)))
    assert contour.stitch(df.where("false"), 1e-6).count() == 0


@pytest.mark.parametrize("size", [1 << 15, 20])
def test_recovery_does_not_depend_on_calls(spark, monkeypatch, size):
    r = random.Random(11)
    pts = spark.createDataFrame([(i + 1, r.uniform(0, 100), r.uniform(0, 100), 0.0) for i in range(150)], "id long, x double, y double, z double")
    lines = [(c, 1, False, i, x, y, 0.0) for c, ends in enumerate([((2.0, 5.0), (45.0, 6.0)), ((55.0, 8.0), (96.0, 9.0)), ((3.0, 90.0), (60.0, 94.0)), ((20.0, 40.0), (80.0, 55.0)), ((80.0, 55.0), (85.0, 80.0))]) for i, (x, y) in enumerate(ends)]
    cons = spark.createDataFrame(lines, "cid long, kind int, closed boolean, seq long, x double, y double, z double")
    monkeypatch.setattr(cdt, "RECOVERED", size)
    m, marked, used = cdt.build(pts, cons)
    v = cdt.validate(m, marked, used).first()
    assert (v.crowded_edges, v.missing_segments, v.euler) == (0, 0, True)
    # Every triangle is constrained Delaunay: no corner across an edge that isn't a segment lies in its circle.
    place = {x.id: (x.x, x.y) for x in m.vertices.collect()}
    ids = {p: i for i, p in place.items()}
    fixed = {frozenset((ids[s.ax, s.ay], ids[s.bx, s.by])) for s in cdt.segments(used).collect()}
    across = {}
    for t in m.triangles.select("a", "b", "c").collect():
        for k in range(3):
            across.setdefault(frozenset(t[:k] + t[k + 1 :]), []).append((t, t[k]))
    for e, sides in across.items():
        if len(sides) == 2 and e not in fixed:
            (t, _), (_, d) = sides
            (ax, ay), (bx, by), (cx, cy) = ((place[i][0] - place[d][0], place[i][1] - place[d][1]) for i in t)
            turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
            det = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
            assert det * (1 if turn > 0 else -1) <= 1e-6
