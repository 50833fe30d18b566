"""Overlapping constraints, edge samples, checksums and ASCII grids on small tables."""

import pytest

from orogen.errors import InvalidArgument
from orogen.operators import cdt, grid, view
from orogen.schema import Grid, GridMeta
from orogen.sources import tables, text

CONS = "cid long, kind int, closed boolean, seq long, x double, y double, z double"


def constraints(spark, *lines):
    rows = [(c + 1, 1, False, i, float(x), float(y), 0.0) for c, line in enumerate(lines) for i, (x, y) in enumerate(line)]
    return spark.createDataFrame(rows, CONS)


def test_overlapping_constraints_are_refused(spark):
    for other in ([(2, 0), (6, 0)], [(6, 0), (2, 0)], [(1, 0), (3, 0)], [(-1, 0), (9, 0)]):
        for policy in ("reject", "split"):
            with pytest.raises(InvalidArgument, match="overlap"):
                cdt.noded(constraints(spark, [(0, 0), (4, 0)], other), policy=policy)
    for other in ([(4, 0), (8, 0)], [(5, 0), (8, 0)], [(0, 1), (4, 1)], [(0, 0), (4, 0)], [(0, 0), (0, 4)]):
        assert cdt.noded(constraints(spark, [(0, 0), (4, 0)], other), policy="reject").count() == 4


def test_grids_of_one_row_or_column(spark):
    line = [(i, float(z)) for i, z in enumerate((10, 20, 40))]
    asked = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 2.0, 0.0), (3, 2.5, 0.0), (4, 1.0, 0.5), (5, 0.0, 0.5)], "qid long, x double, y double")
    row = Grid(spark.createDataFrame([(0, c, z) for c, z in line], "row long, col long, z double"), GridMeta(3, 1))
    assert {r.qid: r.z for r in grid.sample_edges(row, asked).collect()} == {0: 10.0, 1: 15.0, 2: 40.0, 3: None, 4: None, 5: None}
    column = Grid(spark.createDataFrame([(r, 0, z) for r, z in line], "row long, col long, z double"), GridMeta(1, 3))
    assert {r.qid: r.z for r in grid.sample_edges(column, asked).collect()} == {0: 10.0, 1: None, 2: None, 3: None, 4: None, 5: 15.0}
    one = Grid(spark.createDataFrame([(0, 0, 7.0)], "row long, col long, z double"), GridMeta(1, 1))
    assert {r.qid: r.z for r in grid.sample_edges(one, asked).collect() if r.z is not None} == {0: 7.0}


def test_changed_constraints_are_found(spark, tmp_path):
    held = constraints(spark, [(0, 0), (1, 1)], [(2, 2), (3, 3)], [(4, 4), (5, 5)])
    p = str(tmp_path / "cons")
    tables.save_constraints(held, p)
    assert tables.verify_constraints(spark, p).count() == 0 and tables.load_constraints(spark, p).count() == 6
    tables.save_constraints(held.where("cid <> 2"), p + "2")
    held.where("cid <> 2").write.parquet(f"{tmp_path}/lost")
    spark.read.parquet(p + ".sums").write.parquet(f"{tmp_path}/lost.sums")
    assert [r.cid for r in tables.verify_constraints(spark, f"{tmp_path}/lost").collect()] == [2]
    with pytest.raises(InvalidArgument, match="checksum"):
        tables.load_constraints(spark, f"{tmp_path}/lost")


def test_ascii_grid_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, None if r == c else r * 10.0 + c) for r in range(3) for c in range(4)], "row long, col long, z double")
    south_up = Grid(cells, GridMeta(4, 3, (5.0, 2.0, 0.0, 7.0, 0.0, 2.0)))
    text.write_ascii_grid(south_up, str(tmp_path / "a"))
    back = text.read_ascii_grid(spark, str(tmp_path / "a"))
    where = lambda g: {(r.x, r.y): r.z for r in grid.positions(g).collect()}
    assert where(back) == where(south_up)
    with pytest.raises(InvalidArgument):
        text.write_ascii_grid(Grid(cells, GridMeta(4, 3, (0.0, 1.0, 0.5, 0.0, 0.0, 1.0))), str(tmp_path / "b"))


def test_geojson_sequences(spark, tmp_path):
    """Properties rule over heights; other features and blank lines are skipped; parts are told apart."""
    lines = [
        '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,2]]},"properties":{"elevation":5,"line_id":3}}', "",
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[4,4]},"properties":{}}',
        '{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0,7],[1,0,7]],[[2,2,8],[3,2,8],[2,2,8]]]},"properties":{"line_id":4}}',
    ]
    (tmp_path / "a.geojsonl").write_text("\n".join(lines))
    got = sorted((r.line_id, r.part, r.elevation, r.closed, len(r.pts), r.pts[1].z) for r in text.read_geojson_sequence(spark, str(tmp_path)).collect())
    assert got == [(3, 0, 5.0, False, 2, 5.0), (4, 0, 7.0, False, 2, 7.0), (4, 1, 8.0, True, 3, 8.0)]


def test_view_cache_limits(spark):
    g = Grid(spark.createDataFrame([(r, c, float(r * c % 7)) for r in range(40) for c in range(40)], "row long, col long, z double"), GridMeta(40, 40))
    window, read = (0, 0, 40, 40), lambda cache, width: sorted(map(tuple, cache.read(g, window, width, width, 16).collect()))
    cache = view.ViewCache()
    first = read(cache, 20)
    size = cache.statistics()["bytes"]
    assert size > 0 and read(cache, 20) == first and cache.statistics() == {"hits": 1, "misses": 1, "tables": 1, "bytes": size}
    read(cache, 5)
    assert cache.statistics()["tables"] == 2 and cache.statistics()["bytes"] > size
    tight = view.ViewCache(most_bytes=size)
    read(tight, 5)
    assert read(tight, 20) == first and tight.statistics()["tables"] == 1  # the smaller table, used longer ago, went
    none = view.ViewCache(most_bytes=1)
    assert read(none, 20) == first and none.statistics() == {"hits": 0, "misses": 1, "tables": 0, "bytes": 0}
    cache.clear(), tight.clear()
