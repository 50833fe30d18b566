"""Triangulated surfaces: building, editing, lookup and checks.

Triangles are rows (a, b, c) of ascending ids with their corners' coordinates,
so that queries need no join with the vertices.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orogen import scratch
from orogen.errors import EmptySurface, InvalidArgument, NotFound
from orogen.functions.geometry import aspect_degrees, num, orient, slope_degrees
from orogen.functions.predicates import Delaunay, Plane, whole
from orogen.plans.tiles import Tiles, covered, grid_for
from orogen.schema import EPS, Mesh

CORNERS = tuple(f"{k}{d}" for k in "abc" for d in "xyz")
SCHEMA = "a long, b long, c long, " + ", ".join(f"{c} double" for c in CORNERS)
#: Points of a tile, about.
TILE_POINTS = 2_000


def _faces(pdf: pd.DataFrame, triangles: list[tuple[int, int, int]]) -> pd.DataFrame:
    ids, xyz = pdf["id"].to_numpy(), pdf[["x", "y", "z"]].to_numpy()
    at = np.array(triangles, dtype=np.int64).reshape(-1, 3)
    at = np.take_along_axis(at, np.argsort(ids[at], axis=1), axis=1)
    out = pd.DataFrame(ids[at], columns=list("abc"))
    for k, name in enumerate("abc"):
        for d, axis in enumerate("xyz"):
            out[name + axis] = xyz[at[:, k], d]
    return out


def _plane(pdf: pd.DataFrame) -> Plane:
    return Plane(pdf["id"].tolist(), pdf["x"].to_numpy(), pdf["y"].to_numpy())


def checked_points(points: DataFrame) -> DataFrame:
    """Refuses points that aren't finite or share their place with another. One aggregation."""
    bad = points.where(~(F.abs("x") < float("inf")) | ~(F.abs("y") < float("inf")) | ~(F.abs("z") < float("inf")) | F.isnan("x") | F.isnan("y") | F.isnan("z") | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull())
    if bad.limit(1).count():
        raise InvalidArgument("points must be finite")
    if points.groupBy("x", "y").count().where("count > 1").limit(1).count():
        raise InvalidArgument("two points have the same XY")
    return points


def build(points: DataFrame, crs: str = "", *, tile_points: int = TILE_POINTS) -> Mesh:
    """The Delaunay mesh of points (id, x, y, z).

    Each tile triangulates its own and its neighbours' points. A triangle whose
    circumcircle lies where the tile knows all points is right for the whole;
    the vertices whose surroundings stay open (near the hull, mostly) are
    triangulated once more and fill the gaps between the certified triangles.
    """
    points = checked_points(points.select("id", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    n, x0, y0, x1, y1 = points.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n:
        return Mesh(points, points.sparkSession.createDataFrame([], SCHEMA), crs)
    side = max(1, math.ceil(math.sqrt(n / tile_points)))
    if side <= 3:
        whole_ = points.groupBy(F.lit(0).alias("tile")).applyInPandas(lambda pdf: _faces(pdf, Delaunay(_plane(pdf)).triangles()), SCHEMA)
        return Mesh(points, whole_, crs)
    tiles = Tiles(x0, y0, max((x1 - x0) / side, 1e-300), max((y1 - y0) / side, 1e-300), side, side)
    homes = points.select("*", tiles.column(F.col("x")).alias("tc"), tiles.row(F.col("y")).alias("tr"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    halo = homes.withColumn("n", F.explode(around)).select("id", "x", "y", "z", (F.col("tr") + F.col("n.i")).alias("tr"), (F.col("tc") + F.col("n.j")).alias("tc"))
    halo = halo.where(F.col("tr").between(0, side - 1) & F.col("tc").between(0, side - 1))

    def certified(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = key
        faces = _faces(pdf, Delaunay(_plane(pdf)).triangles())
        cx, cy, r = circumcircle(*(faces[c].to_numpy() for c in ("ax", "ay", "bx", "by", "cx", "cy")))
        low_x = x0 + (col - 1) * tiles.width if col > 1 else -np.inf
        high_x = x0 + (col + 2) * tiles.width if col < side - 2 else np.inf
        low_y = y0 + (row - 1) * tiles.height if row > 1 else -np.inf
        high_y = y0 + (row + 2) * tiles.height if row < side - 2 else np.inf
        r = r * (1 + 1e-9) + 1e-9 * (abs(x1 - x0) + abs(y1 - y0))
        return faces[(cx - r >= low_x) & (cx + r <= high_x) & (cy - r >= low_y) & (cy + r <= high_y)]

    # Read four times; written, so that lost executors don't triangulate again.
    sure = scratch.stored(halo.groupBy("tr", "tc").applyInPandas(certified, SCHEMA).dropDuplicates(["a", "b", "c"]), "certified")
    edges = directed(sure)
    border = edges.join(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")
    inner = sure.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    open_ids = border.select(F.col("u").alias("id")).union(border.select("v")).union(points.select("id").join(inner, "id", "left_anti")).distinct()
    rest = points.join(open_ids, "id")

    def fill(key: tuple, pdf: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return _faces(pdf, [])
        mesh, place = Delaunay(_plane(pdf)), {i: k for k, i in enumerate(pdf["id"])}
        found = mesh.filled([(place[v], place[u]) for u, v in zip(marks["u"], marks["v"], strict=True)]) if len(marks) else mesh.triangles()
        return _faces(pdf, found)

    # What is open grows with the hull, not with the points.
    gaps = rest.groupBy(F.lit(0).alias("g")).cogroup(border.groupBy(F.lit(0).alias("g"))).applyInPandas(fill, SCHEMA)
    return Mesh(points, sure.unionByName(gaps).dropDuplicates(["a", "b", "c"]), crs)


def circumcircle(ax, ay, bx, by, cx, cy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii; infinite radii of degenerate triangles."""
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 2 * (bx * cy - by * cx)
        x = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        y = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    r = np.hypot(x, y)
    return ax + x, ay + y, np.where(np.isfinite(r), r, np.inf)


def directed(triangles: DataFrame) -> DataFrame:
    """(u, v, w): the edges of each triangle with the triangle on their left."""
    ccw = orient(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))) > 0
    e = lambda u, v, w: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(w).alias("w"))
    return triangles.select(F.explode(F.when(ccw, F.array(e("a", "b", "c"), e("b", "c", "a"), e("c", "a", "b"))).otherwise(F.array(e("b", "a", "c"), e("c", "b", "a"), e("a", "c", "b")))).alias("e")).select("e.*")


def edges(mesh: Mesh) -> DataFrame:
    """(u, v, faces) of every edge, u < v."""
    pair = lambda p, q: F.struct(F.col(p).alias("u"), F.col(q).alias("v"))
    e = mesh.triangles.select(F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("e"))
    return e.groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("faces"))


def statistics(mesh: Mesh) -> DataFrame:
    """One row: dimension (-1 to 2), counts, generation and XY bounds."""
    v = mesh.vertices.agg(F.count(F.lit(1)).alias("vertex_count"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    t = mesh.triangles.agg(F.count(F.lit(1)).alias("face_count"))
    dim = F.when(F.col("face_count") > 0, 2).otherwise(F.least(F.col("vertex_count") - 1, F.lit(1))).cast("int")
    return v.join(F.broadcast(t)).select(dim.alias("dimension"), "vertex_count", "face_count", F.lit(mesh.generation).cast("long").alias("generation"), "xmin", "ymin", "xmax", "ymax")


@F.pandas_udf(T.BooleanType())
def in_circle(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, px: pd.Series, py: pd.Series) -> pd.Series:
    """Whether p is strictly inside the circle of a, b, c (in either turn), exactly."""
    s = [v.to_numpy(dtype=np.float64) for v in (ax, ay, bx, by, cx, cy, px, py)]
    x1, y1, x2, y2, x3, y3 = (s[i] - s[6 + i % 2] for i in range(6))
    det = (x1 * x1 + y1 * y1) * (x2 * y3 - y2 * x3) - (x2 * x2 + y2 * y2) * (x1 * y3 - y1 * x3) + (x3 * x3 + y3 * y3) * (x1 * y2 - y1 * x2)
    turn = (s[2] - s[0]) * (s[5] - s[1]) - (s[3] - s[1]) * (s[4] - s[0])
    size = (x1 * x1 + y1 * y1) * (np.abs(x2 * y3) + np.abs(y2 * x3)) + (x2 * x2 + y2 * y2) * (np.abs(x1 * y3) + np.abs(y1 * x3)) + (x3 * x3 + y3 * y3) * (np.abs(x1 * y2) + np.abs(y1 * x2))
    out = det * np.sign(turn) > 0
    for i in np.flatnonzero((np.abs(det) <= 1e-14 * size) | (np.abs(turn) <= 1e-14 * np.abs((s[2] - s[0]) * (s[5] - s[1])))):
        a, b, c, d, e, f, p, q = whole(np.array([v[i] for v in s]))
        a, b, c, d, e, f = a - p, b - q, c - p, d - q, e - p, f - q
        exact = (a * a + b * b) * (c * f - d * e) - (c * c + d * d) * (a * f - b * e) + (e * e + f * f) * (a * d - b * c)
        side = (c - a) * (f - b) - (d - b) * (e - a)
        out[i] = exact * (1 if side > 0 else -1) > 0
    return pd.Series(out)


def insert_point(mesh: Mesh, x: float, y: float, z: float) -> tuple[Mesh, DataFrame]:
    """The mesh with one more point, and what changed: (change, a, b, c), edges with a null c.

    Triangles whose circumcircle holds the point go, with the hull edges that
    see it; every edge left open is joined to the point.
    """
    if mesh.vertices.where((F.col("x") == num(x)) & (F.col("y") == num(y))).limit(1).count():
        raise InvalidArgument("a vertex has this XY")
    new = int(mesh.vertices.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    spark = mesh.vertices.sparkSession
    hit = in_circle(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")), num(x), num(y))
    marked = mesh.triangles.withColumn("hit", hit).persist()
    removed, stay = marked.where("hit").drop("hit"), marked.where("not hit").drop("hit")
    all_edges = directed(mesh.triangles).select("u", "v")
    hull = all_edges.join(all_edges.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")
    place = lambda k: mesh.vertices.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"), F.col("z").alias(f"{k}z"))
    sees = hull.join(place("u"), "u").join(place("v"), "v").where(orient(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"), num(x), num(y)) < 0)
    cut = directed(removed).select("u", "v").union(sees.select(F.col("v").alias("u"), F.col("u").alias("v")))
    border = cut.join(cut.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti").join(place("u"), "u").join(place("v"), "v")
    ends = [F.struct(F.col(k).alias("id"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y"), F.col(f"{k}z").alias("z")) for k in "uv"]
    corners = F.sort_array(F.array(*ends, F.struct(F.lit(new).cast("long").alias("id"), num(x).alias("x"), num(y).alias("y"), num(z).alias("z"))))
    added = border.select(corners.alias("k")).select(*(F.col("k")[i]["id"].alias(n) for i, n in enumerate("abc")), *(F.col("k")[i][d].alias(n + d) for i, n in enumerate("abc") for d in "xyz"))
    vertices = mesh.vertices.unionByName(spark.createDataFrame([(new, float(x), float(y), float(z))], "id long, x double, y double, z double"))
    none = F.lit(None).cast("long")
    pair = lambda n, p, q: (F.lit(n).alias("change"), F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), none.alias("c"))
    spokes = border.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    within = directed(removed).select("u", "v")
    inner = within.join(within.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).where("u < v")
    effect = (removed.select(F.lit("removed_triangle").alias("change"), "a", "b", "c")
              .unionByName(added.select(F.lit("added_triangle").alias("change"), "a", "b", "c"))
              .unionByName(border.select(*pair("boundary_edge", F.col("u"), F.col("v"))))
              .unionByName(inner.select(*pair("removed_edge", F.col("u"), F.col("v"))))
              .unionByName(spokes.select(*pair("added_edge", F.col("u"), F.lit(new).cast("long")))))
    return Mesh(vertices, stay.unionByName(added), mesh.crs, mesh.generation + 1), effect


def delete_vertex(mesh: Mesh, vertex: int) -> tuple[Mesh, DataFrame]:
    """The mesh without a vertex, and what changed, as :func:`insert_point` has it."""
    if not mesh.vertices.where(F.col("id") == vertex).limit(1).count():
        raise NotFound(f"no vertex {vertex}")
    mine = (F.col("a") == vertex) | (F.col("b") == vertex) | (F.col("c") == vertex)
    star, stay = mesh.triangles.where(mine), mesh.triangles.where(~mine)
    link = directed(star).where(F.col("w") == vertex).select("u", "v")
    ring = mesh.vertices.join(link.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id")

    def fill(key: tuple, pdf: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 3:
            return _faces(pdf, [])
        place = {i: k for k, i in enumerate(pdf["id"])}
        return _faces(pdf, Delaunay(_plane(pdf)).filled([(place[u], place[v]) for u, v in zip(marks["u"], marks["v"], strict=True)]))

    # One vertex's neighbours: a handful of rows.
    added = ring.groupBy(F.lit(0).alias("g")).cogroup(link.groupBy(F.lit(0).alias("g"))).applyInPandas(fill, SCHEMA)
    none = F.lit(None).cast("long")
    fresh = directed(added).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(link.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    pair = lambda n, p, q: (F.lit(n).alias("change"), F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), none.alias("c"))
    effect = (star.select(F.lit("removed_triangle").alias("change"), "a", "b", "c")
              .unionByName(added.select(F.lit("added_triangle").alias("change"), "a", "b", "c"))
              .unionByName(link.select(*pair("boundary_edge", F.col("u"), F.col("v"))))
              .unionByName(ring.select(*pair("removed_edge", F.col("id"), F.lit(vertex).cast("long"))))
              .unionByName(fresh.select(*pair("added_edge", F.col("u"), F.col("v")))))
    return Mesh(mesh.vertices.where(F.col("id") != vertex), stay.unionByName(added), mesh.crs, mesh.generation + 1), effect


def delete_nearest(mesh: Mesh, x: float, y: float) -> tuple[Mesh, DataFrame]:
    near = nearest_vertex(mesh, x, y)
    return delete_vertex(mesh, near)


def update_z(mesh: Mesh, changes: DataFrame) -> Mesh:
    """The mesh with the heights of ``changes`` (id, z); its shape stays."""
    new = changes.select("id", F.col("z").cast("double").alias("new"))
    vertices = mesh.vertices.join(new, "id", "left").select("id", "x", "y", F.coalesce("new", "z").alias("z"))
    triangles = mesh.triangles
    for k in "abc":
        own = new.select(F.col("id").alias(k), F.col("new").alias("__z"))
        triangles = triangles.join(own, k, "left").withColumn(f"{k}z", F.coalesce("__z", f"{k}z")).drop("__z")
    return Mesh(vertices, triangles.select("a", "b", "c", *CORNERS), mesh.crs, mesh.generation + 1)


def nearest_vertex(mesh: Mesh, x: float, y: float) -> int:
    d2 = (F.col("x") - num(x)) * (F.col("x") - num(x)) + (F.col("y") - num(y)) * (F.col("y") - num(y))
    row = mesh.vertices.agg(F.min(F.struct(d2.alias("d2"), "id"))).first()[0]
    if row is None:
        raise EmptySurface("the mesh has no vertex")
    return row["id"]


def nearest(mesh: Mesh, queries: DataFrame) -> DataFrame:
    """Per query (qid, x, y) the nearest vertex ``id`` and squared distance ``d2``; ties to the smaller id.

    Rings of tiles around each query widen until the nearest found is nearer
    than what lies outside; each round joins on tile numbers.
    """
    n, x0, y0, x1, y1 = mesh.vertices.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n:
        raise EmptySurface("the mesh has no vertex")
    tiles = grid_for(n, x0, y0, x1, y1, per_tile=4)
    v = mesh.vertices.select("id", F.col("x").alias("vx"), F.col("y").alias("vy"), tiles.column(F.col("x")).alias("tc"), tiles.row(F.col("y")).alias("tr"))
    left = queries.select("qid", "x", "y", tiles.column(F.col("x")).alias("qc"), tiles.row(F.col("y")).alias("qr"))
    done, reach = None, 1
    d2 = (F.col("x") - F.col("vx")) * (F.col("x") - F.col("vx")) + (F.col("y") - F.col("vy")) * (F.col("y") - F.col("vy"))
    while True:
        everything = reach >= max(tiles.columns, tiles.rows)
        span = lambda c, most: F.explode(F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(most - 1))))
        asked = left.withColumn("tc", span("qc", tiles.columns)).withColumn("tr", span("qr", tiles.rows))
        best = asked.join(v, ["tc", "tr"]).groupBy("qid").agg(F.min(F.struct(d2.alias("d2"), "id")).alias("b"))
        found = left.join(best, "qid", "left")
        # Distance to the nearest side of the searched square that isn't the edge of the data.
        inf = float("inf")
        gap = F.least(
            F.when(F.col("qc") - reach <= 0, inf).otherwise(F.col("x") - (num(x0) + (F.col("qc") - reach) * num(tiles.width))),
            F.when(F.col("qc") + reach >= tiles.columns - 1, inf).otherwise(num(x0) + (F.col("qc") + reach + 1) * num(tiles.width) - F.col("x")),
            F.when(F.col("qr") - reach <= 0, inf).otherwise(F.col("y") - (num(y0) + (F.col("qr") - reach) * num(tiles.height))),
            F.when(F.col("qr") + reach >= tiles.rows - 1, inf).otherwise(num(y0) + (F.col("qr") + reach + 1) * num(tiles.height) - F.col("y")))
        sure = F.col("b").isNotNull() & (F.col("b.d2") < gap * gap) if not everything else F.lit(True)
        found = found.withColumn("sure", F.coalesce(sure, F.lit(False))).persist()
        part = found.where("sure").select("qid", "x", "y", F.col("b.id").alias("id"), F.col("b.d2").alias("d2"))
        done = part if done is None else done.unionByName(part)
        left = found.where("not sure").select("qid", "x", "y", "qc", "qr")
        if everything or not left.limit(1).count():
            return done
        reach *= 2


def _signs() -> tuple[Column, Column, Column]:
    """Orientation of the query against the three edges, as the triangle turns."""
    x, y = F.col("x"), F.col("y")
    turn = F.signum(orient(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))))
    return tuple(turn * orient(F.col(p + "x"), F.col(p + "y"), F.col(q + "x"), F.col(q + "y"), x, y) for p, q in (("b", "c"), ("c", "a"), ("a", "b")))


def hits(triangles: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (qid, x, y) with every triangle that holds them, with ``wa``, ``wb``, ``wc`` (0 on an edge).

    Triangles are listed under the tiles of their boxes; queries meet those of their tile.
    """
    n, x0, y0, x1, y1 = triangles.agg(F.count(F.lit(1)), F.min(F.least("ax", "bx", "cx")), F.min(F.least("ay", "by", "cy")), F.max(F.greatest("ax", "bx", "cx")), F.max(F.greatest("ay", "by", "cy"))).first()
    if not n:
        raise EmptySurface("the surface has no triangle")
    tiles = grid_for(n, x0, y0, x1, y1, per_tile=4)
    boxed = covered(triangles, tiles, F.least("ax", "bx", "cx"), F.least("ay", "by", "cy"), F.greatest("ax", "bx", "cx"), F.greatest("ay", "by", "cy"))
    asked = queries.withColumn("tc", tiles.column(F.col("x"))).withColumn("tr", tiles.row(F.col("y")))
    wa, wb, wc = _signs()
    met = asked.join(boxed, ["tc", "tr"]).withColumn("wa", wa).withColumn("wb", wb).withColumn("wc", wc)
    return met.where("wa >= 0 and wb >= 0 and wc >= 0").drop("tc", "tr")


def locate(mesh: Mesh, queries: DataFrame) -> DataFrame:
    """Per query (qid, x, y): ``type`` (FACE, EDGE, VERTEX or OUTSIDE_HULL) and the holding triangle with the smallest ids."""
    h = hits(mesh.triangles, queries)
    zeros = (F.col("wa") == 0).cast("int") + (F.col("wb") == 0).cast("int") + (F.col("wc") == 0).cast("int")
    best = h.groupBy("qid").agg(F.min(F.struct("a", "b", "c", zeros.alias("zeros"))).alias("t"))
    kind = F.when(F.col("t").isNull(), "OUTSIDE_HULL").otherwise(F.element_at(F.array(F.lit("FACE"), F.lit("EDGE"), F.lit("VERTEX")), F.col("t.zeros") + 1))
    return queries.join(best, "qid", "left").select("qid", kind.alias("type"), F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.c").alias("c"))


def plane_at(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """z, dz/dx and dz/dy of the plane through a triangle's corners."""
    ux, uy, uz = (F.col(f"b{d}") - F.col(f"a{d}") for d in "xyz")
    vx, vy, vz = (F.col(f"c{d}") - F.col(f"a{d}") for d in "xyz")
    det = ux * vy - uy * vx
    zx, zy = (uz * vy - uy * vz) / det, (ux * vz - uz * vx) / det
    return F.col("az") + zx * (x - F.col("ax")) + zy * (y - F.col("ay")), zx, zy


def surface(triangles: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query (qid, x, y): z, gradient, slope and aspect of the holding triangle with the smallest ids; null outside.

    ``on_edge`` and ``on_vertex`` tell where the gradient is one of several.
    """
    zeros = (F.col("wa") == 0).cast("int") + (F.col("wb") == 0).cast("int") + (F.col("wc") == 0).cast("int")
    z, zx, zy = plane_at(F.col("x"), F.col("y"))
    h = hits(triangles, queries).withColumn("z", z).withColumn("dz_dx", zx).withColumn("dz_dy", zy)
    best = h.groupBy("qid").agg(F.min(F.struct("a", "b", "c", "z", "dz_dx", "dz_dy", zeros.alias("zeros"))).alias("t"))
    out = queries.join(best, "qid", "left").select("qid", "x", "y", *(F.col(f"t.{c}").alias(c) for c in ("z", "dz_dx", "dz_dy")), (F.col("t.zeros") == 1).alias("on_edge"), (F.col("t.zeros") == 2).alias("on_vertex"))
    steep = F.sqrt(F.col("dz_dx") * F.col("dz_dx") + F.col("dz_dy") * F.col("dz_dy"))
    return out.withColumn("slope", slope_degrees(F.col("dz_dx"), F.col("dz_dy"))).withColumn("aspect", F.when(steep <= EPS * 64, num(0)).otherwise(aspect_degrees(F.col("dz_dx"), F.col("dz_dy"))))


def meets_box(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether a triangle meets a closed box: boxes overlap and no edge has the box wholly outside."""
    low_x, high_x = F.least("ax", "bx", "cx"), F.greatest("ax", "bx", "cx")
    low_y, high_y = F.least("ay", "by", "cy"), F.greatest("ay", "by", "cy")
    out = (high_x >= xmin) & (low_x <= xmax) & (high_y >= ymin) & (low_y <= ymax)
    turn = F.signum(orient(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))))
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        corner = [turn * orient(F.col(p + "x"), F.col(p + "y"), F.col(q + "x"), F.col(q + "y"), num(x), num(y)) for x in (xmin, xmax) for y in (ymin, ymax)]
        out = out & (F.greatest(*corner) >= 0)
    return out


def window(triangles: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Triangles that meet the closed rectangle: a scan whose box test can be pushed down."""
    if xmin > xmax or ymin > ymax:
        raise InvalidArgument("the rectangle is inside out")
    return triangles.where(meets_box(xmin, ymin, xmax, ymax))


def validate(mesh: Mesh) -> DataFrame:
    """One row of faults: edges with more than two faces, Delaunay violations across edges, Euler's formula.

    A mesh is Delaunay if no edge's opposite corner is inside the circle of its
    triangle, so only neighbours need to meet.
    """
    e = directed(mesh.triangles)
    crowded = e.groupBy("u", "v").count().where("count > 1").agg(F.count(F.lit(1)).alias("crowded_edges"))
    place = lambda k: mesh.vertices.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    across = e.join(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("o")), ["u", "v"]).where("u < v")
    for k in "uvwo":
        across = across.join(place(k), k)
    bad = in_circle(*(F.col(c) for c in ("ux", "uy", "vx", "vy", "wx", "wy", "ox", "oy")))
    wrong = across.where(bad).agg(F.count(F.lit(1)).alias("not_delaunay"))
    hull = e.join(e.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti").agg(F.count(F.lit(1)).alias("hull_edges"))
    counts = mesh.vertices.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(mesh.triangles.agg(F.count(F.lit(1)).alias("f"))))
    one = counts.join(F.broadcast(crowded)).join(F.broadcast(wrong)).join(F.broadcast(hull))  # one row each
    return one.select("crowded_edges", "not_delaunay", "hull_edges", (F.col("f") == 2 * F.col("n") - 2 - F.col("hull_edges")).alias("euler"))
