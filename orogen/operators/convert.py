"""Conversions between meshes, grids and contours, and exact clipping of meshes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.errors import EmptySurface, InvalidArgument, Unsupported
from orogen.functions.geometry import node_col, node_row, orient, world_x, world_y
from orogen.operators import contour, mesh as tin
from orogen.operators.grid import nodes, positions
from orogen.operators.measure import is_simple
from orogen.schema import Grid, GridMeta, Mesh

Ring = list[tuple[float, float]]


def grid_from_triangles(triangles: DataFrame, meta: GridMeta) -> Grid:
    """Heights of a surface at a grid's nodes; null outside it.

    Each triangle makes the nodes of its box and keeps those it holds, so no
    spatial join is needed; a node on an edge takes the triangle with the
    smallest ids.
    """
    x, y = [F.col(f"{k}x") for k in "abc"], [F.col(f"{k}y") for k in "abc"]
    c, r = [node_col(meta, a, b) for a, b in zip(x, y, strict=True)], [node_row(meta, a, b) for a, b in zip(x, y, strict=True)]
    span = lambda v, most: F.sequence(F.greatest(F.ceil(F.least(*v) - 1e-9), F.lit(0)), F.least(F.floor(F.greatest(*v) + 1e-9), F.lit(most)))
    fits = lambda v, most: F.greatest(F.ceil(F.least(*v) - 1e-9), F.lit(0)) <= F.least(F.floor(F.greatest(*v) + 1e-9), F.lit(most))
    t = triangles.where(fits(c, meta.width - 1) & fits(r, meta.height - 1))
    t = t.withColumn("row", F.explode(span(r, meta.height - 1))).withColumn("col", F.explode(span(c, meta.width - 1)))
    px, py = world_x(meta, F.col("col").cast("double"), F.col("row").cast("double")), world_y(meta, F.col("col").cast("double"), F.col("row").cast("double"))
    turn = F.signum(orient(x[0], y[0], x[1], y[1], x[2], y[2]))
    inside = F.lit(True)
    for i in range(3):
        j = (i + 1) % 3
        inside = inside & (turn * orient(x[i], y[i], x[j], y[j], px, py) >= 0)
    z, _, _ = tin.plane_at(px, py)
    held = t.where(inside).groupBy("row", "col").agg(F.min(F.struct("a", "b", "c", z.alias("z"))).alias("t"))
    df = nodes(triangles.sparkSession, meta).join(held, ["row", "col"], "left").select("row", "col", F.col("t.z").alias("z"))
    return Grid(df, meta)


def grid_from_mesh(mesh: Mesh, meta: GridMeta) -> Grid:
    return grid_from_triangles(mesh.triangles, meta)


def grid_from_domain(marked: DataFrame, meta: GridMeta) -> Grid:
    return grid_from_triangles(marked.where("in_domain"), meta)


def points_from_grid(grid: Grid, *, bridge: bool = False) -> DataFrame:
    """(id, x, y, z) of the valid nodes; missing ones are refused unless they may be bridged."""
    gaps, valid = grid.df.agg(F.count(F.when(F.col("z").isNull(), 1)), F.count("z")).first()
    if gaps and not bridge:
        raise Unsupported("the grid has missing nodes")
    if valid < 3:
        raise EmptySurface("too few valid nodes")
    p = positions(grid).where("z is not null")
    return p.select((F.col("row") * grid.meta.width + F.col("col") + 1).alias("id"), "x", "y", "z")


def mesh_from_grid(grid: Grid, *, bridge: bool = False) -> Mesh:
    return tin.build(points_from_grid(grid, bridge=bridge), grid.meta.crs)


def mesh_from_contours(lines: DataFrame, longest: float | None = None, crs: str = "", *, meeting: str = "refuse") -> Mesh:
    return tin.build(contour.surface_points(lines, longest, meeting=meeting), crs)


def grid_from_contours(lines: DataFrame, meta: GridMeta, longest: float | None = None, *, meeting: str = "refuse") -> Grid:
    return grid_from_mesh(mesh_from_contours(lines, longest, meta.crs, meeting=meeting), meta)


def half_plane(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of a ring left of the line a-b."""
    if not len(ring):
        return ring
    side = (b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0])
    out = []
    for i in range(len(ring)):
        p, q, s, t = ring[i - 1], ring[i], side[i - 1], side[i]
        if (s >= 0) != (t >= 0):
            out.append(p + (q - p) * (s / (s - t)))
        if t >= 0:
            out.append(q)
    return np.array(out).reshape(-1, 2)


def area_of(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y))


def clip_exact(triangles: DataFrame, outer: Ring, holes: list[Ring] = ()) -> DataFrame:
    """(a, b, c, area, rings) of each triangle's part in a polygon with holes.

    Rings are clipped by the triangle's three sides and lifted onto its plane;
    a hole's area counts against it. Parts without an area are left out.
    """
    for ring in (outer, *holes):
        if not is_simple(ring):
            raise InvalidArgument("a clip ring is not simple")
    rings = [np.array(outer, dtype=float), *(np.array(h, dtype=float) for h in holes)]
    xs, ys = rings[0][:, 0], rings[0][:, 1]
    near = tin.window(triangles, float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                corner = np.array([[r.ax, r.ay], [r.bx, r.by], [r.cx, r.cy]])
                z = np.array([r.az, r.bz, r.cz])
                m = np.column_stack((corner[1] - corner[0], corner[2] - corner[0]))
                det = m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
                if det < 0:
                    corner, z, m = corner[[0, 2, 1]], z[[0, 2, 1]], m[:, ::-1]
                area, made = 0.0, []
                for i, ring in enumerate(rings):
                    part = ring
                    for k in range(3):
                        part = half_plane(part, corner[k], corner[(k + 1) % 3])
                    size = abs(area_of(part))
                    if size > 0:
                        w = np.linalg.solve(m, (part - corner[0]).T)
                        heights = z[0] + w[0] * (z[1] - z[0]) + w[1] * (z[2] - z[0])
                        made.append({"is_hole": i > 0, "pts": [{"x": float(p[0]), "y": float(p[1]), "z": float(h)} for p, h in zip(part, heights, strict=True)]})
                        area += -size if i else size
                if area > 1e-12 * abs(det):
                    rows.append((r.a, r.b, r.c, area, made))
            yield pd.DataFrame(rows, columns=["a", "b", "c", "area", "rings"])

    return near.select("a", "b", "c", *tin.CORNERS).mapInPandas(run, "a long, b long, c long, area double, rings array<struct<is_hole: boolean, pts: array<struct<x: double, y: double, z: double>>>>")
