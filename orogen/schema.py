"""Metadata and column layouts of grids and meshes.

A grid is a table (row, col, z) with exactly width x height rows; a missing
height is null. A mesh is a pair of tables: vertices (id, x, y, z) and triangles
(a, b, c) with ascending ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from orogen.errors import InvalidArgument, LimitExceeded

#: Nodes are numbered by longs.
MOST_NODES = 1 << 62
EPS = 2.0**-52


@dataclass(frozen=True)
class GridMeta:
    """Size, affine transform of nodes, CRS and generation of a grid."""

    width: int
    height: int
    gt: tuple[float, float, float, float, float, float] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    crs: str = ""
    generation: int = 1

    def __post_init__(self) -> None:
        if self.width < 1 or self.height < 1:
            raise InvalidArgument("a grid needs at least one row and one column")
        if self.width * self.height > MOST_NODES:
            raise LimitExceeded("too many grid nodes")
        if not all(map(math.isfinite, self.gt)) or not math.isfinite(self.det) or self.det == 0:
            raise InvalidArgument("the affine transform must be finite and invertible")

    @property
    def det(self) -> float:
        return self.gt[1] * self.gt[5] - self.gt[2] * self.gt[4]

    def world(self, col: float, row: float) -> tuple[float, float]:
        g = self.gt
        return g[0] + col * g[1] + row * g[2], g[3] + col * g[4] + row * g[5]

    def node(self, x: float, y: float) -> tuple[float, float]:
        """Fractional (column, row) of a point."""
        g, dx, dy = self.gt, x - self.gt[0], y - self.gt[3]
        return (dx * g[5] - dy * g[2]) / self.det, (dy * g[1] - dx * g[4]) / self.det

    def bounds(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax of the four corner nodes."""
        corners = [self.world(c, r) for c in (0, self.width - 1) for r in (0, self.height - 1)]
        xs, ys = zip(*corners, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def edited(self) -> GridMeta:
        return replace(self, generation=self.generation + 1)


@dataclass(frozen=True)
class Grid:
    """A dense table (row, col, z) with its metadata."""

    df: DataFrame
    meta: GridMeta


@dataclass(frozen=True)
class Mesh:
    """Vertices (id, x, y, z) and triangles (a, b, c), with CRS and generation."""

    vertices: DataFrame
    triangles: DataFrame
    crs: str = ""
    generation: int = 1


def same_crs(a: str, b: str) -> None:
    if a != b:
        raise InvalidArgument("CRS metadata do not match")
