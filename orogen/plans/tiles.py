"""Spatial joins as equi-joins: boxes are listed under the tiles they cover, points under their own."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiles:
    x0: float
    y0: float
    width: float
    height: float
    columns: int
    rows: int

    def column(self, x: Column) -> Column:
        """Tile column of an x, the first or last one beyond the ends."""
        at = F.floor((x - F.lit(float(self.x0))) / F.lit(float(self.width)))
        return F.least(F.greatest(at, F.lit(0)), F.lit(self.columns - 1)).cast("int")

    def row(self, y: Column) -> Column:
        at = F.floor((y - F.lit(float(self.y0))) / F.lit(float(self.height)))
        return F.least(F.greatest(at, F.lit(0)), F.lit(self.rows - 1)).cast("int")


def grid_for(n: int, x0: float, y0: float, x1: float, y1: float, per_tile: int) -> Tiles:
    """Tiles over a box for n things, about ``per_tile`` in each."""
    side = max(1, min(4096, math.ceil(math.sqrt(n / per_tile))))
    return Tiles(x0, y0, max((x1 - x0) / side, 1e-300), max((y1 - y0) / side, 1e-300), side, side)


def covered(df: DataFrame, tiles: Tiles, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """One row for each tile (tc, tr) that a row's box covers."""
    df = df.withColumn("tc", F.explode(F.sequence(tiles.column(xmin), tiles.column(xmax))))
    return df.withColumn("tr", F.explode(F.sequence(tiles.row(ymin), tiles.row(ymax))))
