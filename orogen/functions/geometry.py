"""Column expressions of affine maps, gradients and plane geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orogen.schema import GridMeta


def num(x: float) -> Column:
    return F.lit(float(x))


def world_x(m: GridMeta, col: Column, row: Column) -> Column:
    return num(m.gt[0]) + col * num(m.gt[1]) + row * num(m.gt[2])


def world_y(m: GridMeta, col: Column, row: Column) -> Column:
    return num(m.gt[3]) + col * num(m.gt[4]) + row * num(m.gt[5])


def node_col(m: GridMeta, x: Column, y: Column) -> Column:
    return ((x - num(m.gt[0])) * num(m.gt[5]) - (y - num(m.gt[3])) * num(m.gt[2])) / num(m.det)


def node_row(m: GridMeta, x: Column, y: Column) -> Column:
    return ((y - num(m.gt[3])) * num(m.gt[1]) - (x - num(m.gt[0])) * num(m.gt[4])) / num(m.det)


def gradient_x(m: GridMeta, by_col: Column, by_row: Column) -> Column:
    return (by_col * num(m.gt[5]) - num(m.gt[4]) * by_row) / num(m.det)


def gradient_y(m: GridMeta, by_col: Column, by_row: Column) -> Column:
    return (num(m.gt[1]) * by_row - num(m.gt[2]) * by_col) / num(m.det)


def slope_degrees(zx: Column, zy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(zx * zx + zy * zy)))


def aspect_degrees(zx: Column, zy: Column) -> Column:
    """Downhill bearing from north, 0 to 360; null on flat ground."""
    deg = F.degrees(F.atan2(-zx, -zy))
    return F.when(zx * zx + zy * zy > 0, F.when(deg < 0, deg + 360.0).otherwise(deg))


def octant(degrees: Column) -> Column:
    """0 north, 1 north-east, ... 7 north-west."""
    return F.pmod(F.floor((degrees + 22.5) / 45.0), F.lit(8)).cast("int")


def orient(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, num(low)), num(high))
