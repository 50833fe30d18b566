"""Coordinate systems that have closed forms: geographic, spherical Mercator and UTM."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument, Unsupported
from orogen.functions.geometry import num

RADIUS = 6378137.0
#: WGS 84: semi-major axis and flattening.
AXIS, FLAT = 6378137.0, 1 / 298.257223563
_NAMES = {4326: "WGS 84", 3857: "WGS 84 / Pseudo-Mercator"}


def code(definition: str) -> int:
    """The EPSG code of a definition such as ``EPSG:4326``, ``4326``, a URN, or WKT with an authority."""
    text = definition.strip()
    if found := re.fullmatch(r"(?:EPSG:|urn:ogc:def:crs:EPSG::)?(\d{4,5})", text, re.I):
        number = int(found[1])
    elif text.upper() in ("WGS84", "CRS84", "OGC:CRS84"):
        number = 4326
    elif found := re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d{4,5})"?\]', text, re.I):
        number = int(found[-1])
    else:
        raise InvalidArgument(f"unknown coordinate system {definition!r}")
    if number not in _NAMES and not (32601 <= number <= 32660 or 32701 <= number <= 32760):
        raise Unsupported(f"EPSG:{number} has no closed form here")
    return number


def normalize(definition: str) -> str:
    """One short WKT for every way of naming a supported system."""
    n = code(definition)
    name = _NAMES.get(n) or f"WGS 84 / UTM zone {n % 100}{'N' if n < 32700 else 'S'}"
    kind = "GEOGCRS" if n == 4326 else "PROJCRS"
    return f'{kind}["{name}",ID["EPSG",{n}]]'


def is_same(a: str, b: str) -> bool:
    return code(a) == code(b)


def _mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return num(RADIUS) * F.radians(lon), num(RADIUS) * F.log(F.tan(num(math.pi / 4) + F.radians(lat) / 2.0))


def _inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / num(RADIUS)), F.degrees(2.0 * F.atan(F.exp(y / num(RADIUS))) - num(math.pi / 2))


_N = FLAT / (2 - FLAT)
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0 = 0.9996


def _utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Krueger's series to the third order, within a millimetre inside a zone."""
    lam = F.radians(lon - num(zone * 6 - 183))
    s, e = F.sin(F.radians(lat)), 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(s) - num(e) * F.atanh(num(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + num(a) * F.cos(xi * 2 * j) * F.sinh(eta * 2 * j)
        y = y + num(a) * F.sin(xi * 2 * j) * F.cosh(eta * 2 * j)
    return num(500000) + num(_K0 * _A) * x, num(10_000_000 if south else 0) + num(_K0 * _A) * y


def _inverse_utm(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    xi, eta = (y - num(10_000_000 if south else 0)) / num(_K0 * _A), (x - num(500000)) / num(_K0 * _A)
    p, q = xi, eta
    for j, b in enumerate(_BETA, 1):
        p = p - num(b) * F.sin(xi * 2 * j) * F.cosh(eta * 2 * j)
        q = q - num(b) * F.cos(xi * 2 * j) * F.sinh(eta * 2 * j)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + num(d) * F.sin(chi * 2 * j)
    return num(zone * 6 - 183) + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(lat)


def transformed(source: str, target: str, x: Column, y: Column) -> tuple[Column, Column]:
    """x (east) and y (north) in another system; columns stay in the JVM."""
    a, b = code(source), code(target)
    if a == b:
        return x, y
    lon, lat = (x, y) if a == 4326 else _inverse_mercator(x, y) if a == 3857 else _inverse_utm(x, y, a % 100, a > 32700)
    return (lon, lat) if b == 4326 else _mercator(lon, lat) if b == 3857 else _utm(lon, lat, b % 100, b > 32700)


def transform_points(df: DataFrame, source: str, target: str) -> DataFrame:
    """The rows with x and y in another system; any that isn't finite is refused as a whole when it is computed."""
    x, y = transformed(source, target, F.col("x"), F.col("y"))
    checked = lambda v: F.when(F.abs(v) < float("inf"), v).otherwise(F.raise_error(F.lit("a point can't be transformed")))
    return df.withColumns({"x": checked(x), "y": checked(y)})


def transform_lines(lines: DataFrame, source: str, target: str) -> DataFrame:
    """Contours in another system; a line's level becomes its first point's height."""
    def moved(p: Column) -> Column:
        x, y = transformed(source, target, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"), p["z"].alias("z"))

    return lines.withColumn("pts", F.transform("pts", moved)).withColumn("level", F.col("pts")[0]["z"])
