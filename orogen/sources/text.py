"""Text formats of points, grids, meshes, contours and constraints.

Writers leave a folder of part files, in order of their names; readers take a
folder or a file. Numbers are written with seventeen digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.errors import InvalidArgument
from orogen.schema import Grid, GridMeta

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of a text of three numbers a line, separated by blanks, tabs, commas or semicolons; # starts a comment."""
    lines = spark.read.text(path)
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "#.*$", ""), r"[\s,;]+", " "))
    f = lines.select("value", F.split(body, " ").alias("f"), body.alias("body")).where("body <> ''")
    ok = (F.size("f") == 3) & F.forall("f", lambda v: v.rlike(NUMBER))
    value = lambda i: F.when(ok, F.col("f")[i].cast("double")).otherwise(F.raise_error(F.concat(F.lit("not three numbers: "), F.col("value"))))
    return f.select(*(value(i).alias(d) for i, d in enumerate("xyz")))


def digits(c: Column) -> Column:
    """A double as its shortest exact text."""
    return c.cast("string")


def write_xyz(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(" ", *(digits(F.col(d)) for d in "xyz"))).write.text(path)


def write_grid(grid: Grid, path: str, nodata: float = -9999.0) -> None:
    """SIZE, GEOTRANSFORM and NODATA lines, then a line a row: ``ROW number values``."""
    m = grid.meta
    spark = grid.df.sparkSession
    head = [f"SIZE {m.width} {m.height}", "GEOTRANSFORM " + " ".join(map(repr, m.gt)), f"NODATA {nodata!r}"]
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.text(f"{path}/part=head")
    rows = grid.df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("z", F.lit(nodata)).alias("z")))).alias("v"))
    line = F.concat_ws(" ", F.lit("ROW"), F.col("row").cast("string"), F.concat_ws(" ", F.transform("v", lambda p: digits(p["z"]))))
    rows.select(line.alias("value")).write.text(f"{path}/part=rows")


def read_grid(spark: SparkSession, path: str) -> Grid:
    head = {r[0].split(" ", 1)[0]: r[0].split(" ")[1:] for r in spark.read.text(f"{path}/part=head").collect()}  # three lines
    if set(head) != {"SIZE", "GEOTRANSFORM", "NODATA"}:
        raise InvalidArgument("not a grid text")
    meta = GridMeta(int(head["SIZE"][0]), int(head["SIZE"][1]), tuple(map(float, head["GEOTRANSFORM"])))
    f = spark.read.text(f"{path}/part=rows").select(F.split("value", " ").alias("f"))
    checked = F.when((F.size("f") == meta.width + 2) & (F.col("f")[0] == "ROW"), F.col("f")).otherwise(F.raise_error(F.lit("a row has the wrong length")))
    rows = f.select(checked.alias("f")).select(F.col("f")[1].cast("long").alias("row"), F.posexplode(F.slice("f", 3, meta.width)).alias("col", "text"))
    z = F.col("text").cast("double")
    return Grid(rows.select("row", F.col("col").cast("long").alias("col"), F.when(z != float(head["NODATA"][0]), z).alias("z")), meta)


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """``V id x y z`` and ``T a b c`` lines."""
    v = vertices.select(F.concat_ws(" ", F.lit("V"), F.col("id").cast("string"), *(digits(F.col(d)) for d in "xyz")).alias("value"))
    t = triangles.select(F.concat_ws(" ", F.lit("T"), *(F.col(d).cast("string") for d in "abc")).alias("value"))
    v.write.text(f"{path}/part=vertices")
    t.write.text(f"{path}/part=triangles")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and listed triangles; triangles must be distinct and name known vertices."""
    f = spark.read.text(path).select(F.split("value", " ").alias("f"))
    v = f.where(F.col("f")[0] == "V").select(F.col("f")[1].cast("long").alias("id"), *(F.col("f")[i + 2].cast("double").alias(d) for i, d in enumerate("xyz")))
    t = f.where(F.col("f")[0] == "T").select(*(F.col("f")[i + 1].cast("long").alias(d) for i, d in enumerate("abc")))
    if t.groupBy("a", "b", "c").count().where("count > 1").limit(1).count():
        raise InvalidArgument("a triangle is listed twice")
    if t.select(F.explode(F.array("a", "b", "c")).alias("id")).join(v, "id", "left_anti").limit(1).count():
        raise InvalidArgument("a triangle names an unknown vertex")
    return v, t


def write_lines(lines: DataFrame, path: str) -> None:
    """A line each polyline: ``LINE id elevation closed n`` and its coordinates."""
    pts = F.concat_ws(" ", F.flatten(F.transform("pts", lambda p: F.array(*(digits(p[d]) for d in "xyz")))))
    head = F.concat_ws(" ", F.lit("LINE"), F.col("line_id").cast("string"), digits(F.col("elevation")), F.col("closed").cast("int").cast("string"), F.size("pts").cast("string"))
    lines.select(F.concat_ws(" ", head, pts)).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, elevation, closed, pts) of polylines with two points or more."""
    f = spark.read.text(path).select(F.split("value", " ").alias("f"))
    n = F.col("f")[4].cast("int")
    ok = (F.col("f")[0] == "LINE") & (n >= 2) & (F.size("f") == 5 + 3 * n)
    f = f.select(F.when(ok, F.col("f")).otherwise(F.raise_error(F.lit("not a polyline"))).alias("f"))
    at = lambda i, d: F.col("f")[5 + 3 * i + d].cast("double")
    pts = F.transform(F.sequence(F.lit(0), F.col("f")[4].cast("int") - 1), lambda i: F.struct(*(at(i, k).alias(d) for k, d in enumerate("xyz"))))
    return f.select(F.col("f")[1].cast("long").alias("line_id"), F.col("f")[2].cast("double").alias("elevation"), (F.col("f")[3] == "1").alias("closed"), pts.alias("pts"))


def write_constraints(constraints: DataFrame, path: str) -> None:
    """A line each constraint: ``CONSTRAINT id kind closed n`` and its coordinates."""
    rows = constraints.groupBy("cid", "kind", "closed").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("pts"))
    pts = F.concat_ws(" ", F.flatten(F.transform("pts", lambda p: F.array(*(digits(p[d]) for d in "xyz")))))
    head = F.concat_ws(" ", F.lit("CONSTRAINT"), F.col("cid").cast("string"), F.col("kind").cast("string"), F.col("closed").cast("int").cast("string"), F.size("pts").cast("string"))
    rows.select(F.concat_ws(" ", head, pts)).write.text(path)


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path).select(F.split("value", " ").alias("f"))
    n = F.col("f")[4].cast("int")
    ok = (F.col("f")[0] == "CONSTRAINT") & (F.size("f") == 5 + 3 * n)
    f = f.select(F.when(ok, F.col("f")).otherwise(F.raise_error(F.lit("not a constraint"))).alias("f"))
    s = f.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("f")[4].cast("int") - 1)))
    at = lambda d: F.col("f")[5 + 3 * F.col("seq") + d].cast("double")
    return s.select(F.col("f")[1].cast("long").alias("cid"), F.col("f")[2].cast("int").alias("kind"), (F.col("f")[3] == "1").alias("closed"), F.col("seq").cast("long").alias("seq"), *(at(k).alias(d) for k, d in enumerate("xyz")))


def read_ascii_grid(spark: SparkSession, path: str) -> Grid:
    """An ESRI ASCII grid: rows from north to south; the lower-left corner or centre is given."""
    lines = spark.read.text(path, wholetext=True)
    tokens = lines.select(F.split(F.trim("value"), r"\s+").alias("t"))
    row = tokens.select(F.slice("t", 1, 12).alias("h")).first()["h"]
    head = {row[i].lower(): float(row[i + 1]) for i in range(0, 12, 2) if not row[i].lstrip("+-").replace(".", "", 1).isdigit()}
    w, h, size = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    half = 0.0 if "xllcenter" in head else size / 2
    x0, y0 = head.get("xllcenter", head.get("xllcorner", 0.0)) + half, head.get("yllcenter", head.get("yllcorner", 0.0)) + half
    nodata = head.get("nodata_value")
    skip = 2 * len(head)
    v = tokens.select(F.posexplode(F.slice("t", skip + 1, w * h)).alias("i", "text")).select(F.expr(f"i div {w}").alias("row"), (F.col("i") % w).cast("long").alias("col"), F.col("text").cast("double").alias("z"))
    z = F.col("z") if nodata is None else F.when(F.col("z") != nodata, F.col("z"))
    return Grid(v.select("row", "col", z.alias("z")), GridMeta(w, h, (x0, size, 0.0, y0 + (h - 1) * size, 0.0, -size)))


def write_ascii_grid(grid: Grid, path: str, *, nodata: float = -9999.0) -> None:
    """One ESRI ASCII file: a line a row, from north to south. The format has square cells without rotation, and one file."""
    m = grid.meta
    if m.gt[2] or m.gt[4] or m.gt[1] <= 0 or abs(m.gt[5]) != m.gt[1]:
        raise InvalidArgument("an ASCII grid needs square cells along the axes")
    low = min(m.gt[3], m.gt[3] + (m.height - 1) * m.gt[5])
    head = [f"ncols {m.width}", f"nrows {m.height}", f"xllcenter {m.gt[0]!r}", f"yllcenter {low!r}", f"cellsize {m.gt[1]!r}", f"NODATA_value {nodata!r}"]
    spark = grid.df.sparkSession
    top = spark.createDataFrame([(i - len(head), v) for i, v in enumerate(head)], "at long, value string")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", "z"))), lambda c: F.coalesce(c["z"], F.lit(nodata)).cast("string"))
    at = F.col("row") if m.gt[5] < 0 else F.lit(m.height - 1) - F.col("row")
    lines = grid.df.groupBy(at.cast("long").alias("at")).agg(F.concat_ws(" ", cells).alias("value"))
    top.unionByName(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(path)


FEATURE = "struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, elevation, closed, pts) of the LineString and MultiLineString features of a GeoJSON file; others are skipped.

    The elevation is the property of that name, or the first point's height.
    """
    f = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features: array<{FEATURE}>>").alias("j")).select(F.posexplode("j.features").alias("fid", "f"))
    p = _feature_lines(f)
    return p.select((F.col("fid") * 1_000_000 + F.col("part")).cast("long").alias("line_id"), "elevation", "closed", "pts")


def read_geojson_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, part, elevation, closed, pts) of the line features of files with one feature on each line, read in parallel.

    ``line_id`` is the property of that name, null without it.
    """
    f = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.from_json("value", FEATURE).alias("f"))
    p = _feature_lines(f.withColumn("fid", F.try_element_at("f.properties", F.lit("line_id")).cast("long")))
    return p.select(F.col("fid").alias("line_id"), "part", "elevation", "closed", "pts")


def _feature_lines(f: DataFrame) -> DataFrame:
    """(fid, part, elevation, closed, pts) of features (fid, f)."""
    one = F.from_json("f.geometry.coordinates", "array<array<double>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    lines = F.when(F.col("f.geometry.type") == "LineString", F.array(one)).when(F.col("f.geometry.type") == "MultiLineString", many)
    p = f.where(lines.isNotNull()).select("fid", F.col("f.properties").alias("props"), F.posexplode(lines).alias("part", "c"))
    level = F.coalesce(F.try_element_at("props", F.lit("elevation")).cast("double"), F.get(F.col("c")[0], F.lit(2)))
    level = F.coalesce(level, F.raise_error(F.lit("a line has no elevation")).cast("double"))
    closed = F.coalesce(F.try_element_at("props", F.lit("closed")).isin("1", "true"), (F.col("c")[0][0] == F.element_at("c", -1)[0]) & (F.col("c")[0][1] == F.element_at("c", -1)[1]))
    p = p.withColumn("elevation", level)
    pts = F.transform("c", lambda v: F.struct(v[0].alias("x"), v[1].alias("y"), F.coalesce(F.get(v, F.lit(2)), F.col("elevation")).alias("z")))
    return p.select("fid", "part", "elevation", closed.alias("closed"), pts.alias("pts"))


def write_geojson_lines(lines: DataFrame, path: str) -> None:
    """One feature a line (newline-delimited GeoJSON)."""
    pts = F.transform("pts", lambda p: F.array(p["x"], p["y"], p["z"]))
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), pts.alias("coordinates")).alias("geometry"), F.struct("elevation", "closed", "line_id").alias("properties"))
    lines.select(F.to_json(f)).write.text(path)


#: Formats by name: (reader, writer), where there is one.
FORMATS = {
    "xyz": (read_xyz, write_xyz), "grid": (read_grid, write_grid), "mesh": (read_mesh, write_mesh), "contours": (read_lines, write_lines),
    "constraints": (read_constraints, write_constraints), "asciigrid": (read_ascii_grid, write_ascii_grid), "geojson": (read_geojson_lines, write_geojson_lines),
}


def is_available(name: str) -> bool:
    return name in FORMATS


