"""Meshes that are edited in place by name, for callers used to a flat interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen import scratch
from orogen.errors import InvalidArgument
from orogen.functions.geometry import num
from orogen.operators import cdt
from orogen.operators import mesh as tin
from orogen.schema import Mesh
from orogen.sources import tables


class MeshSession:
    """Holds the current mesh; each edit replaces it and counts a generation."""

    def __init__(self, spark: SparkSession, points: DataFrame | None = None) -> None:
        self.spark = spark
        self.mesh = tin.build(points if points is not None else spark.createDataFrame([], "id long, x double, y double, z double"))

    def insert(self, x: float, y: float, z: float) -> DataFrame:
        """Adds a point; gives what changed."""
        if not self.mesh.triangles.limit(1).count():
            n = self.mesh.vertices.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            points = self.mesh.vertices.unionByName(self.spark.createDataFrame([(n + 1, float(x), float(y), float(z))], self.mesh.vertices.schema))
            before, self.mesh = self.mesh, tin.build(points, self.mesh.crs)
            return self.mesh.triangles.join(before.triangles, ["a", "b", "c"], "left_anti").select(F.lit("added_triangle").alias("change"), "a", "b", "c")
        self.mesh, effect = tin.insert_point(self.mesh, x, y, z)
        return effect

    def delete_near(self, x: float, y: float) -> DataFrame:
        self.mesh, effect = tin.delete_nearest(self.mesh, x, y)
        return effect

    def clear(self) -> None:
        self.mesh = Mesh(self.mesh.vertices.where("false"), self.mesh.triangles.where("false"), self.mesh.crs, self.mesh.generation + 1)

    def save(self, path: str) -> None:
        tables.save_mesh(self.mesh.vertices, path)

    def load(self, path: str) -> None:
        self.mesh = tin.build(tables.load_mesh_points(self.spark, path), self.mesh.crs)

    def in_view(self, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
        return tin.window(self.mesh.triangles, xmin, ymin, xmax, ymax)

    def nearest(self, x: float, y: float) -> tuple[float, float, float]:
        r = self.mesh.vertices.where(F.col("id") == tin.nearest_vertex(self.mesh, x, y)).first()
        return r["x"], r["y"], r["z"]

    def covering_triangle(self, x: float, y: float) -> DataFrame:
        """The triangle that has the point strictly inside; none for points on edges, vertices or outside."""
        if not all(abs(v) < float("inf") for v in (x, y)):
            raise InvalidArgument("the point must be finite")
        asked = self.spark.range(1).select(F.col("id").alias("qid"), num(x).alias("x"), num(y).alias("y"))
        return tin.hits(self.mesh.triangles, asked).where("wa > 0 and wb > 0 and wc > 0").select("a", "b", "c")


class ConstrainedSession:
    """A constrained mesh and its Delaunay mesh, kept as tables from edit to edit.

    Breaklines under the policy ``reject`` are put in locally where they bring
    at most ``most_local`` new vertices: each changes its conflict region of the
    kept Delaunay mesh. Every other edit triangulates all vertices again. Both
    ways the segments are then recovered in the triangles that they cross, so
    the mode decides the work and not the mesh. A refused edit changes nothing.
    """

    def __init__(self, points: DataFrame, constraints: DataFrame, crs: str = "", *, policy: str = "reject", z_tolerance: float = 1e-9, most_local: int = 16) -> None:
        self.points, self.crs, self.policy, self.z_tolerance, self.most_local = points, crs, policy, z_tolerance, most_local
        self.mode, self.local_edits, self.full_rebuilds, self.generation = "none", 0, 0, 0
        self._rebuild(constraints)
        self.mode, self.full_rebuilds, self.generation = "none", 0, 1

    def insert(self, constraints: DataFrame) -> DataFrame:
        """Adds constraints with ids of their own; gives the triangles that changed."""
        if constraints.select("cid").join(self.constraints.select("cid"), "cid", "left_semi").limit(1).count():
            raise InvalidArgument("a constraint has this id")
        before, every = self.mesh, self.constraints.unionByName(constraints.select(self.constraints.columns))
        fresh = constraints.select("x", "y", "z").join(self.plain.vertices.select("x", "y"), ["x", "y"], "left_anti").groupBy("x", "y").agg(F.min("z").alias("z"))
        lines = not constraints.where(F.col("kind") != cdt.BREAKLINE).limit(1).count()
        if not (lines and self.policy == "reject" and self.plain.triangles.limit(1).count()):
            self._rebuild(every)
            return cdt.difference(before.triangles, self.mesh.triangles)
        places = sorted(map(tuple, fresh.limit(self.most_local + 1).collect()))
        if len(places) > self.most_local:
            self._rebuild(every)
            return cdt.difference(before.triangles, self.mesh.triangles)
        used, plain = cdt.checked(every, policy=self.policy, z_tolerance=self.z_tolerance), self.plain
        for x, y, z in places:
            plain = self._stored(tin.insert_point(plain, x, y, z)[0])
        self._take(every, plain, used)
        self.mode, self.local_edits = "local", self.local_edits + 1
        return cdt.difference(before.triangles, self.mesh.triangles)

    def update(self, constraints: DataFrame) -> DataFrame:
        """Puts constraints in place of those with their ids; gives the triangles that changed."""
        if constraints.select("cid").join(self.constraints.select("cid"), "cid", "left_anti").limit(1).count():
            raise InvalidArgument("no constraint has this id")
        before, rest = self.mesh, self.constraints.join(constraints.select("cid"), "cid", "left_anti")
        self._rebuild(rest.select(self.constraints.columns).unionByName(constraints.select(self.constraints.columns)))
        return cdt.difference(before.triangles, self.mesh.triangles)

    def remove(self, cid: int) -> DataFrame:
        """Takes a constraint out, with its vertices that no other has; gives the triangles that changed."""
        if not self.constraints.where(F.col("cid") == cid).limit(1).count():
            raise InvalidArgument("no constraint has this id")
        before = self.mesh
        self._rebuild(cdt.remove_constraint(self.constraints, cid))
        return cdt.difference(before.triangles, self.mesh.triangles)

    def metrics(self) -> dict[str, int | str]:
        return {"mode": self.mode, "local_edits": self.local_edits, "full_rebuilds": self.full_rebuilds, "generation": self.generation}

    def validate(self) -> bool:
        r = cdt.validate(self.mesh, self.marked, self.used).first()
        return r["euler"] and not (r["crowded_edges"] or r["missing_segments"] or r["wrongly_marked"])

    def _rebuild(self, constraints: DataFrame) -> None:
        used = cdt.checked(constraints, policy=self.policy, z_tolerance=self.z_tolerance)
        self._take(constraints, self._stored(tin.build(cdt.with_places(self.points, used), self.crs)), used)
        self.mode, self.full_rebuilds = "full", self.full_rebuilds + 1

    def _take(self, constraints: DataFrame, plain: Mesh, used: DataFrame) -> None:
        mesh, marked, used = cdt.constrain(plain, used)
        marked = self._table(marked)
        self.mesh = Mesh(plain.vertices, marked.drop("in_domain"), self.crs, self.generation + 1)
        self.constraints, self.plain, self.marked, self.used = constraints, plain, marked, used
        self.generation += 1

    def _stored(self, mesh: Mesh) -> Mesh:
        return Mesh(self._table(mesh.vertices), self._table(mesh.triangles), mesh.crs, mesh.generation)

    def _table(self, df: DataFrame) -> DataFrame:
        path = scratch.path(df.sparkSession, "session")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
