"""Tiles of views in a folder that outlives the session: an append-only table of records, of which a tile's last one counts.

A record counts once its checksum is in the table of sums, which is written
after it, so what a lost job leaves behind is never read. The head names the
grid's fingerprint and the generation of files in use.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.errors import CorruptedData, InvalidArgument, StaleQuery
from orogen.operators.view import Window4, fingerprint, lod_scale, read_view, tile_table
from orogen.schema import Grid

KEY = ["tile_row", "tile_col"]
CELL = [*KEY, "h", "w", "oh", "ow", "r", "c", "value"]


def checksums(cells: DataFrame) -> DataFrame:
    """Per tile the number of its cells and a checksum of them, whatever their order in files."""
    one = F.pmod(F.xxhash64("r", "c", "value"), F.lit(1 << 31))
    return cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cells"), F.sum(one).alias("checksum"))


class TilePackage:
    """Tiles of one grid in the folder ``path``, made when first asked for and kept for later sessions.

    ``on_stale`` and ``on_corrupt`` are ``error`` or ``reset``: a package of
    another grid is refused or emptied; tiles with a wrong checksum are refused
    or made anew, only those. Checksums are compared when a level is first read
    in a session. One session writes at a time.
    """

    def __init__(self, grid: Grid, path: str, *, on_stale: str = "error", on_corrupt: str = "error") -> None:
        if {on_stale, on_corrupt} - {"error", "reset"}:
            raise InvalidArgument("a policy is 'error' or 'reset'")
        self.grid, self.path, self.on_corrupt = grid, path.rstrip("/"), on_corrupt
        self.spark: SparkSession = grid.df.sparkSession
        self.verified: set[tuple[int, int]] = set()
        self.hits = self.misses = self.stale = self.corrupted = 0
        self.fingerprint = fingerprint(grid).first()["fingerprint"]
        head = self._head()
        self.generation = head["generation"] if head else 0
        if head and head["fingerprint"] == self.fingerprint:
            return
        if head:
            if on_stale == "error":
                raise StaleQuery("the tiles are of another grid")
            self.stale += 1
            self._delete(self._files())
            self.generation += 1
        self._commit()

    def tiles(self, scale: int, side: int = 128) -> DataFrame:
        """The tile table of a scale, made and kept if it isn't there yet."""
        if not self._known(scale, side):
            self.misses += 1
            self._append(tile_table(self.grid, scale, side), scale, side)
        else:
            self.hits += 1
            if (scale, side) not in self.verified:
                self._mend(scale, side)
        self.verified.add((scale, side))
        return self._read(scale, side)

    def read(self, window: Window4, out_width: int, out_height: int, side: int = 128) -> DataFrame:
        """(out_row, out_col, value) of a window, as :func:`read_view` gives it."""
        scale = lod_scale(window, out_width, out_height)
        return read_view(self.grid, window, out_width, out_height, scale, side, self.tiles(scale, side))

    def broken(self, scale: int, side: int = 128) -> DataFrame:
        """Keys of tiles that don't have their stored checksum, lost ones too."""
        now = checksums(self._read(scale, side)).select(*KEY, F.struct("cells", "checksum").alias("now"))
        then = self._last(scale, side).select(*KEY, F.struct("cells", "checksum").alias("then"))
        return then.join(now, KEY, "left").where(~F.col("now").eqNullSafe(F.col("then"))).select(*KEY)

    def compact(self) -> None:
        """Keeps the last record of every tile, in files of a new generation; the head then names it."""
        old = self._files()
        levels = self._table("sums").select("scale", "side").distinct().collect() if self._exists(f"{old}/sums") else []
        kept = [(r["scale"], r["side"], self._read(r["scale"], r["side"]), self._last(r["scale"], r["side"])) for r in levels]
        self.generation += 1
        self._delete(self._files())
        for scale, side, cells, sums in kept:
            level = F.lit(scale).alias("scale"), F.lit(side).alias("side")
            cells.join(sums.select(*KEY, "version"), KEY).select(*level, "version", *CELL).write.mode("append").parquet(f"{self._files()}/records")
            sums.select(*level, "version", *KEY, "cells", "checksum").write.mode("append").parquet(f"{self._files()}/sums")
        self._commit()
        self._delete(old)

    def statistics(self) -> dict[str, int]:
        """What this session found, and the records and tiles that the folder holds."""
        counts = self._table("sums").agg(F.count(F.lit(1)), F.count_distinct("scale", "side", *KEY)).first() if self._exists(f"{self._files()}/sums") else (0, 0)
        return {"hits": self.hits, "misses": self.misses, "stale": self.stale, "corrupted": self.corrupted, "records": counts[0], "tiles": counts[1]}

    def _mend(self, scale: int, side: int) -> None:
        bad = self.broken(scale, side)
        n = bad.count()
        if not n:
            return
        if self.on_corrupt == "error":
            raise CorruptedData(f"{n} tiles have a wrong checksum")
        self.corrupted += n
        self._append(tile_table(self.grid, scale, side).join(bad, KEY, "left_semi"), scale, side)

    def _append(self, cells: DataFrame, scale: int, side: int) -> None:
        """Records of a version above all that the folder has, a lost job's too, then their sums, which make them count."""
        level = F.lit(scale).alias("scale"), F.lit(side).alias("side")
        files = f"{self._files()}/records"
        before = self._level("records", scale, side).agg(F.max("version")).first()[0] if self._exists(files) else None
        version = (before or 0) + 1
        cells.select(*level, F.lit(version).cast("long").alias("version"), *CELL).repartitionByRange(*KEY).write.mode("append").parquet(files)
        written = checksums(self._level("records", scale, side).where(F.col("version") == version))
        written.select(*level, F.lit(version).cast("long").alias("version"), *KEY, "cells", "checksum").write.mode("append").parquet(f"{self._files()}/sums")

    def _known(self, scale: int, side: int) -> bool:
        return self._exists(f"{self._files()}/sums") and bool(self._level("sums", scale, side).take(1))

    def _last(self, scale: int, side: int) -> DataFrame:
        sums = self._level("sums", scale, side)
        return sums.groupBy(*KEY).agg(F.max_by(F.struct("version", "cells", "checksum"), "version").alias("s")).select(*KEY, "s.*")

    def _read(self, scale: int, side: int) -> DataFrame:
        records = self._level("records", scale, side)
        return records.join(self._last(scale, side).select(*KEY, "version"), [*KEY, "version"], "left_semi").select(*CELL)

    def _table(self, name: str) -> DataFrame:
        schema = "scale int, side int, version long, tile_row long, tile_col long, "
        schema += "h long, w long, oh long, ow long, r long, c long, value double" if name == "records" else "cells long, checksum long"
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", name == "records").option("ignoreMissingFiles", name == "records").parquet(f"{self._files()}/{name}")

    def _level(self, name: str, scale: int, side: int) -> DataFrame:
        return self._table(name).where((F.col("scale") == scale) & (F.col("side") == side))

    def _files(self) -> str:
        return f"{self.path}/generation={self.generation}"

    def _head(self) -> dict | None:
        if not self._exists(f"{self.path}/head"):
            return None
        heads = [json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/head").collect()]
        return max(heads, key=lambda h: h["generation"], default=None)

    def _commit(self) -> None:
        head = json.dumps({"generation": self.generation, "fingerprint": self.fingerprint})
        self.spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/head")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
