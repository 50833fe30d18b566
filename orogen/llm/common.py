"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without one (a test) gets a folder of this machine;
    on a cluster a missing setting is an error, as executors elsewhere couldn't
    read what others write.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "orogen-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for one run's table ``name`` in the shared folder."""
    return f"{shared_dir(spark)}/orogen-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again.

    This cuts the lineage at a place that outlives any executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`stored`."""
    spark = df.sparkSession
    for f in {os.path.dirname(p) for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch of whole texts; a batch lies in memory on both sides.
BATCH_ROWS = 1_000


def texts_to_python(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, unless somebody has set their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def tidy(batches: Iterator[T]) -> Iterator[T]:
    """The batches; once they end, memory that the Python worker holds in reserve goes back to the system.

    Workers live on between tasks, so what one stage leaves in them adds to
    the next one's needs.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return None


_TRIM = _trim()


def text_of(column: str) -> Column:
    """The column, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % F.lit(modulus)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of unsigned 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bytes of the contract's word separators: space and 0x09 to 0x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
#: Bytes hashed at a time; it bounds the tables and the temporary arrays.
STRETCH = 1 << 18


def _powers(base: int) -> np.ndarray:
    steps = np.full(STRETCH + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def parts(data: np.ndarray, blank: np.ndarray) -> Iterator[np.ndarray]:
    """``data`` in stretches of at most STRETCH bytes, longer only where a run without ``blank`` is longer."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + STRETCH)
        if end < n:
            gaps = np.flatnonzero(blank[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one run from the start: it ends at the next blank
                while end < n:
                    gaps = np.flatnonzero(blank[data[end : end + STRETCH]])
                    if len(gaps):
                        end += int(gaps[0])
                        break
                    end = min(n, end + STRETCH)
        yield data[at:end]
        at = end


def word_hashes(data: np.ndarray, blank: np.ndarray, prefixes: tuple[int, ...] = (), fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each maximal run of bytes that are not ``blank``, in order.

    Prefix sums of a polynomial modulo 2**64 give every run's hash in a few
    vector operations, so that no word becomes a Python object. For each length
    in ``prefixes`` the hashes of that many first bytes of longer runs follow
    those of their stretch. ``fold`` maps bytes before they are hashed. Long
    data are read in stretches, so only the hashes grow with it.
    """
    out = [_hashes(p if fold is None else fold[p], blank, prefixes) if len(p) <= STRETCH else _long_run(p, fold, prefixes) for p in parts(data, blank)]
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _finish(value: np.ndarray, length: np.ndarray, prefix: int = 0) -> np.ndarray:
    # The mark keeps prefixes apart from whole words and from one another.
    mark = np.uint64(prefix << 16)
    return mix64(value ^ (length.astype(np.uint64) << np.uint64(48)) ^ (mark << np.uint64(40)))


def _hashes(data: np.ndarray, blank: np.ndarray, prefixes: tuple[int, ...]) -> np.ndarray:
    n = len(data)
    inside = ~blank[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(n + 1, dtype=np.uint64)
    out = []
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWER[:n], out=sums[1:])
        for length in (0, *prefixes):
            longer = end - start > length if length else slice(None)
            s, e = start[longer], start[longer] + length if length else end
            out.append(_finish((sums[e] - sums[s]) * _INVERSE[s], e - s, length))
    return np.concatenate(out)


def _long_run(data: np.ndarray, fold: np.ndarray | None, prefixes: tuple[int, ...]) -> np.ndarray:
    """Hashes of one run that is longer than a stretch: the same polynomial, summed part by part."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), STRETCH):
            part = data[at : at + STRETCH] if fold is None else fold[data[at : at + STRETCH]]
            own = ((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)]).sum(dtype=np.uint64)
            total = total + own * np.uint64(pow(_BASE, at, 1 << 64))
        whole = _finish(np.array([total]), np.array([len(data)]))
    head = data[: max(prefixes, default=0) + 1]
    begun = _hashes(head if fold is None else fold[head], _NEVER, prefixes)[1:]
    return np.concatenate((whole, begun))


_NEVER = np.zeros(256, dtype=bool)
