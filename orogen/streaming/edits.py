"""Edits of vertices and constraints as a stream: each micro-batch is one generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def folded(log: DataFrame) -> DataFrame:
    """(id, x, y, z) after an ordered log (order, op, id, x, y, z): the last edit of each vertex holds, removed ones go."""
    last = log.groupBy("id").agg(F.max_by(F.struct("op", "x", "y", "z"), "order").alias("e"))
    return last.where(F.col("e.op") != "remove").select("id", "e.x", "e.y", "e.z")


def latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's last edit of every vertex, with its generation, to a table."""

    def write(batch: DataFrame, generation: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct("order", "op", "x", "y", "z"), "order").alias("e"))
        last.select(F.lit(generation).cast("long").alias("generation"), "id", "e.*").write.mode("overwrite").parquet(f"{path}/generation={generation}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(stream: DataFrame, time_col: str, delay: str, width: str, value_col: str = "value") -> DataFrame:
    """Observations per time window, late ones within the delay: count, mean and range of the value."""
    w = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"), F.min(value_col).alias("low"), F.max(value_col).alias("high")).select(F.col("w.start").alias("start"), "n", "mean", "low", "high")


def applied(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``apply`` with each micro-batch and its generation; a batch seen again has the same generation."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
