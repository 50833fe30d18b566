"""Cleaning and packing of vector tables for the two vector searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, *, nonzero: bool = False) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part, as many as there are.

    Rows with a null id, a null vector or a null, NaN or infinite component
    don't. Rows that share an id all take part. ``nonzero`` also leaves out
    zero and empty vectors.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad)
    return rows.where(F.exists("vector", lambda x: x != 0)) if nonzero else rows


def matrix(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    width = max((len(v) for v in vectors), default=0) if width is None else width
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


PACK = "pack long, width int, ids binary, cells binary"


def pack(ids: np.ndarray, cells: np.ndarray) -> dict:
    return {"width": cells.shape[1], "ids": ids.astype(np.int64).tobytes(), "cells": np.ascontiguousarray(cells, dtype=np.float64).tobytes()}


def unpack(ids: bytes, cells: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype=np.int64)
    return i, np.frombuffer(cells, dtype=np.float64).reshape(len(i), width)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, vector) in runs of at most ``most``, each one row of :data:`PACK`; ``pack`` numbers them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            while len(batch):
                take = batch.iloc[: most - size]
                batch = batch.iloc[len(take) :]
                held.append(take)
                size += len(take)
                if size == most:
                    yield one(held, number)
                    held, size, number = [], 0, number + 1
        if size:
            yield one(held, number)

    def one(held: list[pd.DataFrame], number: int) -> pd.DataFrame:
        part = pd.concat(held)
        return pd.DataFrame([{"pack": number} | pack(part["id"].to_numpy(), matrix(part["vector"]))])

    return rows.select("id", "vector").mapInPandas(run, PACK)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k largest scores of each query with their ranks, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
