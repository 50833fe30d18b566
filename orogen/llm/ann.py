"""Approximate nearest neighbours by an adaptive scan of rotated dimensions.

An inverted file splits the vectors into lists around centroids. Within each
probed list the vectors, turned by a random rotation, lie in blocks of columns;
after each block a hypothesis test on the partial distance abandons candidates
that are too far to be among the k nearest. What is left is scored exactly on
the original vectors. Largest inner products are smallest distances once a
component is added that gives all vectors the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import mix64, stored
from orogen.llm.vectors import best, matrix, pack, unpack, usable

#: Vectors that the index is fitted on at most, about.
SAMPLE_ROWS = 8_192
#: Rows of a packed part of a list; queries of a packed batch; dimensions of a column block.
PART, BATCH, COLUMNS = 4_096, 1_024, 16
#: Query batches that a task holds at once.
TOGETHER = 16
#: Confidence of the hypothesis test: larger values abandon fewer candidates.
EPSILON = 2.1
#: Part of the k nearest that probing alone must find on the sample.
PROBE_RECALL = 0.97
MOST_LISTS = 1_024
#: So many times the lists are probed again for queries that have fewer than k rows.
WIDER = 4


@dataclass
class Index:
    """What every task needs; its size depends on the parameters and the dimension only."""

    width: int
    length: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray

    def lifted(self, x: np.ndarray, *, query: bool = False) -> np.ndarray:
        """Vectors with the added component."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.length**2 - (x**2).sum(1), 0))
        return np.concatenate((x, rest[:, None]), 1)

    def nearness(self, lifted: np.ndarray) -> np.ndarray:
        """Half squared distances to the centroids, but for a constant of each row."""
        return 0.5 * (self.centroids**2).sum(1) - lifted @ self.centroids.T

    def reach(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """Squared distances that no query's k-th nearest exceeds, from the sample.

        The 2k-th nearest of the sample leaves room for candidates that a test
        abandons wrongly.
        """
        k = 2 * k
        squares = distances(self.lifted(x, query=True), self.lifted(self.sample))
        squares[ids[:, None] == self.sample_ids[None, :]] = np.inf
        if squares.shape[1] < k:
            return np.full(len(x), np.inf)
        return np.partition(squares, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12


def dealt(rows: DataFrame) -> DataFrame:
    """Adds ``deal``, a number below 2**40 that differs between rows, equal ones too; fixed once it is written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            number = mix64(np.arange(at, at + len(b), dtype=np.uint64))
            b["deal"] = (number >> np.uint64(24)).astype(np.int64)
            at += len(b)
            yield b

    return rows.mapInPandas(run, "id long, vector array<double>, deal long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


def fit(rows: DataFrame, k: int, seed: int = 11) -> Index | None:
    """Centroids, rotation and number of probes from a bounded sample of (id, vector, deal) rows."""
    n, length, width = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))), F.max(F.size("vector"))).first()
    if not n:
        return None
    # Rows are drawn one by one, so the sample's size varies by some roots of SAMPLE_ROWS only.
    draw = F.col("deal") / float(1 << 40)
    chosen = rows.where(draw < min(1.0, SAMPLE_ROWS / n)).toPandas()
    if not len(chosen):
        chosen = rows.limit(1).toPandas()
    chosen = chosen.sort_values(["id", "deal"])
    rng = np.random.default_rng(seed)
    sample_ids, sample = chosen["id"].to_numpy(), matrix(chosen["vector"], width)
    rotation = np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0]
    index = Index(width, float(length) * (1 + 1e-12), rotation, np.zeros((1, width + 1)), 1, sample_ids, sample)
    lifted = index.lifted(sample)
    lists = int(min(MOST_LISTS, max(1, round(np.sqrt(n) / 4)), len(sample)))
    index.centroids = lifted[rng.choice(len(lifted), lists, replace=False)]
    for _ in range(12):
        home = index.nearness(lifted).argmin(1)
        size = np.bincount(home, minlength=lists)
        for c in np.flatnonzero(size):
            index.centroids[c] = lifted[home == c].mean(0)
        for c in np.flatnonzero(size == 0):
            index.centroids[c] = lifted[rng.integers(len(lifted))]
    index.probes = probes(index, lifted, rng, k)
    return index


def probes(index: Index, lifted: np.ndarray, rng: np.random.Generator, k: int) -> int:
    """Fewest lists that hold PROBE_RECALL of the k nearest of sampled queries."""
    asked = rng.choice(len(lifted), min(256, len(lifted)), replace=False)
    queries = index.lifted(index.sample[asked], query=True)
    squares = distances(queries, lifted)
    squares[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(squares, 1)[:, : min(k, max(1, len(lifted) - 1))]
    rank = np.argsort(np.argsort(index.nearness(queries), 1), 1)
    home = index.nearness(lifted).argmin(1)
    at = np.take_along_axis(rank, home[near], 1)
    for p in range(1, len(index.centroids)):
        if (at < p).mean() >= PROBE_RECALL:
            return p
    return len(index.centroids)


def scan(index: Index, ids: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, reach: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Candidates of one part of a list for a batch of queries, k at most for each."""
    turned = (index.lifted(cells) @ index.rotation).T  # dimensions by vectors: column blocks are contiguous
    asked = index.lifted(queries, query=True) @ index.rotation
    total = len(turned)
    partial = np.zeros((len(asked), len(ids)))
    alive = ids[None, :] != query_ids[:, None]
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for at in range(0, total, COLUMNS):
        block, mine = turned[at : at + COLUMNS], asked[:, at : at + COLUMNS]
        seen = min(at + COLUMNS, total)
        test = 1.0 if seen == total else (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / total
        if pairs is None:
            partial += distances(mine, block.T)
            alive &= partial <= (reach * test)[:, None] + 1e-9
            if alive.mean() < 0.1:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            partial += ((mine[pairs[0]] - block.T[pairs[1]]) ** 2).sum(1)
            keep = partial <= reach[pairs[0]] * test + 1e-9
            pairs, partial = (pairs[0][keep], pairs[1][keep]), partial[keep]
    if pairs is None:
        pairs = np.nonzero(alive)
    q, v = pairs
    # Each sum runs over the components in their order.
    score = np.zeros(len(q))
    for at in range(0, len(q), 1 << 16):
        part = slice(at, at + (1 << 16))
        score[part] = np.cumsum(queries[q[part]] * cells[v[part]], axis=1)[:, -1]
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return pd.DataFrame({"query_id": query_ids[q[keep]], "vec_id": ids[v[keep]], "score": score[keep]})


def neighbours(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found: ``query_id``, ``rank``, ``vec_id``, ``score`` (inner product).

    ``is_query`` maps the id column to the condition that a row is a query. A
    row with a query's id is no candidate of it; other rows that share an id
    all are. Queries with equal ids and vectors count as one, those with equal
    ids and several vectors are ranked together.
    Zero vectors and those named in :func:`usable` take no part. Every other
    row is indexed; a list of any size is scanned in parts. Queries that the
    probed lists leave short are asked again over more lists, at last over all
    without a test, so fewer than k rows mean that there are no more
    candidates; an empty table gives none.
    """
    spark = df.sparkSession
    rows = stored(dealt(usable(df, id_col, vector_col, nonzero=True)), "ann")
    index = fit(rows, k)
    if index is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            if len(b):
                b["list"] = own.nearness(own.lifted(matrix(b["vector"], own.width))).argmin(1)
            else:
                b["list"] = pd.Series(dtype="int64")
            yield b[["id", "vector", "deal", "list"]]

    placed = stored(rows.mapInPandas(place, "id long, vector array<double>, deal long, list int"), "ann-lists")
    # One row a list, MOST_LISTS at most, whatever the input.
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {c: -(-n // PART) for c, n in sizes.items()}
    wanted, every = min(k, sum(sizes.values()) - 1), len(index.centroids)
    asked = rows.where(is_query(F.col("id"))).groupBy("id", "vector").agg(F.min("deal").alias("deal"))
    probes, done, tested = index.probes, None, True
    while True:
        found = best(searched(placed, asked, parts, shared, k, probes, tested), k)
        if not tested:
            return found if done is None else done.unionByName(found)
        found = stored(found, "ann-found")
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= wanted).select(F.col("query_id").alias("id"))
        short = stored(asked.join(enough, "id", "left_anti"), "ann-short") if wanted > 0 else asked.limit(0)
        full = found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(found.columns)
        done = full if done is None else done.unionByName(full)
        if not short.limit(1).count():
            return done
        asked, tested, probes = short, probes < every, min(every, WIDER * probes)


def searched(placed: DataFrame, asked: DataFrame, parts: dict[int, int], shared: Broadcast, k: int, probes: int, tested: bool) -> DataFrame:
    """(query_id, vec_id, score) that scans of each query's ``probes`` nearest lists give; without tests all that they hold."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            if len(b):
                x = matrix(b["vector"], own.width)
                b["reach"] = own.reach(b["id"].to_numpy(), x, k) if tested else np.inf
                b["list"] = list(np.argsort(own.nearness(own.lifted(x, query=True)), 1, kind="stable")[:, :probes])
                yield b[["id", "vector", "deal", "reach", "list"]]

    asked = asked.mapInPandas(probe, "id long, vector array<double>, deal long, reach double, list array<int>")
    asked = stored(asked.select("id", "vector", "deal", "reach", F.explode("list").alias("list")), "ann-queries")
    batches = {r["list"]: -(-r["n"] // BATCH) for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = lambda sizes: F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, n)])[F.col("list")] if sizes else F.lit(1)

    def whole(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "deal"])
        return pd.DataFrame([{"list": key[0], "part": key[1]} | pack(b["id"].to_numpy(), matrix(b["vector"], shared.value.width))])

    def batch(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        p = pack(b["id"].to_numpy(), matrix(b["vector"], shared.value.width))
        return pd.DataFrame([{"list": key[0], "batch": key[1], "q_ids": p["ids"], "q_cells": p["cells"], "reach": b["reach"].to_numpy().tobytes()}])

    salt = lambda sizes: F.pmod(F.xxhash64("deal"), pieces(sizes)).cast("int")
    lists = placed.withColumn("part", salt(parts)).groupBy("list", "part").applyInPandas(whole, "list int, part int, width int, ids binary, cells binary")
    queries = asked.withColumn("batch", salt(batches)).groupBy("list", "batch").applyInPandas(batch, "list int, batch int, q_ids binary, q_cells binary, reach binary")
    queries = queries.withColumn("meeting", F.floor(F.col("batch") / TOGETHER).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(pieces(parts), F.lit(1)) - 1)))
    meetings = F.coalesce(F.floor((pieces(batches) - 1) / TOGETHER), F.lit(0)).cast("int")
    lists = lists.select("list", "part", "ids", "cells", F.explode(F.sequence(F.lit(0), meetings)).alias("meeting"))

    def run(lists: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        own = shared.value
        out = [pd.DataFrame({"query_id": np.empty(0, "int64"), "vec_id": np.empty(0, "int64"), "score": np.empty(0)})]
        for part in lists.itertuples():
            ids, cells = unpack(part.ids, part.cells, own.width)
            for r in queries.itertuples():
                query_ids, asked = unpack(r.q_ids, r.q_cells, own.width)
                out.append(scan(own, ids, cells, query_ids, np.frombuffer(r.reach), asked, k))
        return pd.concat(out)

    key = ("list", "part", "meeting")
    return lists.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
