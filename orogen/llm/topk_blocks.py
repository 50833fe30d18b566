"""Exact top-k inner products with block-at-a-time pruning.

Documents (vectors of integer term weights) lie in ranges of ids. Of each range
the largest and smallest weight of every term is known. A query orders ranges
by the sum of its terms' best possible contributions and scores them through
the range's forward index, until the next range's bound falls below its k-th
score. Ranges are packed into shards, which have bounds too: every query first
visits the few shards with its highest bounds, and then only those whose bound
reaches the k-th score that it has found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.llm.common import stored
from orogen.llm.vectors import best, packed, unpack, usable

#: Documents of a range, ranges of a shard, queries of a batch, shards whose bounds are looked at together.
BLOCK, SHARD, BATCH, BOUNDS = 128, 64, 512, 1_024
#: Shards that every query visits first.
FIRST = 1
#: Batches that a task holds at once, about.
TOGETHER = 32
LONG = np.iinfo(np.int64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of integer-valued doubles, exactly; beyond a long they saturate."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[min(max(sum(x * y for x, y in zip(p, q, strict=True)), LONG.min), LONG.max) for q in whole[1]] for p in whole[0]], dtype=np.int64).reshape(len(a), len(b))


def widened(cells: np.ndarray, width: int) -> np.ndarray:
    return cells if cells.shape[1] == width else np.pad(cells, ((0, 0), (0, width - cells.shape[1])))


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no document can exceed that lies between ``low`` and ``high``, by query; a hair above it, so that rounding hides nothing."""
    width = max(high.shape[1], queries.shape[1])
    queries, high, low = widened(queries, width), widened(high, width), widened(low, width)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return bound + np.abs(bound) * 1e-9


def search(doc_ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of one shard: query places, document ids and scores of each query's k best, and blocks scored.

    Scores below ``least`` (by query) aren't looked for.
    """
    width = max(docs.shape[1], queries.shape[1])
    docs, queries = widened(docs, width), widened(queries, width)
    starts = range(0, len(docs), block)
    high = np.array([docs[s : s + block].max(0) for s in starts])
    low = np.array([docs[s : s + block].min(0) for s in starts])
    bound = bounds(queries, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(queries), k), LONG.min, dtype=np.int64)
    held = np.full((len(queries), k), LONG.max, dtype=np.int64)
    empty = np.ones((len(queries), k), dtype=bool)
    live, scored = np.arange(len(queries)), 0
    for turn in range(len(high)):
        chosen = order[live, turn]
        # A block whose bound equals the k-th score may still hold a smaller id.
        going = empty[live, -1] | (bound[live, chosen] >= score[live, -1])
        if least is not None:
            going &= bound[live, chosen] >= least[live]
        live, chosen = live[going], chosen[going]
        if not len(live):
            break
        for b in np.unique(chosen):
            who = live[chosen == b]
            ids = doc_ids[b * block : (b + 1) * block]
            fresh = exact(queries[who], docs[b * block : (b + 1) * block])
            own = ids[None, :] == query_ids[who][:, None]
            scored += len(who)
            better = (empty[who, -1] | (np.where(own, LONG.min, fresh).max(1) >= score[who, -1]))
            who, fresh, own = who[better], fresh[better], own[better]
            all_score = np.concatenate((score[who], fresh), 1)
            all_id = np.concatenate((held[who], np.broadcast_to(ids, fresh.shape)), 1)
            all_empty = np.concatenate((empty[who], own), 1)
            # ascending by (absent, -score, id); -score - 1 can't overflow as -score can
            rank = np.lexsort((all_id, -1 - all_score, all_empty), axis=-1)[:, :k]
            score[who], held[who], empty[who] = (np.take_along_axis(x, rank, 1) for x in (all_score, all_id, all_empty))
    place = np.nonzero(~empty)
    return place[0], held[place], score[place], scored


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's k best other rows: ``query_id``, ``rank``, ``vec_id``, ``score`` (long).

    Components become floor(scale * x). ``is_query`` maps the id column to the
    condition that a row is a query. See :func:`usable` for rows that take no
    part. A row with a query's id is no candidate of it; other rows that share
    an id are all candidates. Queries with equal ids and vectors count as one,
    those with equal ids and several vectors are ranked together. Vectors of
    unequal length count as having zeros at the end. With fewer than k
    candidates all are returned; an empty table gives none.
    """
    weights = F.transform("vector", lambda x: F.floor(x * scale).cast("double"))
    rows = usable(df, id_col, vector_col).select("id", weights.alias("vector"))
    rows = stored(rows, "topk")
    slots = max(1, -(-rows.count() // (BLOCK * SHARD)))
    # Neighbouring parts are put together, so that shards and batches are full however the shuffles are dealt.
    dealt = rows.repartitionByRange(slots, "id").sortWithinPartitions("id").coalesce(slots)
    shards = stored(packed(dealt, BLOCK * SHARD), "topk-shards")
    asked = stored(rows.where(is_query(F.col("id"))).distinct(), "topk-asked")
    batches = stored(packed(asked.coalesce(max(1, -(-asked.count() // BATCH))), BATCH), "topk-queries")
    first = stored(reaching(shards, batches, None), "topk-first")
    early = stored(scored(shards, batches, first, k), "topk-early")
    held = Window.partitionBy("batch", "place").orderBy(F.desc("score"))
    least = early.withColumn("turn", F.row_number().over(held)).where(F.col("turn") == k).select("batch", "place", F.col("score").alias("least"))
    rest = stored(reaching(shards, batches, least, first), "topk-rest")
    late = scored(shards, batches, rest, k)
    return best(early.unionByName(late).select("query_id", "vec_id", "score"), k)


def reaching(shards: DataFrame, batches: DataFrame, least: DataFrame | None, seen: DataFrame | None = None) -> DataFrame:
    """(batch, place, shard, least) of the queries and shards that have to meet.

    Without ``least`` these are each query's FIRST shards by bound, then those
    whose bound reaches its ``least`` (all, if it has none), but not those in
    ``seen``. Bounds are looked at for BATCH queries and BOUNDS shards at a time.
    """

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cells = [unpack(d.ids, d.cells, d.width)[1] for d in part.itertuples()]
            yield pd.DataFrame({"shard": part["pack"], "width": part["width"], "high": [c.max(0).tobytes() for c in cells], "low": [c.min(0).tobytes() for c in cells]})

    groups = max(1, -(-shards.count() // BOUNDS))
    limits = shards.mapInPandas(edges, "shard long, width int, high binary, low binary").withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    known = batches.withColumnRenamed("pack", "batch")
    if least is not None:
        known = known.join(least.groupBy("batch").agg(F.collect_list(F.struct("place", "least")).alias("least")), "batch", "left")  # BATCH rows at most
    else:
        known = known.withColumn("least", F.lit(None).cast("array<struct<place:int,least:long>>"))
    # Few batches share a task; groups of bounds are copied for each such lot.
    lots = max(1, -(-batches.count() // TOGETHER))
    known = known.withColumn("lot", F.pmod(F.xxhash64("batch"), F.lit(lots)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    limits = limits.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

    def meet(limits: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"batch": [], "place": [], "shard": [], "least": [], "bound": []}).astype({"batch": "int64", "place": "int32", "shard": "int64", "least": "int64"})]
        if len(limits):
            width = int(limits["width"].max())
            high, low = (np.stack([np.pad(np.frombuffer(e), (0, width - w)) for e, w in zip(limits[c], limits["width"], strict=True)]) for c in ("high", "low"))
            shard = limits["shard"].to_numpy()
            for b in known.itertuples():
                _, queries = unpack(b.ids, b.cells, b.width)
                bound = bounds(queries, high, low)
                floor = np.full(len(queries), LONG.min, dtype=np.int64)
                for x in b.least if b.least is not None else ():
                    floor[x["place"]] = x["least"]
                if first:
                    near = np.argpartition(-bound, min(FIRST, len(shard)) - 1, axis=1)[:, :FIRST]
                    place, at = np.repeat(np.arange(len(queries)), near.shape[1]), near.ravel()
                else:
                    place, at = np.nonzero(bound >= floor[:, None])
                out.append(pd.DataFrame({"batch": b.batch, "place": place.astype(np.int32), "shard": shard[at], "least": floor[place], "bound": bound[place, at]}))
        return pd.concat(out)

    first = least is None
    key = ("group", "lot")
    met = limits.groupBy(*key).cogroup(known.groupBy(*key)).applyInPandas(meet, "batch long, place int, shard long, least long, bound double")
    if first:
        turn = F.row_number().over(Window.partitionBy("batch", "place").orderBy(F.desc("bound"), "shard"))
        met = met.withColumn("turn", turn).where(F.col("turn") <= FIRST)
    elif seen is not None:
        met = met.join(seen.select("batch", "place", "shard"), ["batch", "place", "shard"], "left_anti")
    return met.select("batch", "place", "shard", "least")


def scored(shards: DataFrame, batches: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(batch, place, query_id, vec_id, score): the k best of every pair's shard for its query."""
    lists = pairs.groupBy("batch", "shard").agg(F.collect_list(F.struct("place", "least")).alias("who"))  # BATCH entries at most
    lots = max(1, -(-batches.count() // TOGETHER))

    def narrow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Only the rows of a batch that the shard has to see."""
        for part in parts:
            out = []
            for r in part.itertuples():
                ids, cells = unpack(r.ids, r.cells, r.width)
                place = np.array([x["place"] for x in r.who], dtype=np.int64)
                least = np.array([x["least"] for x in r.who], dtype=np.int64)
                out.append((r.shard, r.lot, r.batch, r.width, ids[place].tobytes(), cells[place].tobytes(), place.tobytes(), least.tobytes()))
            yield pd.DataFrame(out, columns=["shard", "lot", "batch", "width", "ids", "cells", "place", "least"])

    asked = lists.join(batches.withColumnRenamed("pack", "batch"), "batch").withColumn("lot", F.pmod(F.xxhash64("batch"), F.lit(lots)).cast("int"))
    asked = asked.select("shard", "lot", "batch", "width", "ids", "cells", "who").mapInPandas(narrow, "shard long, lot int, batch long, width int, ids binary, cells binary, place binary, least binary")
    lot = F.pmod(F.xxhash64("batch"), F.lit(lots)).cast("int")
    copies = shards.withColumnRenamed("pack", "shard").join(lists.select("shard", lot.alias("lot")).distinct(), "shard")

    def run(shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"batch": [], "place": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        for d in shards.itertuples():
            ids, docs = unpack(d.ids, d.cells, d.width)
            for r in asked.itertuples():
                query_ids, queries = unpack(r.ids, r.cells, r.width)
                at, vec, score, _ = search(ids, docs, query_ids, queries, k, least=np.frombuffer(r.least, dtype=np.int64))
                out.append(pd.DataFrame({"batch": r.batch, "place": np.frombuffer(r.place, dtype=np.int64)[at], "query_id": query_ids[at], "vec_id": vec, "score": score}))
        return pd.concat(out)

    key = ("shard", "lot")
    return copies.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "batch long, place int, query_id long, vec_id long, score long")
