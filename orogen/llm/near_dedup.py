"""Near-duplicate classes from bottom-k sketches of one hash function.

A text's set holds the hashes of its five-word shingles; its sketch holds the k
smallest. Texts with equal sets are one class from the start. Inverted lists of
retained values bring classes together: a pair over the threshold must share a
known number of retained values, hence one among the rarest few of each, so
only those are listed and widely shared passages make no lists of strangers.

A list never gives all its pairs. The class that shares most with others leads,
at first for all lists that its members reach, so that a large family has one
leader; members meet the leader, and the union of two sketches estimates their
similarity; pairs that may reach the threshold are verified on full sets. As
similarity is a metric, members linked with the leader can only link with
members that are near it: if some of those are outside its component, the
leader's surroundings are compared in blocks, once. Members that are settled
leave the list; a list goes when the rest share a component or a leader's
surroundings. What a few leaders leave is compared in blocks too. Blocks are
cut by the size of their sets; sketches and then full sets meet as products of
matrices, and only the links that join components come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import BLANK, LOWER, discard, mix64, stored, texts_to_python, tidy, word_hashes
from orogen.llm.components import components

WORDS, KEEP = 5, 64
#: Links need 100 * intersection >= percent * union; this is what callers that name none get.
PERCENT = 85
#: Chance that a pair at the threshold shares fewer retained values than assumed.
RISK = 1e-9
LEADERS = 2
#: Shingles of a block in comparisons, about; a set counts for LIGHT at least, so blocks also have few rows.
BLOCK, LIGHT = 1 << 19, 128
#: Rows and columns of the matrices that a comparison multiplies.
ROWS, COLUMNS = 512, 4096

_STEP = [pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) | 1 for i in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's five-word shingles, as signed 64-bit integers.

    Words are split at space and 0x09-0x0D after A-Z became a-z. Fewer than
    five words make one shingle; none make no shingle.
    """
    if not text:
        return np.empty(0, dtype=np.int64)
    words = word_hashes(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), BLANK, fold=LOWER)
    size = min(WORDS, len(words))
    if not size:
        return np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            total += mix64(words[i : len(words) - size + 1 + i] * np.uint64(_STEP[i]))
        return np.unique(mix64(total).view(np.int64))


def set_key(values: np.ndarray) -> bytes:
    """Sixteen bytes that tell one set from any other."""
    with np.errstate(over="ignore"):
        u = values.view(np.uint64)
        parts = mix64(u * np.uint64(_STEP[0])).sum(dtype=np.uint64), mix64(u ^ np.uint64(_STEP[1])).sum(dtype=np.uint64) + np.uint64(len(u))
    return b"".join(int(p).to_bytes(8, "big") for p in parts)


def quantile(share: float, k: int = KEEP, risk: float = RISK) -> int:
    """Most successes of k that a binomial of this share exceeds or meets but for the risk."""
    below = 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * share**m * (1 - share) ** (k - m)
        if below > risk:
            return m
    return k


def needed(n: int, percent: int) -> int:
    """Values that a set of n shares with any partner of this similarity, among the k smallest of their union.

    At most (100 - percent) % of the union is not shared; this bounds small
    sets for certain, the quantile bounds large ones.
    """
    union = n * 100 // percent  # the most that the union can hold
    certain = min(-(-n * percent // 100), KEEP - union * (100 - percent) // 100 if union >= KEEP else KEEP)
    return max(1, certain, quantile(percent / 100) if n >= KEEP else 0)


def needs(percent: int) -> list[int]:
    """:func:`needed` by the set's size; larger sets need what the last one does."""
    return [needed(n, percent) for n in range(8 * KEEP)]


_NEED = needs(PERCENT)


def sketches(docs: DataFrame, text_col: str, percent: int = PERCENT) -> DataFrame:
    """Adds ``n_shingles``, ``cls`` (null for empty sets), ``sketch``, ``need`` to every row; the text goes."""
    kept = [c for c in docs.columns if c != text_col]
    need = needs(percent)

    @F.pandas_udf("n_shingles long, cls binary, sketch array<long>, need int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in tidy(batches):
            out = []
            for t in texts:
                s = shingles(t)
                out.append((len(s), set_key(s) if len(s) else None, s[:KEEP], need[min(len(s), len(need) - 1)]))
            yield pd.DataFrame(out, columns=["n_shingles", "cls", "sketch", "need"])

    return docs.select(*kept, run(F.col(text_col)).alias("s")).select(*kept, "s.*")


def shared_values(classes: DataFrame) -> DataFrame:
    """Lists: (value, cls, score) for the rarest retained values of each class that other classes list too.

    The score tells how much of a class others share.
    """
    every = classes.select("cls", "need", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    counts = every.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = every.join(counts, "value").groupBy("cls", "need", "k").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("held"))
    # Values that no other class has come first in the order of rarity.
    room = F.col("k") - F.col("need") + 1 - (F.col("k") - F.size("held"))
    score = F.aggregate("held", F.lit(0).cast("long"), lambda s, h: s + h["n"])
    listed = held.where(room > 0).select("cls", score.alias("score"), F.explode(F.slice("held", 1, room)).alias("v"))
    return listed.select(F.col("v.value").alias("value"), "cls", "score")


def overlap(a: Column, b: Column) -> Column:
    """How many of the k smallest values of two sketches' union are in both."""
    smallest = F.slice(F.array_sort(F.array_union(a, b)), 1, KEEP)
    return F.size(F.array_intersect(smallest, F.array_intersect(a, b)))


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b): ``may`` reach the threshold, or be ``near`` enough that others may link across."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"), F.col("need").alias(f"need_{c}"))
    near = 2 * percent - 100
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = both.where(small * 100 >= near * large).withColumn("met", overlap(F.col("s_a"), F.col("s_b")))
    least = F.least(F.lit(quantile(near / 100)), F.ceil(small * near / 100))
    return both.where(F.col("met") >= least).select("a", "b", ((F.col("met") >= F.greatest("need_a", "need_b")) & (small * 100 >= percent * large)).alias("may"))


def full_sets(docs: DataFrame, wanted: DataFrame, first_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, values) of the wanted classes, from one text of each."""
    ids = wanted.join(first_ids, "cls").select(F.col("first_id").alias("__id")).distinct()
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(ids, F.col("__doc").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in tidy(batches):
            sets = [shingles(t) for t in part["text"]]
            yield pd.DataFrame({"cls": [set_key(s) if len(s) else None for s in sets], "values": sets})

    # Whole-partition Python: the optimizer must not move it before the first join.
    made = texts.select("text").mapInPandas(run, "cls binary, values array<long>").join(wanted, "cls", "left_semi")
    return made.groupBy("cls").agg(F.first("values").alias("values"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("values").alias(f"v_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("v_a", "v_b"))
    return both.where(common * 100 >= percent * (F.size("v_a") + F.size("v_b") - common)).select("a", "b")


def dense(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """0/1 matrix of rows of sorted values over some sorted values."""
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    values = np.concatenate(rows)
    at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
    held = columns[at] == values
    out[row[held], at[held]] = 1
    return out


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Of every pair from two lists of sorted sets, how many values both have; a bounded number of columns at a time."""
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    met = np.zeros((len(a), len(b)))
    for at in range(0, len(common), COLUMNS):
        columns = common[at : at + COLUMNS]
        met += dense(a, columns) @ dense(b, columns).T
    return met


def joining(full: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of linked pairs that join different labels, enough to join all that belongs together.

    With ``side`` only pairs from different sides are looked at. Joined labels
    become one, so there are fewer pairs than rows; ``label`` is changed.
    """
    n = np.array([len(f) for f in full])
    need = np.array([needed(min(m, 8 * KEEP - 1), percent) for m in n])
    order, out = np.lexsort((n, label)), []
    strips = [order[at : at + ROWS] for at in range(0, len(order), ROWS)]
    for p, one in enumerate(strips):
        for two in strips[p:]:
            open_ = label[one][:, None] != label[two][None, :]
            if side is not None:
                open_ &= side[one][:, None] != side[two][None, :]
            if one is two:
                open_ &= np.triu(np.ones(open_.shape, dtype=bool), 1)
            open_ &= np.minimum(n[one][:, None], n[two][None, :]) * 100 >= percent * np.maximum(n[one][:, None], n[two][None, :])
            if not open_.any():
                continue
            met = shared_counts([full[i][:KEEP] for i in one], [full[i][:KEEP] for i in two])  # at least the count within the k smallest of the union
            open_ &= met >= np.maximum(need[one][:, None], need[two][None, :])
            a, b = np.nonzero(open_)
            if not len(a):
                continue
            if len(a) > len(one) + len(two):
                exact = shared_counts([full[i] for i in one], [full[i] for i in two])[a, b]
            else:
                exact = np.array([len(np.intersect1d(full[one[i]], full[two[j]], assume_unique=True)) for i, j in zip(a, b, strict=True)])
            linked = exact * 100 >= percent * (n[one[a]] + n[two[b]] - exact)
            for i, j in zip(one[a[linked]], two[b[linked]], strict=True):
                if label[i] != label[j]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def across(groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different labels within groups (key, cls, label), enough to join what belongs together.

    A group whose sets are together larger than BLOCK is cut into blocks by a
    hash of the class; each pair of blocks is one Python call.
    """
    weighed = groups.join(classes.select("cls", F.greatest("n_shingles", F.lit(LIGHT)).alias("weight")), "cls")
    sizes = weighed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks")).where("n > 1").drop("n")
    dealt = weighed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "label")

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(part["label"])[0]
        side = None if key[1] == key[2] else part["block"].to_numpy()
        cls = part["cls"].to_list()
        return pd.DataFrame([(cls[i], cls[j]) for i, j in joining(part["values"].to_list(), label, side, percent)], columns=["a", "b"], dtype=object)

    return dealt.join(sets, "cls").groupBy("key", "i", "j").applyInPandas(meet, "a binary, b binary").distinct()


def leaders(lists: DataFrame, hops: int) -> DataFrame:
    """(value, lead): of each list's members the class of the highest score; with hops, of lists that members are in too."""
    held = lists.select("value", "cls")
    heads = lists.groupBy("value").agg(F.max(F.struct("score", "cls")).alias("top"))
    for _ in range(hops):
        reach = held.join(heads, "value").groupBy("cls").agg(F.max("top").alias("top"))
        heads = held.join(reach, "cls").groupBy("value").agg(F.max("top").alias("top"))
    return heads.select("value", F.col("top.cls").alias("lead"))


def linked(docs: DataFrame, classes: DataFrame, first_ids: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(node, label): the component of every class that links with another."""
    lists = stored(shared_values(classes), "lists")
    links = None
    joined = lambda a, b: b if a is None else a.unionByName(b)

    def named(df: DataFrame, c: str, name: str, labels: DataFrame) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(c), F.col("label").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))

    def sets_of(df: DataFrame) -> DataFrame:
        return stored(full_sets(docs, stored(df.distinct(), "wanted"), first_ids, id_col, text_col), "sets")

    for turn in range(LEADERS):
        led = stored(lists.join(leaders(lists, 1 if turn == 0 else 0), "value"), "led")
        pairs = led.where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct()
        pairs = stored(estimated(pairs, classes, percent), "pairs")
        sets = sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")))
        found = stored(verified(pairs.where("may"), sets, percent), "links")
        links = joined(links, found)
        labels = components(links)
        # Leaders with a near class outside their component: their surroundings are compared.
        around = stored(named(named(pairs.select("a", "b"), "a", "label_a", labels), "b", "label_b", labels), "around")
        open_ = stored(around.where("label_a <> label_b").select("b").distinct(), "open")
        if open_.limit(1).count():
            around = around.join(open_, "b", "left_semi")
            groups = around.select(F.col("b").alias("key"), F.col("a").alias("cls"), F.col("label_a").alias("label")).unionByName(around.select(F.col("b").alias("key"), F.col("b").alias("cls"), F.col("label_b").alias("label")).distinct())
            links = joined(links, stored(across(groups, classes, sets, percent), "links"))
            labels = components(links)
        discard(sets)
        # Leaders and members linked with them are done. The others go on, unless the rest of the list is one
        # component, or near its leader and so compared with one another already.
        near = pairs.select(F.col("a").alias("cls"), F.col("b").alias("lead"), F.lit(True).alias("near"))
        direct = found.select(F.col("a").alias("cls"), F.col("b").alias("lead"))
        rest = led.where("cls <> lead").join(direct, ["cls", "lead"], "left_anti").join(near, ["cls", "lead"], "left")
        rest = stored(named(rest, "cls", "label", labels), "rest")
        going = rest.groupBy("value").agg((F.min("label") < F.max("label")).alias("apart"), F.max(F.col("near").isNull()).alias("far")).where("apart and far").select("value")
        discard(lists)
        discard(led)
        lists = stored(rest.join(going, "value", "left_semi").select("value", "cls", "score"), "lists")
        if not lists.limit(1).count():
            return labels
    left = stored(named(lists.select(F.col("value").alias("key"), "cls"), "cls", "label", labels), "left")
    return components(links.unionByName(across(left, classes, sets_of(left.select("cls")), percent)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), percent: int = PERCENT, key: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row, and its columns ``carry``.

    Texts link whose sets' Jaccard similarity is ``percent`` hundredths or more.
    ``component_id`` is the smallest id reachable over links, ``kept`` whether
    it is the row's own. Null and blank texts have an empty set, no link and
    their own id. Rows with equal ids and texts stay as many as they are; a
    null id is never the smallest unless its component has no other, and then
    ``component_id`` is null and ``kept`` true. An empty table gives none. Column
    ``key``, if named, tells components apart that have the same smallest id or
    none; it is null for empty sets.
    """
    texts_to_python(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.col(text_col), *carry)
    rows = stored(sketches(docs, text_col, percent), "sketches")
    some = rows.where("n_shingles > 0")
    classes = stored(some.groupBy("cls", "n_shingles").agg(F.min(id_col).alias("first_id"), F.first("sketch").alias("sketch"), F.first("need").alias("need")), "classes")
    first_ids = classes.select("cls", "first_id")
    labels = linked(docs, classes, first_ids, id_col, text_col, percent)
    named = first_ids.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(lowest, "label").select("cls", "component_id", *([F.col("label").alias(key)] if key else []))
    out = rows.select(id_col, "n_shingles", "cls", *carry).join(by_class, "cls", "left")
    component = F.when(F.col("n_shingles") == 0, F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, "n_shingles", *carry, *([key] if key else []), component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))
