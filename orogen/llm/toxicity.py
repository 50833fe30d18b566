"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed lower-case words and of their beginnings, so
that inflected forms count too. Besides a weight each term
has a short vector; the inner product of two terms' vectors is the weight of
their meeting in one text, so that an insult beside a mention of a group can
count for more than the two apart. Terms that training shows to be unrelated to
the label, alone and in their meetings with others, are left out, so long clean
texts don't add up noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orogen.llm.common import LOWER, parts, texts_to_python, tidy, word_hashes

#: Slots that terms are hashed to.
SLOTS = 1 << 20
FACTORS = 8
#: Labelled rows that the machine is fitted on at most, about.
SAMPLE_ROWS = 8_000
#: Part of the rows that a term must be in for its meetings to be tested, if it isn't related to the label alone.
PAIR_SHARE = 0.05
#: Deviations from what chance gives: of a term's rows with label 1, of a pair's.
Z_TERM, Z_PAIR = 6.0, 8.0
#: Columns of the matrices in which pairs are counted.
COLUMNS = 1_024

# Terms are runs of letters, digits and bytes above ASCII.
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


#: Bytes of a word's beginnings that are terms as well.
BEGINNINGS = (4, 5, 6, 7, 8, 9)


def hashed(text: str | None) -> Iterator[np.ndarray]:
    """Term slots of a whole text, with repeats, a bounded stretch at a time."""
    for part in parts(np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8), _GAP):
        yield (word_hashes(part, _GAP, BEGINNINGS, fold=LOWER) & np.uint64(SLOTS - 1)).astype(np.int64)


def terms(text: str | None) -> np.ndarray:
    """Distinct term slots of a whole text."""
    found = [np.unique(h) for h in hashed(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


@dataclass
class Machine:
    """slot: each hashed term's row in ``linear`` and ``factor``, or -1 if it is left out."""

    slot: np.ndarray
    bias: float
    linear: np.ndarray
    factor: np.ndarray

    def score(self, text: str | None) -> float:
        known = [r[r >= 0] for r in (self.slot[h] for h in hashed(text))]
        rows = np.unique(np.concatenate(known)) if known else np.empty(0, dtype=np.int64)
        return float(1 / (1 + np.exp(-np.clip(self.logit(rows), -30, 30))))

    def logit(self, rows: np.ndarray) -> float:
        v = self.factor[rows]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return self.bias + float(self.linear[rows].sum()) + pairs


def meetings(sets: list[np.ndarray], y: np.ndarray, among: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Of the terms ``among``, whether some meeting with another one tells more of the label than either alone.

    A meeting is held against the larger share of label 1 that its two terms
    have. Pairs of terms that are both kept ``alone`` needn't be tested.
    """
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[among] = np.arange(len(among))
    held = [r[r >= 0] for r in (place[s] for s in sets)]
    column, row = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    starts = range(0, len(among), COLUMNS)

    def block(at: int) -> np.ndarray:
        part = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        out = np.zeros((len(sets), min(COLUMNS, len(among) - at)), dtype=np.float32)
        out[row[part], column[part] - at] = 1
        return out

    one = y > 0
    share = np.bincount(column, y[row], len(among)) / np.maximum(np.bincount(column, minlength=len(among)), 1)
    found = np.zeros(len(among), dtype=bool)
    for i in starts:
        a = block(i)
        for j in starts[starts.index(i) :]:
            b = a if i == j else block(j)
            both, hit = (a.T @ b).astype(np.float64), (a[one].T @ b[one]).astype(np.float64)
            rate = np.clip(np.maximum(share[i : i + COLUMNS, None], share[None, j : j + COLUMNS]), 1e-3, 1 - 1e-3)
            z = (hit - both * rate - 0.5) / np.sqrt(np.maximum(both * rate * (1 - rate), 1e-9))
            telling = (z >= Z_PAIR) & (both >= 8) & ~(alone[i : i + COLUMNS, None] & alone[None, j : j + COLUMNS])
            if i == j:
                np.fill_diagonal(telling, False)
            found[i : i + COLUMNS] |= telling.any(1)
            found[j : j + COLUMNS] |= telling.any(0)
    return found


def train(texts: list[str | None], labels: list[int]) -> Machine:
    """Fits a machine to texts."""
    return train_sets([terms(t) for t in texts], labels)


def train_sets(sets: list[np.ndarray], labels: list[int], *, epochs: int = 60, rate: float = 0.3, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Fits a machine to sets of term slots; without both labels every score is the prior."""
    y = np.array(labels, dtype=np.float64)
    slot = np.full(SLOTS, -1, dtype=np.int32)
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -6.0
    if len(y) == 0 or y.min() == y.max():
        return Machine(slot, bias, np.zeros(0), np.zeros((0, FACTORS)))
    n, positive = len(y), y.sum()
    seen, hit = np.zeros(SLOTS), np.zeros(SLOTS)
    for s, label in zip(sets, y, strict=True):
        seen[s] += 1
        hit[s] += label
    share = positive / n
    away = np.abs(hit - seen * share) - 0.5  # with a correction for continuity, so that few sightings prove nothing
    z = away / np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9))
    telling = (seen >= 4) & (seen < n) & (z >= Z_TERM)
    among = np.flatnonzero(telling | ((seen >= max(8, PAIR_SHARE * n)) & (seen < n)))
    chosen = among[telling[among] | meetings(sets, y, among, telling[among])]
    slot[chosen] = np.arange(len(chosen), dtype=np.int32)
    rows = [r[r >= 0] for r in (slot[s] for s in sets)]

    # The rarer label weighs more, but less than its rarity, to keep clean texts clean.
    weight = np.where(y > 0, np.sqrt((n - positive) / positive), 1.0)
    rng = np.random.default_rng(seed)
    linear, factor = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS))
    linear_sq, factor_sq, bias_sq = np.full(len(chosen), 1e-6), np.full((len(chosen), FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 64)):
            flat = np.concatenate([rows[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            v = factor[flat]
            total = np.zeros((len(part), FACTORS))
            np.add.at(total, doc, v)
            squares = np.bincount(doc, (v**2).sum(1), len(part))
            logit = bias + np.bincount(doc, linear[flat], len(part)) + 0.5 * ((total**2).sum(1) - squares)
            pull = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]
            pull *= weight[part]
            down, up = np.zeros_like(linear), np.zeros_like(factor)
            np.add.at(down, flat, pull[doc])
            np.add.at(up, flat, pull[doc, None] * (total[doc] - v))
            touched = np.unique(flat)
            g, h = down[touched] / len(part) + decay * linear[touched], up[touched] / len(part) + decay * factor[touched]
            linear_sq[touched] += g**2
            factor_sq[touched] += h**2
            bias_sq += pull.mean() ** 2
            linear[touched] -= rate * g / np.sqrt(linear_sq[touched])
            factor[touched] -= rate * h / np.sqrt(factor_sq[touched])
            bias -= rate * pull.mean() / np.sqrt(bias_sq)
    return Machine(slot, float(bias), linear, factor)


@F.pandas_udf(T.BinaryType())
def term_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in tidy(batches):
        yield pd.Series([terms(t).astype(np.int32).tobytes() for t in texts])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text_col: str = "text", key_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on about ``sample_rows`` labelled documents, chosen by a hash of the key.

    ``usable`` is a condition on the key; rows with a null key or label are not
    used. Several labels of one key count as its largest. Only term sets travel
    to the driver, no texts.
    """
    texts_to_python(docs.sparkSession)
    known = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(key_col).agg(F.max(label_col).cast("int").alias("__label"))
    n = known.count()
    if not n:
        return train([], [])
    draw = F.pmod(F.xxhash64(F.col(key_col).cast("string")), F.lit(1_000_000)) / 1e6
    chosen = known.where(draw < min(1.0, sample_rows / n))
    rows = docs.select(key_col, text_col).join(chosen, key_col).select(text_col, "__label")
    # A key has one text as a rule. Where keys repeat, the bound holds by a further draw, not by the order of files.
    drawn = rows.orderBy(F.xxhash64(F.lit(1), text_col), text_col).limit(2 * sample_rows) if rows.count() > 2 * sample_rows else rows
    sets = drawn.select(term_sets(F.col(text_col)).alias("terms"), "__label").collect()
    sets.sort(key=lambda r: (bytes(r[0]), r[1]))  # the fit shuffles them itself and must not depend on the order of tasks
    return train_sets([np.frombuffer(r[0], dtype=np.int32) for r in sets], [r[1] for r in sets])


def score(df: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 where the score reaches the threshold).

    Null and empty texts have no term and get the machine's bias as score.
    Whole texts are read; equal texts get equal scores, rows stay as many as
    they are; an empty table gives none. Input columns with one of these names are replaced.
    """
    texts_to_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(machine)  # SLOTS integers and a row for each chosen term

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in tidy(batches):
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("score", "predicted")]
    out = df.select(*kept, run(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
