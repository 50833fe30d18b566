"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over
hashed byte n-grams tells languages whose bit is 1 from those whose bit is 0;
its margin is the mean log-odds of the text's n-grams. Decoding weights each
bit by how well its classifier does in training, sums the logistic losses
against every codeword and takes the nearest. A text whose two nearest
codewords are almost as near as one another is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import LOWER, discard, stored, texts_to_python, tidy

#: Slots of the table of hashed n-grams.
SLOTS = 1 << 17
#: Bytes handled at a time; longer texts are summed over several such stretches.
STRETCH = 1 << 18
#: Labelled rows that the classifiers are fitted on at most, about.
SAMPLE_ROWS = 6_000
#: Rows of each label at least, if it has them, however many labels share the sample.
LEAST_ROWS = 20
#: Tasks that count the sample's n-grams.
SAMPLE_PARTS = 8

_FOLD = LOWER.copy()
_FOLD[[*range(0x00, 0x21), *range(0x30, 0x3A)]] = 0x20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(data: np.ndarray) -> np.ndarray:
    """Slots of the bigrams and trigrams of folded bytes."""
    x = data.astype(np.uint32)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    shift = np.uint32(32 - 16)
    low = (two * np.uint32(0x9E3779B1)) >> shift
    high = (three * np.uint32(0x85EBCA77)) >> shift
    return np.concatenate((low, high + np.uint32(SLOTS // 2)))


def stretches(text: str) -> Iterator[np.ndarray]:
    """The whole text's n-gram slots, a bounded stretch at a time."""
    data = np.frombuffer(f" {text} ".encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, len(data), STRETCH):
        piece = _FOLD[data[at : at + STRETCH + 2]]
        if len(piece) > 2:
            yield grams(piece)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and +1, far from one another.

    Up to five languages get the exhaustive code (every split of them into two
    parts); more get the best of many random codes.
    """
    if k == 0:
        return np.ones((0, 0), dtype=int)
    if k <= 5:
        splits = [[1 if c == 0 or s >> (c - 1) & 1 else -1 for c in range(k)] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits or [[1]]).T
    bits, rng, best, far = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(k, bits))
        apart = (bits - code @ code.T)[~np.eye(k, dtype=bool)].min() // 2
        varied = (np.abs(code.sum(0)) < k).all()
        if varied and apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    """languages, codewords, log-odds per slot and bit, scale and shift per bit, weight per bit."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    ambiguity: float = 0.05

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for slots in stretches(text):
            total += self.odds[slots].sum(0, dtype=np.float64)
            n += len(slots)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Nearest language, its share of the softmax, whether it is ambiguous."""
        z = margins * self.scale + self.shift
        loss = np.logaddexp(0, -z[None, :] * self.code) @ self.weight
        likely = np.exp(loss.min() - loss)
        likely /= likely.sum()
        first = int(np.argmin(loss))
        second = np.partition(loss, 1)[1] if len(loss) > 1 else np.inf
        return self.languages[first], float(likely[first]), bool(second - loss[first] < self.ambiguity)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not has_letter(text) or not self.languages:
            return "und", 0.0, True
        return self.decode(self.margins(text))


def counted(texts: Iterable[str]) -> np.ndarray:
    """How often each slot is met in texts."""
    out = np.zeros(SLOTS, dtype=np.int64)
    for text in texts:
        for slots in stretches(text):
            out += np.bincount(slots, minlength=SLOTS)
    return out


def uncalibrated(counts: dict[str, np.ndarray], smooth: float = 0.5) -> Model:
    """The classifiers of every bit from each label's counts; no labels give a model that answers ``und``."""
    languages = sorted(counts)
    code = codewords(len(languages))
    bits = code.shape[1] if languages else 0
    odds = np.zeros((SLOTS, bits), dtype=np.float32)
    for b in range(bits):
        # Languages count alike, however much text each has.
        side = {s: sum((counts[c] + smooth) / (counts[c].sum() + smooth * SLOTS) for c, of in zip(languages, code[:, b], strict=True) if of == s) for s in (-1, 1)}
        ones, zeros = (int((code[:, b] == s).sum()) for s in (1, -1))
        if zeros:
            odds[:, b] = np.log(side[1] / ones) - np.log(side[-1] / zeros)
    return Model(languages, code, odds, np.ones(bits), np.zeros(bits), np.ones(bits))


def calibrated(model: Model, margins: np.ndarray, labels: list[str]) -> Model:
    """The model with each bit's scale, shift and weight from the margins of labelled texts."""
    if len(model.languages) > 1 and len(labels):
        place = {c: i for i, c in enumerate(model.languages)}
        model.scale, model.shift, right = _calibrate(margins, model.code[[place[c] for c in labels]])
        model.weight = np.maximum(right - 0.5, 1e-3)
        model.weight /= model.weight.mean()
    return model


def train(texts: list[str], labels: list[str]) -> Model:
    """Fits the bit classifiers to a few texts; :func:`fit` does it for a table."""
    counts = {c: counted(t for t, own in zip(texts, labels, strict=True) if own == c) for c in set(labels)}
    model = uncalibrated(counts)
    return calibrated(model, np.array([model.margins(t) for t in texts]), labels)


def _calibrate(margins: np.ndarray, truth: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic scale and shift per bit by gradient descent, and each bit's training accuracy."""
    spread = margins.std(0) + 1e-6
    x = margins / spread
    scale, shift = np.ones(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        pull = truth / (1 + np.exp(np.clip(truth * (x * scale + shift), -30, 30)))
        scale += 0.5 * ((pull * x).mean(0) - 1e-3 * scale)
        shift += 0.5 * pull.mean(0)
    right = ((x * scale + shift) * truth > 0).mean(0)
    return scale / spread, shift, right


def fit(df: DataFrame, usable: Column, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on about ``sample_rows`` labelled rows, chosen by a hash of the key and text.

    Every label gets an equal share, so rare languages are learned too. The
    bound is the parameter, but for LEAST_ROWS rows of each label; rows with
    null text or label are not used, equal rows count once. Texts stay on the
    executors: counts by label, and every text's margins, come to the driver.
    """
    texts_to_python(df.sparkSession)
    label = F.col(label_col).cast("string")
    rows = df.where(usable & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return uncalibrated({})
    share = max(sample_rows / len(sizes), LEAST_ROWS)
    draw = F.pmod(F.xxhash64(F.col(key_col).cast("string"), F.col(text_col)), F.lit(1_000_000)) / 1e6
    chance = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, share / n))])
    chosen = rows.where(draw < chance[label]).select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"), label.alias("label"))
    sample = stored(chosen.distinct().repartition(SAMPLE_PARTS, "key", "text"), "languages")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for b in tidy(batches):
            for c, part in b.groupby("label"):
                seen[c] = seen.get(c, 0) + counted(part["text"])
        for c, n in seen.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"label": [c], "at": [at.astype(np.int32).tobytes()], "n": [n[at].tobytes()]})

    counts: dict[str, np.ndarray] = {}
    for r in sample.mapInPandas(count, "label string, at binary, n binary").toLocalIterator():  # SAMPLE_PARTS short rows a label
        own = counts.setdefault(r[0], np.zeros(SLOTS, dtype=np.int64))
        own[np.frombuffer(r[1], dtype=np.int32)] += np.frombuffer(r[2], dtype=np.int64)
    model = uncalibrated(counts)
    shared = df.sparkSession.sparkContext.broadcast(model)  # SLOTS x bits floats, whatever the input

    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in tidy(batches):
            yield pd.Series([shared.value.margins(t) for t in texts])

    seen = sorted((r[1], r[0]) for r in sample.select("label", margins("text")).collect())  # a few floats for each of the bounded sample
    discard(sample)
    return calibrated(model, np.array([m for m, _ in seen]), [c for _, c in seen])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` to every row.

    Null texts and texts without a letter get ``und``, score 0 and are
    ambiguous. Whole texts are read whatever their length; equal texts get
    equal answers; input columns with one of these names are replaced.
    """
    texts_to_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # SLOTS x bits floats, whatever the input

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in tidy(batches):
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    made = ("lang_pred", "score", "ambiguous")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    out = df.select(*kept, run(F.col(text_col)).alias("__lid"))
    return out.select(*kept, *(F.col(f"__lid.{c}").alias(c) for c in made))
