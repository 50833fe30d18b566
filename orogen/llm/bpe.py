"""BPE encoding and decoding with a queue of merge ranks over linked symbols.

A word's symbols form a doubly linked list. A heap holds the rank and place of
each adjacent pair that the vocabulary can merge; entries whose symbols have
changed since are stale and skipped when they surface. Decoding concatenates
vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import texts_to_python, tidy


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Codec:
    """Encodes and decodes as the given word-end BPE definition says.

    ``definition`` is the parsed JSON of a public tokenizer file: NFC, white
    space to one blank, lower case, split by the file's own pattern, then
    byte-level symbols whose last carries the end-of-word suffix.
    """

    #: Bytes of kept results, about, in two generations.
    CACHE = 96 << 20
    #: Bytes that a kept word takes besides its characters and ids: two objects and a place in a table.
    ENTRY = 190
    #: Longer words are encoded without being kept.
    KEEP = 64

    def __init__(self, definition: dict) -> None:
        model = definition["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"] or ""
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        self.added = {t["content"]: t["id"] for t in definition["added_tokens"]}
        known = {i: s for s, i in (vocab | self.added).items()}
        self.strings = [known.get(i, "") for i in range(max(known, default=-1) + 1)]
        self.decimal = [str(i) for i in range(len(self.strings))]
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pieces = regex.compile(definition["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.forget()

    def forget(self) -> None:
        """Drops the kept results."""
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def merge(self, word: str) -> list[int]:
        """The ids that a word's bytes end up in."""
        data = word.encode("utf-8")
        inner, rank = self.inner, self.rank
        symbol = [inner[b] for b in data]
        symbol[-1] = self.final[data[-1]]
        n = len(symbol)
        if n == 1:
            return symbol
        # The pair that starts at i has rank now[i] (-1: none, or i is merged away).
        now = [rank.get(a << 20 | b, -1) for a, b in zip(symbol, symbol[1:], strict=False)]
        queue = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return symbol
        now.append(-1)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        pop, push, made = heapq.heappop, heapq.heappush, self.made
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            r = entry >> 32
            if now[i] != r:
                continue  # stale: one of the two symbols has changed since
            j = right[i]
            symbol[i] = new = made[r]
            symbol[j] = now[j] = now[i] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                now[i] = r = rank.get(new << 20 | symbol[k], -1)
                if r >= 0:
                    push(queue, r << 32 | i)
            h = left[i]
            if h >= 0:
                now[h] = r = rank.get(symbol[h] << 20 | new, -1)
                if r >= 0:
                    push(queue, r << 32 | h)
        return [s for s in symbol if s >= 0]

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a run without white space."""
        out = self.old.get(text)
        if out is None:
            if text.isascii():
                low = text.lower()
                pieces = [low] if low.isalpha() else self.pieces(low)
            else:
                pieces = self.pieces("".join([c.lower() for c in text]))
            out = tuple(self.merge(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in self.piece(p)])
        if len(text) <= self.KEEP:
            if self.size >= self.CACHE // 2:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[text] = out
            self.size += self.ENTRY + len(text) + 8 * len(out)
        return out

    def piece(self, text: str) -> Sequence[int]:
        """Ids of one piece of the split pattern; words that also stand alone are found again."""
        if text.isascii() and text.isalpha():
            known = self.young.get(text) or self.old.get(text)
            if known is not None:
                return known
        return self.merge(text)

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if self.special is None or not any(s in text for s in self.added):
            return self._plain(text)
        out = []
        for part in self.special.split(text):
            known = self.added.get(part)
            out += self._plain(part) if known is None else [known]
        return out

    def encode(self, text: str) -> tuple[str, int, str]:
        """Ids joined by blanks, their number and the decoded text of a whole text."""
        ids = self.ids(text)
        return " ".join(map(self.decimal.__getitem__, ids)), len(ids), self.decode(ids)

    def _plain(self, text: str) -> list[int]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # str.split() also splits at four control characters that \s leaves alone
        words = WHITE.split(text) if CONTROL.search(text) else text.split()
        get, make = self.young.get, self.chunk
        out = []
        for w in words:
            if w:
                out += get(w) or make(w)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Vocabulary strings of the ids, joined as a tokenizer without decoder does."""
        return " ".join(map(self.strings.__getitem__, ids))


CONTROL = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"[^\S\x1c-\x1f]+")

_codecs: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    """The process's codec for a file shipped to every executor; built once."""
    if name not in _codecs:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _codecs[name] = Codec(json.load(f))
    return _codecs[name]


def ship(spark, path: str) -> str:
    """Sends the tokenizer file to the executors and gives the name to open it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


#: What :func:`encode` can add, with its type.
MADE = {"n_tokens": "long", "ids": "string", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(df: DataFrame, path: str, text_col: str = "text", add: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Adds columns of :data:`MADE`; ``ids`` are decimal, blank-separated.

    Every whole text is encoded; null counts as the empty text, which has no
    ids and decodes to the empty text. Input columns with one of the added
    names are replaced. Repeated rows stay repeated; an empty table gives none.
    Only what is asked for leaves Python, so digests keep rows small.
    """
    texts_to_python(df.sparkSession)
    name = ship(df.sparkSession, path)
    # The decoded text comes from the ids' vocabulary strings.
    parts = {"n_tokens": lambda ids, n, text: n, "ids": lambda ids, n, text: ids, "decoded": lambda ids, n, text: text,
             "ids_sha256": lambda ids, n, text: sha256(ids), "decoded_sha256": lambda ids, n, text: sha256(text)}

    @F.pandas_udf(", ".join(f"{c} {MADE[c]}" for c in add))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(name)
        wanted = [parts[c] for c in add]
        try:
            for texts in tidy(batches):
                rows = []
                for t in texts:
                    out = codec.encode(t or "")
                    rows.append(tuple([f(*out) for f in wanted]))
                yield pd.DataFrame(rows, columns=list(add))
        finally:
            codec.forget()

    kept = [F.col(f"`{c}`") for c in df.columns if c not in add]
    out = df.select(*kept, run(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__bpe"))
    return out.select(*kept, *(F.col(f"__bpe.{c}").alias(c) for c in add))


def encode_digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of ids and decoded text."""
    return encode(df, path, text_col, ("n_tokens", "ids_sha256", "decoded_sha256"))
