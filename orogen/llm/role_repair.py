"""Minimum-cost repair of chat roles, and rendering of the repaired sequence.

A legal conversation may start with one system message and then alternates user
and assistant, ending with an assistant message. Each given turn keeps its role
or is relabelled, and opens a message or is merged into the one before; empty
messages may be inserted. A dynamic program over the automaton of legal turns
finds the cheapest way. Its steps are (min, +) products of small matrices, so a
conversation of any length is cut into stretches whose matrices are combined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import stored

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs in units: merging into the message before, relabelling, an empty message.
MERGE, RELABEL, INSERT = 2, 3, 4
#: Turns of a stretch; larger than any other cost stands for "not legal".
STRETCH, NEVER = 4096, 1 << 40
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def escaped(text: str | None) -> str:
    """A text that can't hold a mark: every ``<|`` in it becomes ``<||``, and no mark has a bar there."""
    return (text or "").replace("<|", "<||")


def unescaped(rendered: str) -> str:
    """The text that :func:`escaped` made this of."""
    return rendered.replace("<||", "<|")


def legal(state: int, role: int) -> list[tuple[int, tuple[int, ...]]]:
    """Ways to open a message of ``role`` after ``state``: cost and the roles of empty messages put between."""
    if role == SYSTEM:
        return [(0, ())] if state == START else []
    if role == USER:
        return [(0, ())] if state in (START, SYSTEM, ASSISTANT) else [(INSERT, (ASSISTANT,))]
    return [(0, ())] if state == USER else [(INSERT, (USER,))]


def moves(given: int | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """For a turn of this role (None: unknown): (state before, state after, cost, kind, inserted roles).

    The order decides ties: keeping and opening first, then merging, then
    relabelling in the order of the roles.
    """
    out = []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if after == given else RELABEL
            for cost, between in legal(before, after):
                out.append((before, after, cost + relabel, "relabel" if relabel else "keep", between))
            if before == after:
                out.append((before, after, MERGE + relabel, "merge", ()))
    return sorted(out, key=lambda m: (m[0], m[1], m[2]))


_MOVES = {g: moves(g) for g in (None, SYSTEM, USER, ASSISTANT)}


def _matrix(given: int | None) -> np.ndarray:
    m = np.full((4, 4), NEVER, dtype=np.int64)
    for before, after, cost, *_ in _MOVES[given]:
        m[before, after] = min(m[before, after], cost)
    return m


_MATRIX = {g: _matrix(g) for g in _MOVES}
#: Cost of ending after each state: an answer is put after a question left open.
FINAL = np.array([0, INSERT * 2, INSERT, 0], dtype=np.int64)
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_code(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else None


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


def stretch_matrix(codes: list[int | None]) -> np.ndarray:
    """Cheapest cost from each state before a stretch to each state after it."""
    return _short_matrix(tuple(codes)) if len(codes) <= SHORT else _matrix_of(codes)


def _matrix_of(codes: Sequence[int | None]) -> np.ndarray:
    out = np.full((4, 4), NEVER, dtype=np.int64)
    np.fill_diagonal(out, 0)
    for c in codes:
        out = product(out, _MATRIX[c])
    return out


def cheapest(codes: list[int | None], enter: int, leave: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """The moves of a cheapest path through a stretch between two states; ties by the order of states."""
    return _short_path(tuple(codes), enter, leave) if len(codes) <= SHORT else _path_of(codes, enter, leave)


def _path_of(codes: Sequence[int | None], enter: int, leave: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    cost = np.full(4, NEVER, dtype=np.int64)
    cost[enter] = 0
    seen = [cost]
    for c in codes:
        cost = np.minimum((cost[:, None] + _MATRIX[c]).min(0), NEVER)
        seen.append(cost)
    path, state = [], leave
    for i in range(len(codes) - 1, -1, -1):
        options = [(seen[i][m[0]] + m[2], m[0], m) for m in _MOVES[codes[i]] if m[1] == state]
        _, state, move = min(options, key=lambda o: (o[0], o[1]))
        path.append(move)
    return path[::-1]


#: Sequences of so few roles repeat; their results are kept, a bounded number of them.
SHORT = 64
_short_matrix = lru_cache(20_000)(_matrix_of)
_short_path = lru_cache(20_000)(_path_of)


def junctions(matrices: list[np.ndarray]) -> list[int]:
    """States at the borders of stretches on a cheapest path: one more than there are stretches."""
    cost = np.full(4, NEVER, dtype=np.int64)
    cost[START] = 0
    seen = [cost]
    for m in matrices:
        cost = np.minimum((cost[:, None] + m).min(0), NEVER)
        seen.append(cost)
    state = int((cost + FINAL).argmin())
    out = [state]
    for i in range(len(matrices) - 1, -1, -1):
        state = int((seen[i] + matrices[i][:, state]).argmin())
        out.append(state)
    return out[::-1]


def render_moves(texts: list[str | None], path: list, first: bool, last: bool) -> list[tuple[str, str, int, int, str]]:
    """Per turn: repaired role, kind of move, cost, messages inserted, rendered piece.

    Pieces joined in order are the whole rendering; texts are escaped, so the
    marks in it are those of messages and no text can pose as another turn. A piece closes the message
    before it; the last piece also closes its own and puts what must follow.
    """
    empty = lambda r: OPEN.format(role=ROLES[r - 1]) + CLOSE
    out = []
    for i, (text, (_, after, cost, kind, between)) in enumerate(zip(texts, path, strict=True)):
        text = escaped(text)
        if kind == "merge":
            piece = "\n" + text
        else:
            piece = ("" if first and i == 0 else "\n" + CLOSE) + "".join(map(empty, between)) + OPEN.format(role=ROLES[after - 1]) + text
        added = len(between)
        if last and i == len(path) - 1:
            follow = CLOSING[after]
            piece += "\n" + CLOSE + "".join(map(empty, follow))
            cost, added = cost + int(FINAL[after]), added + len(follow)
        out.append((ROLES[after - 1], kind, cost, added, piece))
    return out


def repair(turns: list[tuple[str | None, str | None]]) -> tuple[list[tuple[str, str, int, int, str]], int, str]:
    """One conversation of (role, text): its rows, total cost and rendering."""
    codes = [role_code(r) for r, _ in turns]
    states = junctions([stretch_matrix(codes)])
    rows = render_moves([t for _, t in turns], cheapest(codes, states[0], states[1]), True, True)
    return rows, sum(r[2] for r in rows), "".join(r[4] for r in rows)


def ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Adds ``stretch`` and ``position`` (from 0, in the stretch) to turns, without sorting a whole conversation in one task.

    Ranges of turn numbers are counted first; a range that holds too many turns
    (repeated numbers) is dealt further by a hash of role and text, then by a
    running number of equal rows.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    hashed = F.pmod(F.xxhash64("role", "text"), F.lit(1 << 20))
    # Equal rows are interchangeable: they are counted and numbered by a sequence instead of a sort.
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("__n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    rows = rows.withColumn("range", F.floor(F.col("turn") / STRETCH)).withColumn("hash", hashed)
    full = rows.groupBy(F.col("conv").alias("__conv"), F.col("range").alias("__range")).agg(F.count(F.lit(1)).alias("__size"))
    rows = rows.join(full, F.col("conv").eqNullSafe(F.col("__conv")) & F.col("range").eqNullSafe(F.col("__range"))).drop("__conv", "__range")
    many = F.col("__size") > 2 * STRETCH
    # Order within a conversation: turn (nulls first), hash, role, text, copy; the stretch key follows it.
    return rows.withColumn("k_turn", F.when(many, F.col("turn"))).withColumn("k_hash", F.when(many, F.floor(F.col("hash") / 64))).withColumn("k_copy", F.when(many, F.floor(F.col("copy") / STRETCH))).drop("__size")


_KEY = ("conv", "range", "k_turn", "k_hash", "k_copy")
_BACK = "conv {conv}, range long, k_turn long, k_hash long, k_copy long"


def repair_table(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn's repair: conversation, ``turn``, ``new_role``, ``action`` (keep, merge, relabel), ``cost``, ``inserted``, ``rendered``, ``place``.

    The ``rendered`` pieces of a conversation, in the order of ``place``, are
    its rendering. Turns are ordered by number, null numbers first; equal
    numbers by a hash of role and text. Roles other than the three (or null)
    have to be relabelled; null texts are empty. Turns with a null conversation
    are one conversation. Repeated rows are repeated turns. An empty table
    gives none.
    """
    kind = dict(df.dtypes)[conv_col]
    rows = stored(ordered(df, conv_col, turn_col, role_col, text_col), "turns")  # three passes follow
    n = rows.count()
    # Many stretches share a Python call; a stretch's size is bounded, so a bucket's is about.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(max(1, -(-n // BUCKET)))))

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, stretch in runs(part):
            m = stretch_matrix([role_code(r) for r in stretch["role"]])
            out.append((*key, len(stretch["role"]), m.ravel().tolist()))
        return pd.DataFrame(out, columns=[*_KEY, "n", "cells"], dtype=object)

    back = _BACK.format(conv=kind)
    stretches = stored(rows.groupBy("bucket").applyInPandas(summed, f"{back}, n long, cells array<long>"), "stretches")
    states = stored(borders(stretches, kind), "borders")
    keyed = [rows[c].eqNullSafe(states[f"s_{c}"]) for c in _KEY]
    joined = rows.join(states, keyed[0] & keyed[1] & keyed[2] & keyed[3] & keyed[4]).drop(*(f"s_{c}" for c in _KEY))

    def repaired(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, s in runs(part):
            path = cheapest([role_code(r) for r in s["role"]], int(s["enter"][0]), int(s["leave"][0]))
            made = render_moves(s["text"], path, bool(s["first"][0]), bool(s["last"][0]))
            start = int(s["before"][0])
            out += [(key[0], t, r, *m, start + i) for i, (t, r, m) in enumerate(zip(s["turn"], s["role"], made, strict=True))]
        return pd.DataFrame(out, columns=["conv", "turn", "role", "new_role", "action", "cost", "inserted", "rendered", "place"], dtype=object)

    schema = f"conv {kind}, turn long, role string, new_role string, action string, cost long, inserted long, rendered string, place long"
    return joined.groupBy("bucket").applyInPandas(repaired, schema).withColumnRenamed("conv", conv_col)


#: Turns, and stretches, that share a Python call, about.
BUCKET = 20_000


def runs(part: pd.DataFrame, key: tuple[str, ...] = _KEY, order: tuple[str, ...] = ("turn", "hash", "role", "text", "copy")) -> Iterator[tuple[tuple, dict[str, list[Any]]]]:
    """Each key's rows in order, as plain lists with None for null; nulls sort first."""
    columns = {c: part[c].astype(object).where(part[c].notna(), None).tolist() for c in part.columns}
    ranked = lambda c, i: (columns[c][i] is not None, columns[c][i] if columns[c][i] is not None else 0)
    index = sorted(range(len(part)), key=lambda i: [ranked(c, i) for c in (*key, *order)])
    at = 0
    while at < len(index):
        own = tuple(columns[c][index[at]] for c in key)
        end = at
        while end < len(index) and tuple(columns[c][index[end]] for c in key) == own:
            end += 1
        yield own, {c: [v[i] for i in index[at:end]] for c, v in columns.items()}
        at = end


def borders(stretches: DataFrame, kind: str) -> DataFrame:
    """States before and after each stretch, its first place, and whether it is its conversation's first or last.

    A stretch is one short row, some thousand times fewer than turns; a
    conversation's are combined in one group.
    """

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, s in runs(part, ("conv",), ("range", "k_turn", "k_hash", "k_copy")):
            states = junctions([np.array(c, dtype=np.int64).reshape(4, 4) for c in s["cells"]])
            before = 0
            for i, n in enumerate(s["n"]):
                out.append((*(s[c][i] for c in _KEY), states[i], states[i + 1], before, i == 0, i == len(s["n"]) - 1))
                before += n
        return pd.DataFrame(out, columns=[*(f"s_{c}" for c in _KEY), "enter", "leave", "before", "first", "last"], dtype=object)

    n = stretches.agg(F.count(F.lit(1))).first()[0]
    schema = ", ".join(f"s_{x}" for x in _BACK.format(conv=kind).split(", ")) + ", enter int, leave int, before long, first boolean, last boolean"
    return stretches.groupBy(F.pmod(F.xxhash64("conv"), F.lit(max(1, -(-n // BUCKET)))).alias("bucket")).applyInPandas(combine, schema)
