"""Near-duplicate classes against brute force on families of edited copies."""

import random
import re

import numpy as np

from orogen.llm import near_dedup


def brute(rows):
    sets = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split("[ \t-\r]+", low) if x]
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    out = []
    passage = text(60)
    for size, copies, most in ((150, 80, 5), (400, 30, 12), (40, 20, 2), (90, 40, 3)):
        base = text(size)
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randrange(most + 1)):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
    out += [" ".join(passage + text(25)) for _ in range(60)]  # a shared passage, mostly
    out += [" ".join(passage + text(r.randrange(4))) for _ in range(25)]
    out += ["A b C", "a B c", "", "  \t ", "one", "ONE", out[0], out[0].upper(), "x y z w v", "x y z w v"]
    out += [" ".join(text(r.randrange(5, 60))) for _ in range(30)]
    r.shuffle(out)
    return list(enumerate(out))


def test_families_against_brute_force(spark):
    rows = families(1)
    got = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 2), (3, None, 3), (4, "", 4), (None, "p q r s t u v", 5), (9, "x " * 40_000, 6)]
    got = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, sketch int")).collect()
    assert len(got) == 7
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id == 7) == [(7, True), (7, True)]
    assert sorted((str(r.component_id), r.kept) for r in got if r.doc_id is None) == [("7", False), ("None", True)]
    assert {(r.doc_id, r.n_shingles, r.kept) for r in got if r.doc_id in (3, 4, 9)} == {(3, 0, True), (4, 0, True), (9, 1, True)}
    assert near_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bounds_hold_for_random_pairs():
    r = np.random.default_rng(0)
    for n in (3, 20, 64, 70, 100, 200, 400):
        for _ in range(200):
            common = r.integers(-(1 << 62), 1 << 62, n)
            own = max(0, int(n / 0.85) - n)
            cut = int(r.integers(0, own + 1))
            a = np.unique(np.concatenate((common, r.integers(-(1 << 62), 1 << 62, cut))))
            b = np.unique(np.concatenate((common, r.integers(-(1 << 62), 1 << 62, own - cut))))
            assert 100 * n >= 85 * (len(a) + len(b) - n)
            met = len(set(a[: near_dedup.KEEP]) & set(b[: near_dedup.KEEP]))
            assert met >= max(near_dedup._NEED[min(len(a), 511)], near_dedup._NEED[min(len(b), 511)])


def test_links_between_thresholds(spark):
    rows = families(3)
    sets = {i: set(near_dedup.shingles(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in range(a):
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    got = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
    assert len({find(i) for i in sets}) < len({c for _, c in brute(rows).values()})
