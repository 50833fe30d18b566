"""The operators' kernels against brute force, without Spark."""

import itertools
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orogen.llm import ann, language_id, role_repair, topk_blocks, toxicity
from orogen.llm.bpe import Codec
from orogen.llm.common import BLANK, word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAbzé É'sΣσςİ ﬁ½²٣中文́  \x1c\x1f\x85\x0b\t\n🙂!?.,'t'LL'd0 9_-<|endoftext|>​᠎﻿ǅßİéẛ̣\x00Ａ"


def test_bpe_equals_the_library():
    with open(PATH, encoding="utf-8") as f:
        codec = Codec(json.load(f))
    library = Tokenizer.from_file(PATH)
    r = random.Random(1)
    texts = ["", "Hello  World's\n12", "<|endoftext|>" * 2 + "a <|startoftext|>", "A" * 5000, "word " * 3000]
    texts += ["".join(r.choice(ODD) for _ in range(r.randrange(40))) for _ in range(3000)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, n, decoded = codec.encode(text)
        assert ids == " ".join(map(str, e.ids)) and n == len(e.ids)
        assert decoded == library.decode(e.ids, skip_special_tokens=False) == codec.decode(e.ids)


def test_bpe_cache_is_bounded():
    with open(PATH, encoding="utf-8") as f:
        codec = Codec(json.load(f))
    codec.CACHE = 20 * codec.ENTRY
    first = codec.encode(" ".join(f"w{i}" for i in range(100)))
    assert len(codec.young) <= 10 and len(codec.old) <= 10
    codec.forget()
    assert not codec.young and not codec.old
    assert codec.encode(" ".join(f"w{i}" for i in range(100))) == first


def test_word_hashes_follow_words():
    h = word_hashes(np.frombuffer(b"foo bar\tfoo  baz foo", dtype=np.uint8), BLANK)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    p = word_hashes(np.frombuffer(b"stupidly stupid", dtype=np.uint8), BLANK, (4,))
    assert p[2] == p[3] and p[2] not in (p[0], p[1])


def test_block_search_is_exact():
    r = np.random.default_rng(5)
    docs = r.integers(-20, 20, (900, 6)).astype(float)
    docs[300:600] = docs[300]  # many ties
    queries = docs[::37]
    ids, query_ids = np.arange(900) * 3, np.arange(900)[::37] * 3
    place, got, score, _ = topk_blocks.search(ids, docs, query_ids, queries, 5, block=64)
    full = (queries @ docs.T).astype(int)
    for i, q in enumerate(query_ids):
        best = sorted(((-s, d) for s, d in zip(full[i], ids, strict=True) if d != q))[:5]
        assert sorted((-s, d) for s, d in zip(score[place == i], got[place == i], strict=True)) == best


def test_block_search_prunes_sorted_data():
    docs = np.repeat(np.arange(100.0), 64)[:, None]
    *_, scored = topk_blocks.search(np.arange(6400), docs, np.array([-1]), np.array([[1.0]]), 5, block=64)
    assert scored == 1


def test_products_beyond_a_long_saturate():
    big = np.array([[2.0**40, 2.0**40]])
    assert topk_blocks.exact(big, big)[0, 0] == np.iinfo(np.int64).max
    assert topk_blocks.exact(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 3.0]]))[0, 0] == 2**60 + 3


def test_adaptive_scan_keeps_the_nearest():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 32))
    q = r.normal(size=(40, 32))
    rotation = np.linalg.qr(r.normal(size=(33, 33)))[0]
    index = ann.Index(32, float(np.linalg.norm(x, axis=1).max()), rotation, np.zeros((1, 33)), 1, np.arange(3000), x)
    reach = index.reach(np.full(40, -1), q, 20)
    found = ann.scan(index, np.arange(3000), x, -1 - np.arange(40), reach, q, 20)
    exact = np.argsort(-(q @ x.T), 1)[:, :20]
    hits = [len(set(found[found.query_id == -1 - i].vec_id) & set(exact[i])) for i in range(40)]
    assert np.mean(hits) / 20 >= 0.95
    first = found.iloc[0]
    assert first.score == pytest.approx(float(q[int(-1 - first.query_id)] @ x[int(first.vec_id)]), abs=1e-12)


def test_codewords_are_apart():
    assert language_id.codewords(4).shape == (4, 7)
    big = language_id.codewords(9)
    assert min((a != b).sum() for a, b in itertools.combinations(big, 2)) >= 8


def test_languages():
    r = random.Random(3)
    parts = {"x": ["ba", "ko", "tu"], "y": ["schen", "lich", "ung"], "z": ["éa", "ou", "què"]}
    make = lambda c: " ".join("".join(r.choice(parts[c]) for _ in range(3)) for _ in range(20))
    labels = [r.choice("xyz") for _ in range(120)]
    model = language_id.train([make(c) for c in labels], labels)
    assert all(model.predict(make(c))[0] == c for c in "xyzxyzxyz")
    assert model.predict(None) == model.predict("12 %% \n") == ("und", 0.0, True)
    assert model.predict("中文")[0] in "xyz" and model.predict("ba " * 400_000)[0] == "x"
    assert language_id.train([], []).predict("a")[0] == "und"


def test_toxicity_learns_words_and_pairs():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    clean = [" ".join(word() for _ in range(40)) for _ in range(400)]
    bad = [" ".join([word() for _ in range(40)] + ["idiots" if r.random() < 0.5 else "moron"]) for _ in range(60)]
    m = toxicity.train(clean + bad, [0] * 400 + [1] * 60)
    assert m.score("you " + word() + " idiots") > 0.3 > m.score(" ".join(word() for _ in range(60)))
    assert 0 <= m.score(None) == m.score("") < 0.3
    # Either word alone is harmless; together they are not.
    rows = [(" ".join([word() for _ in range(10)] + s), y) for s, y in ((["alpha"], 0), (["omega"], 0), (["alpha", "omega"], 1)) for _ in range(200)]
    m = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    assert m.score("alpha omega") > 0.5 > max(m.score("alpha"), m.score("omega"))
    # Both or neither: no term tells anything alone, and no additive machine can learn it.
    rows = [(" ".join([word() for _ in range(6)] + s), y) for s, y in (([], 1), (["alpha"], 0), (["omega"], 0), (["alpha", "omega"], 1)) for _ in range(200)]
    m = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    right = lambda machine: np.mean([(machine.score(t) > 0.5) == y for t, y in rows])
    x = np.array([[1, "alpha" in t, "omega" in t] for t, _ in rows], dtype=float)
    additive = x @ np.linalg.lstsq(x, np.array([y for _, y in rows]) - 0.5, rcond=None)[0]
    assert right(m) > 0.95 and np.abs(additive).max() < 0.1
    # A group word that is neutral alone, with an insult that is mostly harmless without it.
    plans = [(["group"], 0, 300), (["insult"], 0, 200), (["insult", "group"], 1, 60), ([], 0, 500), ([], 1, 12)]
    rows = [(" ".join([word() for _ in range(12)] + s), y) for s, y, n in plans for _ in range(n)]
    m = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    assert m.score("insult group") > 0.5 and max(m.score("group"), m.score("insult")) < 0.3
    assert toxicity.train(["a"], [1]).score("a") > 0.5 and toxicity.train([], []).score("a") < 0.5


def cheapest(roles):
    best = [10**9]
    between = lambda p, r: (0 if p is None else None) if r == "system" else (0 if p != r and not (r == "assistant" and p != "user") else 4)

    def walk(i, prev, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + {None: 0, "system": 8, "user": 4, "assistant": 0}[prev])
            return
        for r in ("system", "user", "assistant"):
            relabel = 0 if roles[i] == r else 3
            opening = between(prev, r)
            if opening is not None:
                walk(i + 1, r, cost + relabel + opening)
            if prev == r:
                walk(i + 1, r, cost + relabel + 2)

    walk(0, None, 0)
    return best[0]


def test_repairs_are_cheapest_and_legal():
    r = random.Random(6)
    for _ in range(400):
        roles = [r.choice(["system", "user", "assistant", "tool", None]) for _ in range(r.randrange(7))]
        _, cost, text = role_repair.repair([(x, f"t{i}") for i, x in enumerate(roles)])
        seq = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert cost == (cheapest(roles) if roles else 0)
        assert "system" not in seq[1:] and all(a != b for a, b in itertools.pairwise(seq)) and (not seq or seq[-1] == "assistant")
        assert [f"t{i}" for i in range(len(roles))] == re.findall(r"t\d+", text)


def test_hashes_do_not_depend_on_stretches(monkeypatch):
    r = np.random.default_rng(1)
    letters = lambda n, from_: r.choice(np.frombuffer(from_, dtype=np.uint8), n)
    for data in (letters(5_000, b"abcd  "), letters(3_000, b"ab"), np.concatenate([letters(500, b"ab "), letters(900, b"ab"), letters(500, b"ab ")])):
        whole = word_hashes(data, BLANK), np.sort(word_hashes(data, BLANK, (4, 5)))
        with monkeypatch.context() as m:
            m.setattr("orogen.llm.common.STRETCH", 64)
            assert (word_hashes(data, BLANK) == whole[0]).all() and (np.sort(word_hashes(data, BLANK, (4, 5))) == whole[1]).all()


def test_texts_cannot_forge_marks():
    r = random.Random(11)
    bits = ["<", "|", ">", "end", "system", "user", "<|end|>", "<|system|>", "\n", "<||", "é"]
    for _ in range(300):
        turns = [(x, "".join(r.choice(bits) for _ in range(r.randrange(8)))) for x in ("user", "assistant") * 2]
        rows, _, text = role_repair.repair(turns)
        assert re.findall(r"<\|(system|user|assistant|end)\|>", text) == ["user", "end", "assistant", "end"] * 2
        found = re.findall(r"<\|(user|assistant)\|>\n(.*?)\n<\|end\|>\n", text, re.S)
        assert [(role, role_repair.unescaped(t)) for role, t in found] == turns
