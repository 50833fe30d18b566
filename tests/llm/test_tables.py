"""The operators on small tables with nulls, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orogen.llm import ann, bpe, components, language_id, queries, role_repair, secrets, temperature_mix, topk_blocks, toxicity, warc
from orogen.llm.common import shared_path


def base_spans(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_spans(spark):
    r = random.Random(2)
    toks = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "🙂", "deadbeef", "x", "\n", "=="]
    rows = [(i, "".join(r.choice(toks) for _ in range(r.randrange(30))), r.choice(["a/x", "b/y", None]), i) for i in range(800)]
    rows += [(None, None, None, None), (5, "", None, 1), (5, "", None, 1), (7, "secret=token:abcdefgh", "a", 0), (8, "é " * 50_000 + "token=abcdef1", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spans int")
    got = secrets.detect(df, ["doc_id", "text"]).select("text", secrets.label(F.col("base")).alias("base"), secrets.label(F.col("spans")).alias("all")).collect()
    assert len(got) == len(rows) and all(g.base == base_spans(g.text or "") for g in got)
    assert all(set(g.base.split(",")) - {""} <= set(g.all.split(",")) for g in got)
    assert secrets.detect(df.where("false"), ["doc_id"]).count() == 0


def test_ownership_separates_examples(spark):
    wide = "Zx9" * 10
    rows = [(i, f"token=EXAMPLE{'k' * 10} end", f"owner{i}/r") for i in range(4)] + [(9, "token=live1234abcd", "owner1/r"), (10, wide, "owner2/a"), (11, wide, "owner2/b")]
    got = {r.doc_id: r for r in secrets.detect(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "text"]).withColumn("clean", secrets.redact(F.col("text"), F.col("live"))).collect()}
    assert got[0].clean == rows[0][1] and got[9].clean == "[SECRET]"
    assert [s["order"] for s in got[10].spans] == [3] and got[10].clean == "[SECRET]"


def test_archive_round_trip(spark):
    big, small = "<p>é</p>" * 200, "tiny"
    rows = [(1, "u1", big), (2, "u2\r\nX: y", big), (3, None, small), (4, "u4", small), (5, "u5", None), (None, "u6", big), (2, "u2", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.read(spark, warc.write(df, shared_path(spark, "warc"))).collect()
    assert len(got) == 7
    for r in got:
        assert r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload)
    made = {r.record_id: r for r in got}
    assert len(made) == 7 and all((r.refers_to_record is None) == (r.record_type == "response") for r in got)
    assert all(made[r.refers_to_record].id == 2 and made[r.refers_to_record].record_type == "response" for r in got if r.refers_to_record)
    kinds = sorted((str(r.id), r.record_type, r.refers_to) for r in got)
    assert kinds == [("1", "revisit", "2"), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", "2")]
    assert warc.read(spark, warc.write(df.where("false"), shared_path(spark, "warc"))).count() == 0


def test_archive_refuses_a_wrong_payload(spark):
    a = warc.write(spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string"), shared_path(spark, "warc"))
    spark.read.parquet(a.payloads).withColumn("payload", F.lit(b"other")).write.parquet(f"{a.path}/bad/payloads.parquet")
    spark.read.parquet(a.headers).write.parquet(f"{a.path}/bad/headers.parquet")
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, warc.Archive(f"{a.path}/bad")).collect()


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (50, [0.7]), (100, None), (150, [float("nan")]), (200, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (300, [1.0, 2.0]), (11, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(3))
    top = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_blocks.top_k(df, lambda i: i % 50 == 0).collect()}
    assert {q for q, _ in top} == {0, 50, 300} and top[0, 1] == (11, 256 * 256 * 5) and top[0, 2] == (300, 256 * 256 * 5) and top[50, 1][0] == 0
    assert [top[0, i] for i in (3, 4, 5)] == [(7, 0), (50, 128 * 256), (50, 179 * 256)][::-1]  # both rows of id 50
    near = {(r.query_id, r["rank"]): r.vec_id for r in ann.neighbours(df, lambda i: i % 20 == 0).collect()}
    assert {q for q, _ in near} == {0, 300} and [near[0, k] for k in (1, 2, 3, 4)] == [11, 300, 50, 50] and len(near) == 8
    for f in (topk_blocks.top_k, ann.neighbours):
        assert f(df.where("false"), lambda i: i % 20 == 0).count() == 0


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(1, 30), "big" if i % 3 else r.choice(["s1", "s2"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_pass", F.lit("x"))
    got = temperature_mix.mix(df, repeats=2.0).collect()
    total, weight, own, longest = {}, {}, {}, 30
    for g in got:
        total[g.source] = total.get(g.source, 0) + g.mix_tokens
        weight[g.source] = g.mix_weight
    for i, t, s in rows:
        own[s] = own.get(s, 0) + len(t.split())
    assert {g.doc_id for g in got} == {i for i, *_ in rows} and sum(weight.values()) == pytest.approx(1)
    assert max(total[s] / own[s] for s in own) <= 2 and total["big"] == own["big"]
    budget = own["big"] / weight["big"]
    assert all(0 <= budget * weight[s] - total[s] <= longest for s in own)
    assert len({(g.doc_id, g.mix_pass) for g in got}) == len(got)
    assert temperature_mix.mix(df.where("false"), repeats=2.0).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", None), (1, "", None), (2, "a b c", "s")], "doc_id long, text string, source string")
    assert sorted(str(g.doc_id) for g in temperature_mix.mix(odd).collect()) == ["1", "1", "2", "None"]


def test_repair_of_a_table(spark, monkeypatch):
    r = random.Random(3)
    rows = [(c, t, r.choice(["system", "user", "assistant", None]), f"m{c}.{t}") for c in range(12) for t in range(r.randrange(1, 25))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x"))
    for stretch in (4096, 3):
        monkeypatch.setattr(role_repair, "STRETCH", stretch)
        got = role_repair.repair_table(df).collect()
        for c, group in itertools.groupby(rows, key=lambda x: x[0]):
            mine = sorted((g for g in got if g.conv_id == c), key=lambda g: g.place)
            _, cost, text = role_repair.repair([(x[2], x[3]) for x in group])
            assert sum(g.cost for g in mine) == cost
            if stretch == 4096:
                assert "".join(g.rendered for g in mine) == text
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a")] + [(7, 3, "user", f"t{i % 5}") for i in range(40)], "conv_id long, turn long, role string, text string")
    got = role_repair.repair_table(odd).collect()
    assert len(got) == 43 and sorted(g.place for g in got if g.conv_id == 7) == list(range(40))
    assert role_repair.repair_table(odd.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 101), (200, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def clusters(seed):
    """Vectors in 60 clusters whose sizes follow Zipf's law."""
    r = np.random.default_rng(seed)
    share = 1 / np.arange(1, 61)
    home = r.choice(60, 6_000, p=share / share.sum())
    return r.normal(size=(60, 24))[home] * r.uniform(0.3, 3, (60, 1))[home] + 0.1 * r.normal(size=(6_000, 24))


def test_queries_get_all_their_neighbours_on_skewed_clusters(spark):
    x = clusters(3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = {}
    for r in ann.neighbours(df, lambda i: i % 20 == 0).collect():
        rows.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(rows) == list(range(0, 6_000, 20))
    right = 0
    for q, got in rows.items():
        assert sorted(got) == list(range(1, 21)) and len({v for v, _ in got.values()}) == 20 and q not in {v for v, _ in got.values()}
        exact = x @ x[q]
        exact[q] = -np.inf
        right += len({v for v, _ in got.values()} & set(np.argsort(-exact)[:20].tolist()))
    assert right >= 0.95 * 20 * len(rows)


def test_all_labels_are_learned(spark):
    letters = "abcdefghijklmnop"
    rows = [(f"{c}{'xy'[i]}", letters[c % 16] * 3 + letters[c // 16] * 4 + " " + letters[c // 16] * 5, f"l{c}") for c in range(203) for i in range(2 if c else 1)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id string, text string, lang string"), F.lit(True))
    assert model.languages == sorted({r[2] for r in rows})


def test_encoding_of_a_table_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", " \n", "It's 42 Kühe, ǅ!", "<|endoftext|>x", "long word " * 30_000, "It's 42 Kühe, ǅ!", "x" * 70_000]
    df = spark.createDataFrame([(i % 7, t, "clash") for i, t in enumerate(texts)] + [(None, "a", "b")], "doc_id long, text string, ids string")
    got = bpe.encode(df, path).collect()
    for r in got:
        e = library.encode(r.text or "", add_special_tokens=False)
        assert r.ids == " ".join(map(str, e.ids)) and r.n_tokens == len(e.ids) and r.decoded == library.decode(e.ids, skip_special_tokens=False)
    assert len(got) == 9
    digests = {(r.doc_id, r.text): r for r in bpe.encode_digests(df, path).collect()}
    for r in got:
        d = digests[r.doc_id, r.text]
        assert d.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and d.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(df.where("false"), path).count() == 0


def test_a_text_with_many_secrets(spark):
    """Positions, apartness and redaction in a text of 20,000 matches, against a plain walk."""
    r = random.Random(7)
    bits = ["token=abcd12ef ", "é AKIA" + "B" * 17 + " ", "0123456789abcdef01234567, ", "Zx9" * 8 + " 🙂 ", "Zx9" * 8 + "=secret:" + "a1" * 20 + " "]
    text = "".join(r.choice(bits) for _ in range(20_000))
    df = spark.createDataFrame([(1, text, "o/r"), (2, None, None)], "doc_id long, text string, source string")
    out = secrets.detect(df, ["doc_id", "text"]).withColumn("clean", secrets.redact(F.col("text"), F.col("live")))
    start = time.monotonic()
    got = out.where("doc_id = 1").select(secrets.label(F.col("base")).alias("base"), "spans", "live", "clean").first()
    assert time.monotonic() - start < 60  # squares of 20,000 would take many minutes
    assert got.base == base_spans(text)
    base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in got.base.split(","))]
    holds = np.zeros(len(text) + 1, dtype=int)
    for a, b in base:
        holds[a:b] = 1
    before = np.concatenate(([0], np.cumsum(holds)))
    wide = re.finditer(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", text)
    assert [(s["start"], s["end"]) for s in got.spans if s["order"] == 3] == [m.span() for m in wide if before[m.end()] == before[m.start()]]
    want, at = [], 0
    for s in got.live:
        if s["start"] >= at:
            want += [text[at : s["start"]], "[SECRET]"]
        at = max(at, s["end"])
    assert got.clean == "".join(want) + text[at:]


def test_shards_below_a_query_s_bound_are_not_visited(spark, monkeypatch):
    """Exact against brute force over several shards, with fewer meetings than shards times queries."""
    monkeypatch.setattr(topk_blocks, "BLOCK", 8)
    monkeypatch.setattr(topk_blocks, "SHARD", 4)
    monkeypatch.setattr(topk_blocks, "BATCH", 16)
    r = np.random.default_rng(4)
    x = np.floor(r.uniform(0, 1, (640, 12)) * np.linspace(1, 4, 640)[:, None] * 64) / 256  # ranges differ in length
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, v if i % 9 else v[:7]) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    x[::9, 7:] = 0
    met = []
    scored = topk_blocks.scored
    monkeypatch.setattr(topk_blocks, "scored", lambda shards, batches, pairs, k: met.append((pairs.count(), shards.count())) or scored(shards, batches, pairs, k))
    got = topk_blocks.top_k(df, lambda i: i % 20 == 0).collect()
    whole = np.floor(x * 256).astype(int)
    for q in range(0, 640, 20):
        want = sorted((-int(s), d) for d, s in enumerate(whole @ whole[q]) if d != q)[:5]
        assert [(-g.score, g.vec_id) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])] == want
    assert sum(n for n, _ in met) < 0.5 * 32 * met[0][1]


def labelled(n, seed):
    r = random.Random(seed)
    parts = {"x": ["ba", "ko", "tu"], "y": ["schen", "lich", "ung"], "z": ["éa", "ou", "què"]}
    rows = []
    for i in range(n):
        c, bad = r.choice("xyz"), r.random() < 0.2
        words = ["".join(r.choice(parts[c]) for _ in range(3)) for _ in range(20)] + (["idiots"] if bad else [])
        rows.append((i, " ".join(words), c, int(bad)))
    return rows


def test_language_query_on_held_out_rows(spark, tmp_path):
    rows = labelled(600, 3)
    odd = [(None, "ba ko tu" * 5, None), (700, None, "x"), (701, "12 %% \n", "y"), (702, "", "z"), (703, "kotu ba " * 60_000, "x"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([r[:3] for r in rows] + odd, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "ambiguous": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 606 and {(r.doc_id, r.held_out) for r in got if r.doc_id is not None} == {(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in [*range(600), *range(700, 704)]}
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98 and all(0 <= r.score <= 1 for r in got)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (700, 701, 702, 703)} == {(700, "und"), (701, "und"), (702, "und"), (703, "x")}
    empty = df.where("false")
    assert language_id.identify(empty, language_id.fit(empty, F.lit(True))).count() == 0


def test_toxicity_query_on_held_out_rows(spark, tmp_path):
    rows = labelled(900, 5)
    odd = [(None, "idiots", None), (1000, None, None), (1001, "", None), (1002, "baba idiots " + "kotu " * 60_000, None), (3, rows[3][1], None)]
    spark.createDataFrame([(i, t, "s", 0.5) for i, t, *_ in rows + odd], "doc_id long, text string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, _, _, y in rows if i % 10] + [(4, 0, None), (None, 0, 1), (5, 0, 0), (5000, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op10_toxicity(spark, str(tmp_path)).collect()
    truth = {i: y for i, _, _, y in rows}
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(r.held_out for r in held) and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.98
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0} and next(r.predicted for r in got if r.doc_id == 1002) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none, F.lit(True)).score("a") < 0.3


def log_entropy(shares, a):
    w = [s**a for s in shares]
    w = [x / sum(w) for x in w]
    return -sum(x * math.log(x) for x in w), w


def test_exponents_against_plain_bisection(spark):
    tokens = {"a": 900_000, "b": 70_000, "c": 20_000, "d": 11}
    sources = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    top = max(tokens.values())

    def search(fits):
        """The border between exponents that fit (small ones) and those that don't."""
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    for nats in (0.5, 0.9, 1.3):
        a = temperature_mix.exponent_for_entropy(sources, nats)
        assert a == pytest.approx(search(lambda x: log_entropy(tokens.values(), x)[0] >= nats), abs=1e-6)  # noqa: B023
        assert log_entropy(tokens.values(), a)[0] >= nats
    assert temperature_mix.exponent_for_entropy(sources, 0.1) == 1 and temperature_mix.exponent_for_entropy(sources, 9.0) == 0
    for repeats, budget in ((2.0, None), (3.5, None), (2.0, 500_000.0), (1.5, 1_000_000.0)):
        def most(a):
            w = log_entropy(tokens.values(), a)[1]
            whole = budget if budget is not None else top / max(w)  # noqa: B023
            return max(whole * x / t for x, t in zip(w, tokens.values()))

        a = temperature_mix.exponent_for_repeats(sources, repeats, budget)
        assert a == pytest.approx(search(lambda x: most(x) > repeats), abs=1e-6) and most(a) <= repeats * (1 + 1e-6)  # noqa: B023
        planned = {r.source: r for r in temperature_mix.plan(sources, a, budget).collect()}
        w = dict(zip(tokens, log_entropy(tokens.values(), a)[1]))
        assert all(planned[s].weight == pytest.approx(w[s]) for s in tokens) and sum(r.weight for r in planned.values()) == pytest.approx(1)
        whole = budget if budget is not None else top / max(w.values())
        for s, t in tokens.items():
            assert planned[s].passes * t + planned[s].rest == pytest.approx(whole * w[s], abs=1e-3 * t)


def test_partial_passes_against_brute_force(spark):
    """A budget gives each source its whole passes and, of one more, the longest run of places that fits."""
    r = random.Random(21)
    rows = [(i, "w " * r.randrange(1, 40), "big" if i % 3 else r.choice(["s1", "s2"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {i: len(t.split()) for i, t, _ in rows}
    own = {s: sum(size[i] for i, _, o in rows if o == s) for s in ("big", "s1", "s2")}
    for budget, entropy in ((5_000.0, None), (sum(own.values()) * 1.7, 1.0)):
        got = temperature_mix.mix(df, budget=budget, entropy=entropy).collect()
        weight = {g.source: g.mix_weight for g in got}
        if entropy is None:
            assert all(weight[s] == pytest.approx(own[s] / sum(own.values())) for s in weight)
        else:
            assert -sum(w * math.log(w) for w in weight.values()) >= entropy - 1e-9
        key = F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), "text")
        for s in own:
            passes, rest = divmod(budget * weight[s], own[s])
            seen = {}
            for g in got:
                if g.source == s:
                    seen.setdefault(g.mix_pass, set()).add(g.doc_id)
            at = {x.doc_id: x.at for x in df.where(F.col("source") == s).select("doc_id", temperature_mix.place(key, F.lit(int(passes)), 17).alias("at")).collect()}
            whole = {i for i, _, o in rows if o == s}
            want, used = set(), 0
            for i in sorted(whole, key=at.get):
                if used + size[i] > rest:
                    break
                want.add(i)
                used += size[i]
            assert all(seen[p] == whole for p in range(int(passes))) and seen.get(int(passes), set()) == want
            # A pass goes by its places.
            last = sorted((g for g in got if g.source == s and g.mix_pass == int(passes)), key=lambda g: g.mix_position)
            assert [g.doc_id for g in last] == sorted(want, key=at.get)
