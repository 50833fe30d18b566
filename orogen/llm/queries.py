"""The ``opN_*`` queries and the pipeline, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import ann, bpe, language_id, near_dedup, role_repair, secrets, temperature_mix, topk_blocks, toxicity, warc
from orogen.llm.common import id_remainder, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_blocks.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, d.vec_id as vec_id,
  list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2]))::bigint as score
  from (select distinct vec_id, e from v where vec_id % 50 = 0) q join v d on q.vec_id <> d.vec_id),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from pairs)
select * from ranked where rank <= 5
"""


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op3_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = role_repair.repair_table(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "place", "turn", "role", "new_role", "action", "cost", "inserted", "rendered")


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = temperature_mix.mix(docs, repeats=2.0)
    return out.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_pass", "mix_position")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.detect(docs, ["doc_id"])
    number = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")
    base = secrets.label(F.col("base"))
    return found.select("doc_id", *(number(k).alias(f"n_{c}") for k, c in enumerate(secrets.KINDS[:3])), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.label(F.col("spans")).alias("spans"), F.size("live").cast("long").alias("n_live"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    out = warc.read(spark, archive)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as lead from p where octet_length(encode(h)) >= 1000 group by h having count(*) > 1)
select page_id, cast(octet_length(encode(p.h)) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
  case when lead is not null and page_id is distinct from lead then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from lead then lead end as refers_to
from p left join g on p.h = g.h
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 5) == 0
    model = language_id.fit(docs, ~held_out)
    out = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select doc_id as node, doc_id as other from s union select r.node, l.b from reach r join links l on r.other = l.a),
low as (select node, min(other) as component_id from reach group by node)
select s.doc_id, len(s.sh)::bigint as n_shingles, low.component_id, s.doc_id = low.component_id as kept
from s join low on s.doc_id = low.node
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 4) == 2
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    out = toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), machine)
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_blocks": op1_topk_blocks,
    "op2_ann": op2_ann,
    "op3_role_repair": op3_role_repair,
    "op4_temperature_mix": op4_temperature_mix,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op8_near_dedup": OP8_SQL,
    "op1_topk_blocks": OP1_SQL,
    "op6_warc": OP6_SQL,
}
