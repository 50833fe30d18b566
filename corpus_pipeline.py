"""A corpus from raw documents to token ids, a written table after each stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import bpe, language_id, near_dedup, secrets, temperature_mix
from orogen.llm.common import shared_path

#: Most passes over a source that mixing makes.
REPEATS = 2.0
#: Jaccard similarity of five-word shingles, in hundredths, from which documents are near copies.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifiers tell; texts without a letter and ambiguous ones go."""
    model = language_id.fit(docs, F.lit(True))
    return language_id.identify(docs, model).where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, with the smallest id; texts without a word all stay.

    Rows with one id and text count as one document, of which one row stays.
    Several texts of one id, and documents without an id, are documents apart.
    """
    marked = docs.withColumn("__text", F.xxhash64("text")).withColumn("__row", F.xxhash64("text", "lang", "source", "n_chars"))
    found = near_dedup.dedup(marked, carry=("__text", "__row"), percent=NEAR_PERCENT, key="__key").where("kept")
    row = F.struct(F.col("doc_id").alias("__id"), F.col("__text").alias("__held"), F.col("__row").alias("__own"))
    apart = F.when(F.col("__key").isNull(), F.struct(F.col("doc_id").alias("id"), F.col("__text").alias("text")))  # empty sets have no component
    chosen = found.groupBy("__key", apart.alias("__apart")).agg(F.min(row).alias("__first")).select("__first.*")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__held")) & (F.col("__row") == F.col("__own"))
    # Only equal rows are left beside one another; one of each is found by partial aggregation, however many there are.
    return marked.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__text", "__row"]).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials replaced by a mark; copied examples stay."""
    found = secrets.detect(docs, docs.columns)
    text = F.when(F.size("live") > 0, secrets.redact(F.col("text"), F.col("live"))).otherwise(F.col("text"))
    length = F.when(F.size("live") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", length).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources again, in training order: written files hold it part by part."""
    return temperature_mix.mix(docs, repeats=REPEATS).orderBy("mix_position").select(docs.columns)


def position() -> Column:
    """A row's place in written files, which follow one another by their part's number."""
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(number(r"^part-(\d+)"), 43) + F.shiftleft(number(r"-c(\d+)\."), 33) + F.col("_metadata.row_index")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (decimal, blank-separated) and their number for each document.

    ``position`` keeps the training order of the files that the rows come from;
    it is null for rows that come from elsewhere.
    """
    try:
        placed = docs.select(position().alias("position"), "doc_id", "source", "text")
    except AnalysisException:  # not read from Parquet files
        placed = docs.select(F.lit(None).cast("long").alias("position"), "doc_id", "source", "text")
    return bpe.encode(placed, public_tokenizers.path("word_bpe_49k.json"), add=("n_tokens", "ids")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", deduplicated),
    ("secrets", without_secrets),
    ("temperature_mix", mixed),
    ("bpe", encoded),
]

#: Neither the trained classifiers nor the encoder can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
