"""A corpus through five operators, each stage on all that the one before it kept.

language ID (documents without a letter go) -> exact dedup (of equal texts the largest doc_id stays) ->
n-gram Jaccard join (of linked documents the smallest doc_id stays) -> benchmark decontamination (documents that hold a
passage of a test item go) -> byte-level BPE (the ids, with their digests).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide.llm import bpe, common, decontaminate, exact_dedup, langid, ngram_join
from watchtide.session import tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id and text are not among (doc_id, text_sha256) of ``gone``; a null id counts as a value."""
    other = gone.select(F.col("doc_id").alias("other_id"), F.col("text_sha256").alias("other_sha")).distinct()
    keyed = _keyed(docs)
    same = keyed["doc_id"].eqNullSafe(F.col("other_id")) & (keyed["text_sha256"] == F.col("other_sha"))
    return keyed.join(other, same, "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with a language of the model; one without a letter has none.  A low score alone rejects nothing.

    Where no label was there to learn from, every document with a letter stays.
    """
    known = docs.select(*COLUMNS)
    passed, model = known.withColumn("read", F.coalesce("text", F.lit(""))), langid.train(known)
    if not model.languages:
        return common.map_column(passed, "read", "letters int", langid.letters).where("letters > 0").select(*COLUMNS)
    found = common.map_column(passed, "read", "lang_pred string, score double", langid.labeller(model))
    return found.where(F.col("lang_pred") != langid.NONE).select(*COLUMNS)


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the largest id; repeated rows of one id and text become one row."""
    lost = exact_dedup.exact_dedup(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("repeated")).distinct()
    lost = common.staged(lost, "pipeline-lost")
    keyed = docs.select(*COLUMNS).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = keyed["doc_id"].eqNullSafe(F.col("lost_id")) & (F.col("sha") == F.col("lost_sha"))
    left = keyed.join(lost, same, "left_anti").select(*COLUMNS)
    repeated = lost.where("repeated")
    if repeated.limit(1).count():
        twice = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "sha").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        left = left.unionByName(twice.select("doc_id", "row.*"))
    return left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; documents linked with nothing all stay.

    A null id counts as larger than every other; of several texts under the smallest id the one with the smallest
    digest stays.
    """
    found = ngram_join.join(docs, digests=True)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_sha256") == F.col("component_sha256"))
    return _without(docs, found.where(~first))


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that holds no passage of a test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.matches(_keyed(docs), items, keep=("text_sha256",)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, round_trip) of every document."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.round_trip(docs, ranks, pattern, keep=("lang", "source", "text"))
    return ids.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language ID", identify_language), ("exact dedup", drop_equal_texts), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_benchmark_text), ("byte-level BPE", encode)]

#: SQL cannot express the recurrent network of the first stage; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
