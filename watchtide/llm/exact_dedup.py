"""Exact deduplication by exchanging Golomb-coded fingerprints.

Chunks of rows send each owner the sorted, distinct, compressed fingerprints of its range and get a bitmap of those
that other chunks hold too.  Only rows behind a set bit (or repeated inside their chunk) are suspects; their texts are
shuffled and compared byte by byte with the text of the row that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from watchtide.llm import common

BITS = 44  # width of a fingerprint; a chance hit only makes one more suspect


def _blocks(prints: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """Owner and offsets inside its range, for sorted distinct fingerprints."""
    span = -(-(1 << BITS) // owners)
    owner = (prints // np.uint64(span)).astype(np.int64)
    for o in np.unique(owner):
        yield int(o), prints[owner == o] - np.uint64(int(o) * span)


def suspects(marks: DataFrame, owners: int) -> DataFrame:
    """Rows of ``marks`` (rid, chunk, print) whose fingerprint occurs more than once, as (rid)."""
    span = -(-(1 << BITS) // owners)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, prints = int(pdf["chunk"].iloc[0]), np.unique(pdf["print"].to_numpy().astype(np.uint64))
        rows = []
        for owner, offsets in _blocks(prints, owners):
            width = common.rice_width(span, len(offsets))
            rows.append((chunk, owner, len(offsets), width, common.rice_encode(offsets, width)))
        return pd.DataFrame(rows, columns=["chunk", "owner", "n", "width", "blob"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [common.rice_decode(b, n, w) for b, n, w in zip(pdf["blob"], pdf["n"], pdf["width"])]
        found, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = found[times > 1]
        bits = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
        return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "bits": bits})

    def pick(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"rid": pd.Series(dtype="int64")})
        prints, where, times = np.unique(pdf["print"].to_numpy().astype(np.uint64), return_inverse=True, return_counts=True)
        known = dict(zip(replies["owner"], replies["bits"]))
        marked = [np.unpackbits(np.frombuffer(known[o], np.uint8))[: len(x)] for o, x in _blocks(prints, owners)]
        hit = (np.concatenate(marked) > 0) | (times > 1)
        return pd.DataFrame({"rid": pdf["rid"].to_numpy()[hit[where]]})

    slim = marks.select("chunk", "rid", "print")
    sent = slim.groupBy("chunk").applyInPandas(send, "chunk long, owner int, n int, width int, blob binary")
    replies = sent.groupBy("owner").applyInPandas(answer, "chunk long, owner int, bits binary")
    return slim.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(pick, "rid long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prints_per_owner: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Of rows with equal texts the one with the largest id stays (null ids count as smallest; among repeated rows with
    the same id and text exactly one stays).  A null text counts as empty, so null and empty texts form one group.
    An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = common.texts_of(docs, id_col, text_col)
    sha = F.sha2(F.col("text"), 256)
    marks = common.staged(
        texts.select("doc_id", F.monotonically_increasing_id().alias("rid"), sha.alias("sha"),
                     F.octet_length("text").cast("long").alias("n_bytes"),
                     F.shiftrightunsigned(F.xxhash64("text"), 64 - BITS).alias("print"))
        .withColumn("chunk", F.shiftright("rid", common.CHUNK_BITS)), "exact-dedup")
    found = suspects(marks, common.owners_for(spark, marks.count(), prints_per_owner))
    rows = common.staged(marks.join(found, "rid", "left_semi").select("doc_id", "rid", "sha"), "exact-suspects")
    groups = rows.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("n")).where("n > 1")

    # the suspects' texts against the text of the row that stays
    wanted = rows.join(groups, "sha").select(
        F.col("doc_id").alias("of"), "sha", F.col("keep.doc_id").alias("keep_id")).distinct()
    bodies = texts.withColumn("sha", sha)
    mine = common.staged(bodies.join(wanted.withColumnRenamed("sha", "wanted_sha"),
                       bodies["doc_id"].eqNullSafe(F.col("of")) & (F.col("sha") == F.col("wanted_sha"))).select("doc_id", "keep_id", "sha", "text"), "exact-texts")
    # one text per group, written so that both sides of the join are plain reads and a hot group can be split
    theirs = common.staged(mine.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(
        F.any_value("text").alias("other")), "exact-kept")
    checked = mine.join(theirs, "sha").groupBy("doc_id", "sha").agg(F.min(F.col("text") == F.col("other")).alias("same"))

    sure = groups.select(F.col("sha").alias("group_sha"), "keep", "n")
    out = marks.join(sure, F.col("sha") == F.col("group_sha"), "left")
    seen = checked.select(F.col("doc_id").alias("seen_id"), F.col("sha").alias("seen_sha"), "same")
    out = out.join(seen, F.col("doc_id").eqNullSafe(F.col("seen_id")) & (F.col("sha") == F.col("seen_sha")), "left")
    lone = F.col("n").isNull()
    proven = F.when(lone | F.col("same"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("equal digests, different bytes: "), F.col("sha"))).cast("boolean"))
    return out.where(proven).select(
        "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("keep.rid") == F.col("rid"))).alias("kept"), F.col("sha").alias("text_sha256"), "n_bytes")
