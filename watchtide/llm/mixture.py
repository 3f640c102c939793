"""Mixing sources to target weights with Sainte-Lague apportionment.

The mix is cut into blocks of equally many words.  Blocks go to the sources by highest quotients target / (2 k - 1), the
blocks of a source go to its shards the same way by their sizes, and a shard then chooses its integer quota of blocks by
seed.  A shard's words, in seeded order and repeated ``most`` times, are one stream; its blocks are stretches of that
stream, and earlier repeats are used up before later ones, so no document is taken more than ``most`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from watchtide.llm import common
from watchtide.operators.running import running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, BLOCK_WORDS, SEED = (1, 2, 3), 3, 32, 0
SHARD_ROWS, SHARD_WORDS = 4096, 1 << 22


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) with weight, rank and target: shares of all words by weight, each at most ``most`` times its size.

    Weights repeat over the sources by code point, null last.  What a source cannot take is shared again by weight: all
    sources below their limit then have one target for each unit of weight, which is found on the sources sorted by limit
    per unit.
    """
    ranked = running(sources, [], [F.col("source").asc_nulls_last()], number="rank")
    ranked = ranked.withColumn("weight", F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    limit = (most * F.col("size")).cast("double")
    upto = running(ranked, [], [limit / F.col("weight"), F.col("rank")], {"filled": F.col("size"), "weighed": F.col("weight")})
    total, units = ranked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # were all sources before this one at their limit, a unit of weight would get so much
    unit = (total - most * (F.col("filled") - F.col("size"))).cast("double") / (units - F.col("weighed") + F.col("weight"))
    level = upto.where(unit * F.col("weight") <= limit).agg(F.max(unit)).first()[0] or 0.0
    return ranked.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def apportion(members: DataFrame, group: list[str], key: list[str], votes: str, seats: Column) -> DataFrame:
    """``members`` with their quota of the seats of their group, by the highest quotients votes / (2 k - 1).

    ``seats`` is the number of seats of the group, on each member.  A member's quota differs from its proportional share
    by half a seat and its share of half a seat for each member; seats below that range are sure, and only quotients
    inside it are ranked, about four for each member.  Equal quotients go by ``key``.
    """
    voted = members.where(F.col(votes) > 0)
    sums = voted.groupBy(*group).agg(F.sum(F.col(votes).cast("double")).alias("_sum"), F.count("*").alias("_members"))
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_sum", "_members")
    meet = F.lit(True)
    for i, g in enumerate(group):
        meet = meet & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    share = F.col(votes).cast("double") / F.col("_sum")
    slack = share * F.col("_members") / 2 + 1
    sized = voted.withColumn("_seats", seats).join(sums, meet)
    sized = sized.withColumn("_sure", F.greatest(F.lit(0), F.floor(share * F.col("_seats") - slack)).cast("long")).withColumn(
        "_most", F.ceil(share * F.col("_seats") + slack).cast("long"))
    offered = sized.select(*group, *key, "_seats", "_sure", votes, F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
    places = running(offered, group, [(F.col(votes).cast("double") / (2 * F.col("_k") - 1)).desc(), *[F.col(k) for k in key]], number="_place")
    open_seats = sized.groupBy(*group).agg((F.max("_seats") - F.sum("_sure")).alias("_open"))
    open_seats = open_seats.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_open")
    won = places.join(open_seats, meet).where(F.col("_place") <= F.col("_open")).groupBy(*group, *key).agg(F.count("*").alias("_won"))
    quotas = sized.select(*group, *key, "_sure").join(won, [*group, *key], "left").select(
        *group, *key, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))
    return members.join(quotas, [*group, *key], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def chosen(length: int, quota: int, block: int, most: int, seed: int) -> np.ndarray:
    """Which blocks of a shard's stream are taken: those of earlier repeats first, inside a repeat by seed."""
    blocks = -(-length * most // block)
    taken = np.zeros(blocks, bool)
    if quota >= blocks:
        taken[:] = True
        return taken
    repeat = np.arange(blocks, dtype=np.int64) * block // max(1, length)
    order = np.lexsort((np.random.default_rng(seed).permutation(blocks), repeat))
    taken[order[:quota]] = True
    return taken


def words_taken(sizes: np.ndarray, quota: int, block: int, most: int, seed: int) -> np.ndarray:
    """Words of each document, in the shard's order, that lie in chosen blocks; repeats counted."""
    ends = np.cumsum(sizes)
    length = int(ends[-1]) if len(ends) else 0
    if not length or not quota:
        return np.zeros(len(sizes), np.int64)
    taken = chosen(length, quota, block, most, seed).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(taken)]) * block
    taken = np.append(taken, 0)

    def upto(place: np.ndarray) -> np.ndarray:
        return before[place // block] + taken[place // block] * (place % block)

    total = np.zeros(len(sizes), np.int64)
    for repeat in range(most):
        total += upto(ends + repeat * length) - upto(ends - sizes + repeat * length)
    return total


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED,
        shard_rows: int = SHARD_ROWS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many of a document's words the mix takes.

    A null text has size 0, a null source is a source of its own after all others.  Documents of size 0 are returned and
    take nothing; where all are, targets are 0.  A source takes its target rounded to whole blocks.  Null and repeated ids
    are told apart by their texts; equal rows share a shard and are interchangeable.  The result depends on rows and seed
    alone, not on how they are partitioned.
    """
    sized = common.staged(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias("place"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    aimed = common.staged(targets(sources, weights, most), "mix-targets")
    total = aimed.agg(F.sum("size")).first()[0] or 0
    quotas = apportion(aimed.withColumn("mix", F.lit(0)), ["mix"], ["rank"], "target", F.lit(round(total / block_words)))
    quotas = common.staged(quotas.select(
        F.col("source").alias("from"), F.col("rank").alias("origin"), F.col("size").alias("source_size"), "target", "quota",
        F.greatest(F.ceil(F.col("rows") / shard_rows), F.ceil(F.col("size") / shard_words), F.lit(1)).alias("shards")), "mix-quotas")
    placed = sized.join(quotas, F.col("source").eqNullSafe(F.col("from"))).withColumn("shard", F.pmod(F.col("place"), F.col("shards")))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "place", "origin", "shard", F.col("quota").alias("blocks"))
    shards = placed.groupBy("origin", "shard").agg(F.sum("size").alias("held"), F.first("blocks").alias("blocks"))
    shares = common.staged(apportion(shards, ["origin"], ["shard"], "held", F.col("blocks")).select("origin", "shard", "quota"), "mix-shards")

    def choose(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        group = group.take(pa.compute.sort_indices(group, [("place", "ascending"), ("doc_id", "ascending"), ("size", "ascending")]))
        taken = words_taken(group.column("size").to_numpy(), first["quota"], block_words, most,
                            [seed, first["origin"], first["shard"]])
        return group.select(["doc_id", "source", "size", "source_size", "target"]).append_column("taken", pa.array(taken, pa.int64()))

    dealt = placed.drop("blocks").join(shares, ["origin", "shard"])
    return dealt.groupBy("origin", "shard").applyInArrow(
        choose, "doc_id bigint, source string, size bigint, source_size bigint, target double, taken bigint")
