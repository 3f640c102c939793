"""Mixtures: targets and quotas against plain versions, taken words against the blocks counted one by one."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from watchtide.llm import mixture

from .cases import frame


def targets_of(sizes: dict, weights=(1, 2, 3), most=3):
    """Share by weight, stop sources at their limit, share what is left again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        units = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / units > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / units for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def highest_quotients(votes, seats):
    """Seat by seat: the highest votes / (2 k - 1), ties to the lower key."""
    quota = {k: 0 for k in votes}
    for _ in range(seats):
        best = max((k for k in votes if votes[k] > 0), key=lambda k: (votes[k] / (2 * quota[k] + 1), -k))
        quota[best] += 1
    return quota


def docs_of(spark, rows):
    df = frame(spark, [t for _, _, t in rows], [i for i, _, _ in rows]).drop("source")
    tagged = spark.createDataFrame([(n, s) for n, (_, s, _) in enumerate(rows)], "n2 long, source string")
    numbered = frame(spark, [t for _, _, t in rows], list(range(len(rows)))).select("doc_id", "text").withColumnRenamed("doc_id", "n2")
    ids = spark.createDataFrame([(n, i) for n, (i, _, _) in enumerate(rows)], "n2 long, doc_id long")
    return numbered.join(tagged, "n2").join(ids, "n2").select("doc_id", "text", "source", F.lit("x").alias("quota"), F.lit("y").alias("size"),
                                                              F.lit("z").alias("shard"), F.lit(1).alias("target")), df


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(seed, n=150):
    rng = random.Random(seed)
    names = ["b", "a", "", "é", "Z", None, "zz"]
    rows = [(i, names[0] if rng.random() < .4 else rng.choice(names), " ".join(["w"] * rng.randrange(0, 300))) for i in range(n)]
    rows += [(n, "a", None), (n + 1, "tiny", "one"), (n + 2, "empty", ""), (n + 3, "a", "u\xa0v\x1cw x\ty\x0bz\n" * 20), (None, "b", "w " * 40), (None, "b", "w " * 50),
             (7, "b", "w " * 33), (7, "b", "w " * 33), (n + 4, "long", "w " * 20000)]
    return rows


def check(spark, rows, block=32, most=3, **more):
    df, _ = docs_of(spark, rows)
    got = mixture.mix(df, block_words=block, most=most, **more)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    out = [tuple(r) for r in got.collect()]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(map(key, out)) == sorted((str(i), str(s), words(t)) for i, s, t in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets_of(sizes, most=most)
    taken = {s: 0 for s in sizes}
    for _, s, size, source_size, target, t in out:
        assert source_size == sizes[s] and abs(target - want[s]) <= 1e-9 * max(1, want[s])
        assert 0 <= t <= most * size
        taken[s] += t
    shards = {s: 1 + sum(1 for r in rows if r[1] == s) // more.get("shard_rows", 4096) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block * (1 + shards[s]), (s, taken[s], want[s])
    again = mixture.mix(df.repartition(7), block_words=block, most=most, **more)
    assert sorted(map(str, out)) == sorted(str(tuple(r)) for r in again.collect())


def test_mix_meets_targets(spark):
    check(spark, corpus(1))


def test_mix_of_many_shards_and_small_blocks(spark):
    check(spark, corpus(2), block=3, shard_rows=16)


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(3)
    rows, seats = [], {}
    for g in range(12):
        seats[g] = rng.choice([0, 1, 5, 40, 333])
        rows += [(g, k, rng.choice([0, 1, 7, 7, 50, rng.randrange(1, 100000)])) for k in range(rng.randrange(1, 30))] + [(g, 99, 3)]
    df = spark.createDataFrame([(*r, seats[r[0]]) for r in rows], "g long, k long, votes long, seats long")
    got = {(r.g, r.k): r.quota for r in mixture.apportion(df, ["g"], ["k"], "votes", F.col("seats")).collect()}
    for g in range(12):
        want = highest_quotients({k: v for a, k, v in rows if a == g}, seats[g])
        assert {k: q for (a, k), q in got.items() if a == g} == want


def test_words_taken_block_by_block():
    rng = random.Random(4)
    for trial in range(200):
        sizes = np.array([rng.choice([0, 1, 3, 10, 45]) for _ in range(rng.randrange(1, 12))])
        length, block, quota = int(sizes.sum()), rng.randrange(1, 9), rng.randrange(0, 60)
        got = mixture.words_taken(sizes, quota, block, 3, [0, trial])
        if not length or not quota:
            assert not got.any()
            continue
        owner = np.tile(np.repeat(np.arange(len(sizes)), sizes), 3)
        flags = mixture.chosen(length, quota, block, 3, [0, trial])
        assert flags.sum() == min(quota, len(flags))
        repeats = np.arange(len(flags)) * block // length
        full = repeats[~flags].min() if (~flags).any() else 3
        assert flags[repeats < full].all() and not flags[repeats > full].any()  # earlier repeats first
        want = np.zeros(len(sizes), np.int64)
        for i, doc in enumerate(owner):
            want[doc] += flags[i // block]
        assert (got == want).all() and (got <= 3 * sizes).all()


def test_seed_changes_choice(spark):
    df, _ = docs_of(spark, corpus(5))
    a, b = (sorted(map(str, mixture.mix(df, seed=s).select("doc_id", "taken").collect())) for s in (0, 1))
    assert a != b


def test_empty_tables(spark):
    assert mixture.mix(docs_of(spark, corpus(1))[0].where("false")).count() == 0
    df, _ = docs_of(spark, [(1, "a", None), (2, None, " "), (3, "a", "")])
    assert sorted(tuple(r)[2:] for r in mixture.mix(df).collect()) == [(0, 0, 0.0, 0)] * 3
