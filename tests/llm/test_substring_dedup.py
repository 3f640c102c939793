"""Substring removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.cases import corpus, frame, prose
from watchtide.llm import ngram_join, substring_dedup


def brute(texts, ids=None, size=13):
    ids = list(range(len(texts))) if ids is None else ids
    words = [(t or "").encode().split() for t in texts]
    least = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in zip(ids, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def rows(df):
    found = df.collect()
    for r in found:
        assert sum(s["past"] - s["first"] for s in r["spans"]) == r["n_removed"]
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found)


def patchwork(seed):
    """Documents pieced together from shared passages, also repeated, rotated and nested ones."""
    rng = random.Random(seed)
    pool = [prose(rng, rng.randrange(10, 200), 5000) for _ in range(8)] + ["same " * 200, "by to " * 90]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(pool).split()
            a = rng.randrange(len(words))
            parts += words[a:a + rng.randrange(5, 150)] + prose(rng, rng.randrange(0, 15), 5000).split()
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("texts", [corpus(6, 30), patchwork(1), patchwork(2)])
def test_against_brute_force(spark, texts):
    assert rows(substring_dedup.dedup(frame(spark, texts), chunk_bytes=6000, shard_bytes=3000)) == brute(texts)


def test_ids_decide_not_the_order(spark):
    texts = patchwork(3)[:25]
    ids = random.Random(1).sample(range(-50, 1 << 60), len(texts))
    assert rows(substring_dedup.dedup(frame(spark, texts, ids))) == brute(texts, ids)


def test_awkward_rows(spark):
    assert substring_dedup.dedup(frame(spark, [])).collect() == []
    passage = " ".join(f"p{i}" for i in range(20))
    texts, ids = [passage, passage, "x " + passage, None, "", passage], [4, 4, None, None, 7, 9]
    got = substring_dedup.dedup(frame(spark, texts, ids)).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in got) == [
        (-1, 0, 0), (-1, 21, 20), (4, 20, 0), (4, 20, 0), (7, 0, 0), (9, 20, 20)]


@pytest.mark.parametrize("partitions", ["4", "1"])
def test_smaller_source_with_a_like_hash(spark, partitions):
    """A window whose hash begins like that of another one, in a smaller document that holds nothing of the passage."""
    words = prose(random.Random(4), 200_000, 5000).split()
    hashes = ngram_join.rolling([w.encode() for w in words], 13, ngram_join.Words()) >> np.uint64(64 - 28)
    order = np.argsort(hashes, kind="stable")
    a, b = next((a, b) for a, b in zip(order, order[1:]) if hashes[a] == hashes[b] and abs(a - b) > 13)
    texts = [" ".join(words[a:a + 13]), "before it " + " ".join(words[b:b + 13]), " ".join(words[b:b + 13]) + " after it"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows(substring_dedup.dedup(frame(spark, texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(texts) and got[2][2] == 13
