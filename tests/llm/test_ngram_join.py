"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.cases import corpus, frame, prose
from watchtide.llm import ngram_join


def brute(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, d in enumerate(ids)}


def near_copies(seed, words, copies, edits):
    rng = random.Random(seed)
    base = prose(rng, words, 10_000).split()
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(own))
            own[at:at + rng.randrange(3)] = [f"e{rng.randrange(10_000)}"] * rng.randrange(3)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("frequent, texts", [
    (6, corpus(3, 40)), (1, corpus(4, 30)), (2, near_copies(1, 120, 60, 6) + near_copies(2, 30, 40, 3)),
    (1, near_copies(3, 60, 70, 5) + near_copies(4, 9, 30, 1) + near_copies(5, 400, 12, 20)),
    (6, near_copies(6, 100, 150, 9) + near_copies(7, 100, 40, 3) + near_copies(8, 160, 100, 14))])
def test_join_against_all_pairs(spark, monkeypatch, frequent, texts):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame(spark, texts), chunk_bytes=4000).collect()}
    assert got == brute(texts)


def test_awkward_rows(spark):
    assert ngram_join.join(frame(spark, [])).collect() == []
    rows = ngram_join.join(frame(spark, ["a b c d e f", "A B c d e f", None, "", None, "x"], [5, None, None, 3, 3, 9])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in rows) == [
        (-1, 0, -1), (-1, 2, 5), (3, 0, 3), (3, 0, 3), (5, 2, 5), (9, 1, 9)]


@pytest.mark.parametrize("frequent", [1, 3, 60])
def test_linked_sets_share_a_signature(monkeypatch, frequent):
    """The filter alone: whatever the frequency classes, similarity 3/4 means a common signature."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = np.random.default_rng(frequent)
    for n in (2, 3, 4, 7, 8, 20, 64, 200, 900):
        for _ in range(30):
            universe = np.unique(rng.integers(1, 2**63, 2 * n + 4, dtype=np.uint64))
            classes = rng.integers(1, 9, len(universe)).astype(np.uint8)
            a = np.sort(rng.choice(len(universe), n, replace=False))
            drop, add = rng.integers(0, n // 7 + 1), rng.integers(0, n // 7 + 1)
            b = set(a.tolist()) - set(rng.choice(a, drop, replace=False).tolist())
            b |= set(rng.choice(np.setdiff1d(np.arange(len(universe)), a), add, replace=False).tolist())
            b = np.array(sorted(b))
            inter = len(np.intersect1d(a, b))
            if 4 * inter < 3 * (len(a) + len(b) - inter):
                continue
            one = ngram_join.signatures(universe[a], classes[a])
            two = ngram_join.signatures(universe[b], classes[b])
            assert len(np.intersect1d(one, two)) or (len(a) == len(b) == inter)


def test_star_centres():
    n = np.array([3, 4, 4, 5, 6, 7, 10, 2, 9])
    shared = np.array([0, 4, 4, 1, 6, 7, 10, 2, 9])
    assert ngram_join.stars(n, shared, np.array([0, 7])).tolist() == [1, 1, 1, 4, 4, 5, 6, 7, 8]


def test_new_shingles_with_equal_short_hashes_are_not_listed(spark):
    """Two shingles of a set whose hashes begin with the same 32 bits would count once among the common ones."""
    words = prose(random.Random(6), 400_000, 5000).split()
    hashes = ngram_join.rolling([w.encode() for w in words], 5, ngram_join.Words()) >> np.uint64(32)
    order = np.argsort(hashes, kind="stable")
    a, b = next((a, b) for a, b in zip(order, order[1:]) if hashes[a] == hashes[b] and abs(a - b) > 5)
    twice = " ".join(words[a:a + 5] + words[b:b + 5])
    bodies = spark.createDataFrame([(1, "a b c d e f g"), (2, twice), (3, "a b c d e f h")], "member long, text string")
    got = {r["b"]: r for r in ngram_join.verify(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), bodies).collect()}
    assert got[2]["lost"] is None and got[2]["new"] is None
    assert len(got[3]["lost"]) == len(got[3]["new"]) == 1


@pytest.mark.parametrize("seed, size, most", [(1, 60, 14), (2, 140, 30), (3, 24, 8), (4, 7, 4)])
def test_linked_sets_meet_through_their_differences(spark, seed, size, most):
    """Sets around two centres; families of them share edits, so that sets not linked with the centre are linked."""
    rng = random.Random(seed)
    sets, facts, found = {}, [], []

    def linked(x, y):
        return 4 * len(x & y) >= 3 * len(x | y)
    for ctr in (0, 1000):
        base = {ctr * 1000 + i for i in range(size)}
        sets[ctr] = (ctr, base)
        facts.append((ctr, ctr, size, [], []))
        found.append((ctr, ctr))
        edits = [(rng.sample(sorted(base), rng.randrange(most)), rng.sample(range(-9999, 0), rng.randrange(most))) for _ in range(6)]
        for i in range(1, 120):
            lost, new = rng.choice(edits)
            lost = set(lost) ^ set(rng.sample(sorted(base), rng.randrange(1 + most // 3)))
            new = set(rng.sample(new, rng.randrange(len(new) + 1))) | set(rng.sample(range(-9999, 0), rng.randrange(1 + most // 3)))
            sets[ctr + i] = (ctr, (base - lost) | new)
            facts.append((ctr + i, ctr, size, sorted(lost), sorted(new)))
            found.append((ctr + i, ctr if linked(base, sets[ctr + i][1]) else ctr + i))
    facts.append((5000, None, None, None, None))
    found.append((5000, 5000))
    component = dict(found)
    due = {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and component[a] != component[b] and linked(sets[a][1], sets[b][1])}
    assert due
    got = ngram_join.through_differences(
        spark.createDataFrame(facts, "member long, ctr long, n_ctr int, lost array<int>, new array<int>"),
        spark.createDataFrame(found, "id long, component long"))
    got = {(r["a"], r["b"]) for r in got.collect()}
    assert due <= got
    assert all(sets[a][0] == sets[b][0] and component[a] != component[b] for a, b in got)


def test_no_set_without_centre_gives_no_pairs(spark):
    facts = spark.createDataFrame([], "member long, ctr long, n_ctr int, lost array<int>, new array<int>")
    assert ngram_join.through_differences(facts, spark.createDataFrame([], "id long, component long")).collect() == []
