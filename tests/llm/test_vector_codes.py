"""Vector codes against a plain computation with Python's integers."""

import hashlib
import math
import random

from pyspark.sql import types as T

from watchtide.llm import vector_codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("of", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA).repartition(3)


def expected(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], None
    width = len(kept[0][1]) // parts
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    split = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(split[e][p]) for e in range(min(entries, len(split)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            near = [nearest(v[p], books[p])[1] for v in split]
            for e in range(len(books[p])):
                mine = [v[p] for v, n in zip(split, near) if n == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for (i, _, label), v in zip(kept, split):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    by_label = {}
    for _, label, _, error in out:
        by_label[label] = by_label.get(label, 0) + error
    large = {label for _, label, _, error in out if error >= 1 << 63} | {label for label, e in by_label.items() if e >= 1 << 63}
    by_label = {label: None if label in large else e for label, e in by_label.items()}
    out = [(*r[:3], r[3] if r[3] < 1 << 63 else None) for r in out]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, label, code, error, by_label[label], digest) for i, label, code, error in out), key=repr), digest


def compare(spark, rows, **more):
    got = vector_codes.encode(frame(spark, rows), **more)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    want, _ = expected(rows, **more)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def vectors(n, length, seed, spread=0.4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(length)], rng.choice([0, 0, 0, 1, 2, None])) for i in range(n)]


def test_codes_equal_plain_computation(spark):
    rows = vectors(300, 32, 1)
    rows += [(i + 1000, list(rows[0][1]), 0) for i in range(60)]  # copies, in a hot label
    compare(spark, rows)


def test_bad_vectors_ties_and_nulls(spark):
    rows = vectors(150, 16, 2, 0.01)  # few distinct integers: many ties
    rows += [(500, None, 1), (501, [None] + [0.1] * 15, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] + [0.0] * 15, 2),
             (504, [], 1), (505, [0.5] * 15, 1), (506, [0.5] * 32, 1), (None, [0.25] * 16, None), (3, [0.1] * 16, 9), (3, [0.1] * 16, 9),
             (507, [-0.0] * 16, 1), (508, [1e-9] * 16, 1), (509, [-1e-9] * 16, 1)]
    compare(spark, rows)


def test_blocks_do_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CELLS", 16 * 7)
    compare(spark, vectors(80, 16, 3), entries=8, rounds=3)


def test_large_values_stay_exact(spark):
    rng = random.Random(4)
    for scale in (100.0, 1e5, 3e7):  # beyond 32 bits, near the end of 64 bits, beyond it
        compare(spark, [(i, [rng.uniform(-scale, scale) for _ in range(16)], i % 2) for i in range(40)], entries=4)


def test_few_and_no_vectors(spark):
    compare(spark, vectors(5, 16, 5))
    assert vector_codes.encode(frame(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.encode(frame(spark, [])).count() == 0
