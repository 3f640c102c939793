"""Phrase mining against counting every phrase on its own."""

import random
import re
from collections import Counter

from watchtide.llm import collocations

from .cases import frame


def expected(rows, longest=3, shortest=2, least=10, top=2000, covered=50):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for m in range(1, longest + 1):
                for i in range(len(found) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(found[i:i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= shortest and a >= least}
        ranked = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= covered * a for b in inside):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def compare(spark, rows, **more):
    df = frame(spark, [t for _, t in rows]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    got = collocations.mine(df.join(langs, "doc_id").repartition(3), **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, **more)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Été", "漢字", "a-b", "É", "x\x00y", "u\xa0v", "The", "the", "|"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "; ", "\r\n", "\x0b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary if rng.random() < .8 else vocabulary[:3]) + rng.choice(marks) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows


def test_equals_counting_every_phrase(spark):
    rows = corpus(1) + [("en", None), (None, ""), ("fr", " \t\n"), ("de", "one"), ("en", "the the " * 400), ("fr", "New York City. " * 30)]
    rows += [("en", "w1 w2 w3 w4")] * 50
    compare(spark, rows)


def test_other_lengths_and_limits(spark):
    rows = corpus(2, 60)
    compare(spark, rows, longest=4, least=3, top=15, covered=80)
    compare(spark, rows, longest=5, shortest=3, least=2)
    compare(spark, rows, longest=2, least=5)


def test_chunks_owners_and_stretches(spark, monkeypatch):
    rows = corpus(3, 80) + [("en", " ".join(f"w{i % 7}" for i in range(3000))), ("en", "y" * 5000)]
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 300)
    monkeypatch.setattr(collocations, "STRETCH_BYTES", 200)
    monkeypatch.setattr(collocations, "OWNER_BYTES", 500)
    compare(spark, rows, least=4)


def test_stretches_keep_every_window():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", "\t", ".", "\n"]) for _ in range(rng.randrange(0, 80))).encode()
        whole, parts = Counter(), Counter()

        def add(to, data, upto):
            words, columns, counts = collocations.windows(data, upto, 3)
            words = [None, *words.to_pylist()]
            for *w, n in zip(*columns, counts):
                to[tuple(words[x] for x in w)] += n
        add(whole, text, len(text))
        for part, upto in collocations.stretches(text, 3, rng.randrange(1, 20)):
            add(parts, part, upto)
        assert parts == whole


def test_counts_past_64_bits(spark):
    found = spark.createDataFrame([("en", [], 9 * 10 ** 15), ("en", ["a"], 3 * 10 ** 15), ("en", ["b"], 2 * 10 ** 15), ("en", ["a", "b"], 10 ** 15)],
                                  "lang string, words array<string>, f long")
    real, collocations.phrase_counts = collocations.phrase_counts, lambda *a: found
    try:
        got = [tuple(r) for r in collocations.mine(frame(spark, ["x"])).collect()]
    finally:
        collocations.phrase_counts = real
    assert got == [("en", 1, "a b", 10 ** 15, 3 * 10 ** 15, 2 * 10 ** 15, 9 * 10 ** 15, 166666)]


def test_nothing_to_count(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [None, "", " . "])).count() == 0
