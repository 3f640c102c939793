"""Small documents with every awkward row, for brute-force comparisons."""

import random

from pyspark.sql import types as T

# columns that operators use inside, and others that must not matter
CLASHING = ["chunk", "print", "sha", "keep", "n", "rid", "ids", "part", "score", "component", "first", "of", "owner", "sig"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
                      + [T.StructField(c, T.StringType()) for c in CLASHING])


def frame(spark, texts, ids=None, lang="en"):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang, None, None, *["x"] * len(CLASHING)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed: int = 1, bases: int = 25) -> list:
    """Prose with exact copies, near copies, shared passages, hot copies, and null, empty, blank and long texts."""
    rng = random.Random(seed)
    texts = [None, "", "   ", "\n\t", "one", "two words", "Two  Words\n", "é ß 漢字 \U0001f600", "a  b   c\n\n d ", "<|endoftext|> x"]
    shared = prose(rng, 40)
    for _ in range(bases):
        base = prose(rng, rng.randrange(3, 90))
        texts.append(base)
        for _ in range(rng.randrange(0, 4)):
            words = base.split()
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(words))
        if rng.random() < 0.4:
            texts.append(f"{prose(rng, 9)} {shared} {prose(rng, 5)}")
    hot = prose(rng, 30)
    texts += [hot] * 12 + [hot.upper(), prose(rng, 6000), " ".join(["same"] * 300)]
    return texts
