"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding lower-cases, maps look-alike letters of other scripts and digit substitutions inside words to plain letters and
turns everything else into single spaces.  Lexicon entries are whole words and word beginnings whose presence is far
likelier in documents labelled toxic; exceptions are two-word phrases with an entry that clean documents use.  Both are
learned from a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from watchtide.llm import common

SAMPLE_DOCS = 20_000  # labelled documents that the lexicon is learned from, at most
LEAST_DOCS = 4  # toxic documents of the sample that must hold an entry
LEAST_WEIGHT = 1.2  # log odds ratio of an entry, shrunk
ENTRIES = 20_000  # entries kept, the heaviest ones
STEMS = range(4, 11)  # lengths of word beginnings that may become entries
THRESHOLD = 0.3

# Look-alike letters and the plain letters they stand for.
HOMOGLYPHS = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ɡ": "g", "ѵ": "v", "ɑ": "a",
    "​": "", "‌": "", "‍": "", "­": "", "﻿": ""})
# Digits and marks that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
FULL_WIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}

_FOREIGN = re.compile("[ıɑɡͰ-ԯո​-‍­﻿ⅼ！-～]")
_MIXED = re.compile(r"[^\W\d_][013457$@!|8]+(?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def _plain(match: re.Match) -> str:
    return "".join(DIGITS.get(c, c) for c in match.group())


def fold(text: str) -> str:
    """Folded words, each with one space before and after: the empty text gives one space."""
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(FULL_WIDTH).translate(HOMOGLYPHS).lower()
    text = _MIXED.sub(_plain, text)
    return " " + _OTHER.sub(" ", text).strip() + " "


@dataclass
class Lexicon:
    """Weights by entry (' word ' or ' beginning'), exception phrases (' two words '), and the score's line."""
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = -3.0


def entries_of(folded: str) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for w in words:
        for n in STEMS:
            if len(w) < n:
                break
            found.add(" " + w[:n])
    return found


def automaton(lexicon: Lexicon):
    import ahocorasick
    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.weights.items():
        machine.add_word(entry, (len(entry), weight, entry))
    for phrase in lexicon.exceptions:
        machine.add_word(phrase, (len(phrase), None, phrase))
    if len(machine):
        machine.make_automaton()
    return machine


def raw_score(folded: str, machine) -> float:
    """Sum over distinct words hit of their heaviest entry, with repetition counting by logarithm, over a length term.

    A hit that lies inside an exception phrase does not count.
    """
    if not len(machine):
        return 0.0
    hits, excused = [], set()
    for end, (size, weight, entry) in machine.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.update((start, start + entry.index(" ", 1)))
        else:
            hits.append((start, weight, entry))
    best: dict[int, tuple[float, str]] = {}
    for start, weight, entry in hits:
        if start not in excused and (start not in best or weight > best[start][0]):
            best[start] = (weight, entry)
    if not best:
        return 0.0
    total = sum((1 + np.log(n)) * weight for (weight, _), n in Counter(best.values()).items())
    return float(total / (1 + 0.05 * np.log1p(folded.count(" ") / 100)))


def labelled(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample_docs`` labelled documents outside the held-out quarter.

    A document with several labels counts as toxic if one of them says so; unlabelled rows are left out.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    return common.texts_of(docs).join(F.broadcast(marks), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """Lexicon from the bounded sample.  Without a toxic or without a clean document it is empty."""
    sample = common.staged(labelled(docs, labels, sample_docs), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()

    def count(only: frozenset | None, phrases: bool = False):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for pdf in batches:
                for text in pdf["text"]:
                    folded = fold(text)
                    if phrases:
                        words = folded.split()
                        pairs = {f" {a} {b} " for a, b in zip(words, words[1:]) if a != b}
                        seen.update(p for p in pairs if any(e in only for e in entries_of(p)))
                    else:
                        found = entries_of(folded)
                        seen.update(found if only is None else found & only)
            yield pd.DataFrame({"entry": list(seen.keys()), "n": list(seen.values())}).astype({"entry": str, "n": "int64"})
        return run

    def counts(rows: DataFrame, only: frozenset | None, least: int, phrases: bool = False) -> dict[str, int]:
        found = rows.select("text").mapInPandas(count(only, phrases), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
        return {r["entry"]: r["n"] for r in found.where(F.col("n") >= least).collect()}  # of the bounded sample

    toxic, clean = sample.where("toxic > 0"), sample.where("toxic <= 0")
    least = min(LEAST_DOCS, max(1, n_toxic // 10))
    in_toxic = counts(toxic, None, least)
    # an entry needs to be denser among toxic documents; all others go before the clean documents are counted
    in_clean = counts(clean, frozenset(in_toxic), 1)
    weights = {}
    for entry, n in in_toxic.items():
        k = in_clean.get(entry, 0)
        weight = np.log((n + 0.3) / (n_toxic - n + 0.7)) - np.log((k + 0.3) / (n_clean - k + 0.7)) - 2 / np.sqrt(n)
        if weight >= LEAST_WEIGHT:
            weights[entry] = float(weight)
    # a longer beginning stays beside a shorter one only where it weighs more
    for entry in sorted(weights, key=len, reverse=True):
        stem = entry.rstrip()
        if any(weights.get(stem[:n], -1.0) >= weights[entry] for n in range(STEMS[0] + 1, len(stem) + (entry != stem))):
            del weights[entry]
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])
    lexicon = Lexicon(weights)
    if weights:
        # phrases around an entry that clean documents use and toxic ones do not
        common_phrases = counts(clean, frozenset(weights), 3, phrases=True)
        if common_phrases:
            bad = counts(toxic, frozenset(weights), 1, phrases=True)
            lexicon.exceptions = sorted(p for p in common_phrases if p not in bad)  # the sample bounds them
    _calibrate(lexicon, sample)
    return lexicon


def _calibrate(lexicon: Lexicon, sample: DataFrame) -> None:
    """Logistic line from raw score to probability, by Newton steps on the sample."""
    rows = _scored(sample.select("doc_id", "text", "toxic"), lexicon, raw=True).collect()
    x = np.array([r["score"] for r in rows])
    y = np.array([float(r["toxic"] > 0) for r in rows])
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.01 * w * [1, 0]
        w -= np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 0.01 * np.eye(2), grad)
    lexicon.slope, lexicon.offset = float(max(w[0], 0.0)), float(w[1])


def _scored(rows: DataFrame, lexicon: Lexicon, raw: bool = False) -> DataFrame:
    def make():
        machine = automaton(lexicon)

        def run(texts: list[str]) -> tuple[None, list]:
            score = np.array([raw_score(fold(t), machine) for t in texts], float)
            return None, [score if raw else 1 / (1 + np.exp(-np.clip(lexicon.slope * score + lexicon.offset, -30, 30)))]

        return run

    return common.map_column(rows, "text", "score double", make)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row; null and empty texts get the score of a text without a hit."""
    return _scored(common.texts_of(docs, id_col, text_col), lexicon).select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
