"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased words without marks; in scripts without spaces each character is a word.  A test item
is cut into passages of similar length that overlap by half; a passage of n words may differ by ``int(rate * n)`` word edits.  It is split into one piece more than that budget, so a text
within the budget holds at least one piece unchanged.  An Aho-Corasick automaton finds the piece hits in one pass over
a document, and Myers' bit-parallel distance, one bit per word of the passage, decides around each hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from watchtide.llm import common

RATE = 0.2  # word edits allowed per word of a passage
PASSAGE_WORDS = 32  # aimed length of a passage
LEAST_WORDS = 8  # a shorter item is looked for unchanged
PHRASE_WORDS = 3  # a still shorter one only matches a document that has no other words
BLOCK_BYTES = 8 << 20  # text of the test items that one pass over the documents looks for

_BREAK = re.compile(r"[\W_]+")
#: Letters of Thai, Lao, Myanmar, Khmer, kana and Chinese characters, which are written without spaces.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                       "\uff66-\uff9f\U00020000-\U0003ffff])")


def plain(text: str) -> str:
    """Lower-cased words between single spaces, with one at either end; '' without a word."""
    text = text.lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    words = _BREAK.sub(" ", text).strip()
    return f" {words} " if words else ""


def passages(words: list[str], size: int = PASSAGE_WORDS) -> list[list[str]]:
    """Parts of ``words`` of nearly equal length, about ``size`` each; each begins in the middle of the one before."""
    halves = 2 * max(1, round(len(words) / size))
    return [words[len(words) * i // halves: len(words) * (i + 2) // halves] for i in range(halves - 1)]


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """``budget`` + 1 consecutive ranges of nearly equal length over n words."""
    return [(n * i // (budget + 1), n * (i + 1) // (budget + 1)) for i in range(budget + 1)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least word edit distance between ``pattern`` and any stretch of ``text``, and the first end where it occurs."""
    n, masks = len(pattern), {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # row 0 stays 0: a match may begin anywhere
        plus, minus = down | ~(xv | up) & full, up & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The automaton over the pieces of some test items (item_id, text), and the checks of its hits."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, size: int = PASSAGE_WORDS):
        import ahocorasick
        self.rate, self.whole, self.passages = rate, {}, []
        found: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            folded = plain(text)
            words = folded.split()
            if len(words) < PHRASE_WORDS:
                if words:
                    self.whole.setdefault(folded, []).append((item, len(words)))
                continue
            for part in passages(words, size):
                number, budget = len(self.passages), int(rate * len(part)) if len(words) >= LEAST_WORDS else 0
                self.passages.append((item, part, budget))
                for a, b in pieces(len(part), budget):
                    found.setdefault(f" {' '.join(part[a:b])} ", []).append((number, a))
        self.totals: dict[int, int] = {}
        for item, _, _ in self.passages:
            self.totals[item] = self.totals.get(item, 0) + 1
        self.machine = ahocorasick.Automaton()
        for piece, where in found.items():
            self.machine.add_word(piece, (len(piece), where))
        if found:
            self.machine.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, passages found, passages of the item, word edits, word number where the first one ends)."""
        folded = plain(text)
        for item, n in self.whole.get(folded, ()):
            yield item, 1, 1, 0, n
        hits = list(self.machine.iter(folded)) if folded and len(self.machine) else []
        if not hits:
            return
        words = folded.split()
        spaces = np.flatnonzero(np.frombuffer(folded.encode("utf-32-le"), np.uint32) == 32)
        at = np.searchsorted(spaces, [end - size + 1 for end, (size, _) in hits])
        regions: dict[int, list[list[int]]] = {}
        for first, (_, (_, where)) in zip(at.tolist(), hits):
            for number, offset in where:
                _, part, budget = self.passages[number]
                low, high = max(0, first - offset - budget), first - offset + len(part) + budget
                own = regions.setdefault(number, [])
                if own and own[-1][0] <= low <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        best: dict[int, list[tuple[int, int]]] = {}
        for number, spans in regions.items():
            item, part, budget = self.passages[number]
            found = [(d, low + end) for low, high in spans for d, end in [myers(part, words[low:high])] if d <= budget]
            if found:
                best.setdefault(item, []).append(min(found))
        for item, found in best.items():
            yield item, len(found), self.totals[item], sum(d for d, _ in found), min(end for _, end in found)


def matches(docs: DataFrame, bench: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, item_id, passages_found, passages, edits, end_word): documents that hold a passage
    of a test item.

    Passages overlap, so words and their edits may count in two.  Items of fewer than LEAST_WORDS words are one passage
    without edits, those of fewer than PHRASE_WORDS match only a document that consists of nothing else; an excerpt
    that holds no passage of its item within the edits is not found.
    Null and empty texts and items match nothing.  Items are looked for in blocks of bounded size, one pass over the
    documents for each; repeated items are all reported, repeated rows give repeated results.
    """
    items = bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def block(number: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number) if blocks > 1 else items
        wanted = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()])

        def make():
            matcher = Matcher(wanted.value, rate)

            def run(found: list[str]) -> tuple[list, list]:
                rows = [(place, *m) for place, text in enumerate(found) for m in matcher(text)]
                places, *columns = zip(*rows) if rows else ((),) * 6
                return places, columns

            return run

        return common.map_column(texts, "_text", "item_id long, passages_found int, passages int, edits int, end_word int", make)

    found = block(0)
    for number in range(1, blocks):
        found = found.unionByName(block(number))
    return found
