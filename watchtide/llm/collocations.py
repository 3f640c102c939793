"""Phrase collocation mining by top-order marginalisation.

Every word opens one window: the word and the words that lead it, padded where its piece of text ends.  Only these
longest windows are counted; the count of a shorter phrase is the sum over the windows that begin with it, which one
ROLLUP yields for all lengths.  Tasks count the windows of a chunk of texts first and send them, packed, to owners by a hash
of the whole window, so a frequent phrase is one entry for each chunk however often it occurs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from watchtide.llm import common

LONGEST, SHORTEST, LEAST, TOP, COVERED = 3, 2, 10, 2000, 50
CHUNK_BYTES = 16 << 20  # text that is counted together in a task
STRETCH_BYTES = 32 << 20  # longer texts are counted in stretches
OWNER_BYTES = 16 << 20  # text for each owner
SHARES = 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE, _END = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACE)] = 1
_KIND[list(_END)] = 2
_WORD = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]*[^ \t.,;:!?\n\x0b\x0c\r]+")
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, their places, and whether a word is the first of its piece.  All marks are ASCII, so bytes will do."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ended = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int32)])
    opens = np.ones(len(starts), bool)
    opens[1:] = ended[starts[1:]] != ended[ends[:-1]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, starts, opens


def _grouped(columns: list[np.ndarray], spans: list[int], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each distinct combination of codes, and the rows (or weights) that have it."""
    key, size = columns[0].astype(np.int64), spans[0]
    for column, span in zip(columns[1:], spans[1:]):
        if size * span >= 1 << 63:
            found, key = np.unique(key, return_inverse=True)
            size = len(found)
        key, size = key * span + column, size * span
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if weights is None:
        return order[first], np.diff(np.append(first, len(key)))
    return order[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


def windows(data: bytes, upto: int, longest: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """Dictionary, lead columns (0: padding, else 1 + place in the dictionary) and counts of the windows before ``upto``."""
    words, starts, opens = words_of(data)
    coded = words.dictionary_encode()
    lead = coded.indices.to_numpy().astype(np.int64) + 1
    columns, goes_on = [lead], ~opens
    for _ in range(longest - 1):
        lead = np.append(np.where(goes_on, lead, 0)[1:], 0)[:len(lead)]  # the next word's column, unless a piece begins there
        columns.append(lead)
    n = int(np.searchsorted(starts, upto))
    columns = [c[:n] for c in columns]
    places, counts = _grouped(columns, [len(coded.dictionary) + 1] * longest)
    return coded.dictionary.cast(pa.binary()), [c[places] for c in columns], counts


def stretches(text: bytes, longest: int, size: int = STRETCH_BYTES) -> Iterator[tuple[bytes, int]]:
    """A long text as stretches with the words their last windows reach into, and where these words begin."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = reach = gap.start() if gap else len(text)
        for _ in range(longest - 1):
            word = _WORD.match(text, reach)
            reach = word.end() if word else reach
        yield text[at:reach], end - at
        at = end


_BASE = 0x9E3779B97F4A7C15  # odd, so its powers can be undone


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit polynomial hashes of the words by code, from the bytes as a whole; 0 stands for padding."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64) + np.uint64(1)
    offsets -= offsets[0]
    powers, back = np.ones(len(raw) + 1, np.uint64), np.ones(len(raw) + 1, np.uint64)
    powers[1:], back[1:] = _BASE, pow(_BASE, -1, 1 << 64)
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * powers[:-1])])
    return np.concatenate([np.zeros(1, np.uint64), (sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]]])


def _dealt(lang: str, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray, by: int, owners: int) -> Iterator[tuple]:
    """(owner, lang, words, codes): windows by a hash of their first ``by`` words, with a dictionary of their own.

    Codes are dealt out by frequency and stored byte plane by byte plane, so most planes are nearly empty.
    """
    hashes = _hashes(words)
    mixed = np.full(len(counts), zlib.crc32(lang.encode()), np.uint64)
    for column in columns[:by]:
        mixed = (mixed ^ hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    owner = ((mixed >> np.uint64(20)) % np.uint64(owners)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(owner[order]) > 0])) if len(owner) else []
    for at, end in zip(starts, [*starts[1:], len(owner)]):
        rows = order[at:end]
        used, local, times = np.unique(np.stack([c[rows] for c in columns]), return_inverse=True, return_counts=True)
        real = used > 0
        rank = np.zeros(len(used), np.int64)
        common_first = np.flatnonzero(real)[np.argsort(-times[real], kind="stable")]
        rank[common_first] = np.arange(1, len(common_first) + 1)
        cells = np.vstack([rank[local].reshape(len(columns), -1), counts[rows]]).astype("<u8")
        planes = np.ascontiguousarray(cells.view(np.uint8).reshape(len(columns) + 1, -1, 8).transpose(0, 2, 1))
        named = b"\n".join(words.take(pa.array(used[common_first] - 1)).to_pylist())  # no word holds a line end
        yield int(owner[rows[0]]), lang, zstandard.compress(named), zstandard.compress(planes.tobytes())


def _united(blobs: list[dict], width: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """Dictionary, columns and counts of the windows of several parcels."""
    lists, cells = [], []
    for blob in blobs:
        named = zstandard.decompress(blob["words"])
        lists.append(named.split(b"\n") if named else [])
        planes = np.frombuffer(zstandard.decompress(blob["codes"]), np.uint8).reshape(width + 1, 8, -1)
        cells.append(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8")[..., 0].astype(np.int64))
    coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
    places, at = coded.indices.to_numpy().astype(np.int64) + 1, 0
    for words, cell in zip(lists, cells):
        cell[:width] = np.concatenate([[0], places[at:at + len(words)]])[cell[:width]]
        at += len(words)
    whole = np.concatenate(cells, axis=1)
    return coded.dictionary, list(whole[:width]), whole[width]


def counted_windows(texts: DataFrame, longest: int, least: int, owners: int) -> DataFrame:
    """(lang, w1 ... wn, n): the windows of (lang, text), counted and padded from the word that makes them rare.

    A window matters to the phrases it begins with.  Where its first m words occur less than ``least`` times, only its
    first m - 1 words can still matter, so the others become padding and windows fall together; sums over prefixes stay
    what they are.  One pass for each length m finds that out, at the owners of the first m words.
    """
    names = [f"w{i}" for i in range(1, longest + 1)]
    parcel = pa.schema([("owner", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("codes", pa.binary())])

    def batch_of(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, parcel.types)], schema=parcel)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def counted(lang: str, data: bytes, upto: int) -> Iterator[pa.RecordBatch]:
            return map(batch_of, _dealt(lang, *windows(data, upto, longest), longest, owners))

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            data = b"\n".join(waiting.pop(lang))
            del held[lang]
            return counted(lang, data, len(data))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if len(text) > STRETCH_BYTES:
                    for part, upto in stretches(text, longest, STRETCH_BYTES):
                        yield from counted(lang, part, upto)
                    continue
                waiting.setdefault(lang, []).append(text)
                held[lang] = held.get(lang, 0) + len(text)
                if held[lang] >= CHUNK_BYTES:
                    yield from flush(lang)
        for lang in list(waiting):
            yield from flush(lang)

    def padding(m: int):
        def run(group: pa.Table) -> pa.Table:
            by_lang: dict[str, list] = {}
            for blob in group.to_pylist():
                by_lang.setdefault(blob["lang"], []).append(blob)
            out = []
            for lang, blobs in by_lang.items():
                words, columns, n = _united(blobs, longest)
                spans = [len(words) + 1] * longest
                places, n = _grouped(columns, spans, n)
                columns = [c[places] for c in columns]  # sorted by the columns, so equal beginnings lie together
                if len(n):
                    new = np.any([np.diff(c, prepend=-1) != 0 for c in columns[:m]], axis=0)
                    rare = (np.add.reduceat(n, np.flatnonzero(new)) < least)[np.cumsum(new) - 1]
                    columns = [np.where(rare, 0, c) if i >= m - 1 else c for i, c in enumerate(columns)]
                places, n = _grouped(columns, spans, n)
                columns = [c[places] for c in columns]
                if m > 1:
                    out.append(pa.Table.from_batches(map(batch_of, _dealt(lang, words, columns, n, m - 1, owners)), parcel))
                else:
                    taken = [words.take(pa.array(c - 1, mask=c == 0)).cast(pa.string()) for c in columns]
                    out.append(pa.table([pa.array([lang] * len(n), pa.string()), *taken, pa.array(n, pa.int64())], names=["lang", *names, "n"]))
            return pa.concat_tables(out)
        return run

    parcels = texts.mapInArrow(count, "owner bigint, lang string, words binary, codes binary")
    for m in range(longest, 0, -1):
        schema = "owner bigint, lang string, words binary, codes binary" if m > 1 else (
            "lang string, " + "".join(f"{w} string, " for w in names) + "n bigint")
        parcels = parcels.groupBy("owner").applyInArrow(padding(m), schema)
    return parcels


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, f) of all phrases of up to ``longest`` words that occur ``least`` times; the empty phrase counts all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(1, -(-size // OWNER_BYTES))  # by the text alone: parcels are tasks times owners
    names = [f"w{i}" for i in range(1, longest + 1)]
    top = counted_windows(texts, longest, least, owners)
    rolled = top.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    kept = F.lit(False)
    words = F.array().cast("array<string>")
    for m in range(longest + 1):
        level = F.col("rolled") == (1 << (longest - m)) - 1
        kept = kept | (level & ((F.col(names[m - 1]).isNotNull() & (F.col("f") >= least)) if m else F.lit(True)))
        words = F.when(level, F.array(*names[:m]).cast("array<string>")).otherwise(words)
    return rolled.where(kept).select("lang", words.alias("words"), "f")


def mine(docs: DataFrame, longest: int = LONGEST, shortest: int = SHORTEST, least: int = LEAST, top: int = TOP, covered: int = COVERED,
         lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scoring phrases of each language.

    Null texts count as empty, null languages as ``und``; a text without words adds nothing, repeated rows count each time.
    A phrase is cut where its score floor(1000000 a a / (l r)) is lowest, of equal ones after the fewest words.  Candidates
    inside a longer candidate that has at least ``covered`` percent of their count are left out.  Ties in score and count
    are ordered by the phrase's bytes, so ranks are unique.  Texts of any length are counted whole.
    """
    found = common.staged(phrase_counts(docs, longest, least, lang_col, text_col), "phrases")
    counts = found.select("lang", F.array_join("words", " ").alias("phrase"), "f")
    candidates = found.where(F.size("words") >= shortest).select(
        "lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"),
                       F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = "cast({} AS decimal(18,0))".format
    score = F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    inner = candidates.where(F.size("words") > shortest).select(
        "lang", "words", "a", F.explode(F.sequence(F.lit(shortest), F.size("words") - 1)).alias("m"))
    inner = inner.select("lang", "words", "a", "m", F.explode(F.expr("sequence(1, size(words) - m + 1)")).alias("i"))
    longer = inner.select("lang", F.expr("array_join(slice(words, i, m), ' ')").alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < covered * F.col("a").cast("decimal(20,0)")))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))  # a common language is ranked in shares first
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = found.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
