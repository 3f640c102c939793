"""Removal of passages that occurred in a document with a smaller id, by repeated-phrase automata.

1. Chunks of documents learn from the owners of the window hashes which windows of 13 words occur in more than one
   document.  Only the stretches of words that such windows cover go on.
2. Owners name the smallest document of each of these windows.  Consecutive windows of a document with the same
   smallest document are a claim on a passage of that source, cut into overlapping phrases of bounded length.
3. The claims are dealt to shards by source, a source with many claimants over several.  A shard compiles its phrases,
   as sequences of word numbers, into an Aho-Corasick automaton, confirms them by streaming the sources, and streams
   the claiming documents to locate every occurrence.  A phrase that its source does not hold in one piece (the source
   has its windows at different places) is tried again window by window.
4. The documents meet the spans that were found, and lose these words.

So hashes only propose; what is removed was found word by word in both documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from watchtide.llm import common
from watchtide.llm.ngram_join import CHUNK_BYTES, classes_of, frequencies, owned, rolling, worker_words

WINDOW = 13  # words
PHRASE = 64  # words of a phrase, at most; consecutive phrases share WINDOW - 1 words
SHARD_BYTES = 2 << 20  # text of the claiming documents of a shard, about
NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than every other


def windows(texts: pd.Series, size: int) -> Iterator[np.ndarray]:
    words = worker_words()
    for text in texts:
        yield common.distinct(rolling(text.encode("utf-8", "replace").split(), size, words))


def recurring(chunked: DataFrame, bits: int, owners: int, size: int) -> DataFrame:
    """(chunk, uid, key, starts, lengths, body, hashes) of each document with windows that another may hold as well.

    ``starts`` and ``lengths`` are the stretches of words that such windows cover, ``body`` their words, one stretch
    per line, and ``hashes`` the hashes of their windows in order.
    """
    shift, wide = np.uint64(64 - bits), np.uint64((1 << 22) - 1)

    def sets(texts: pd.Series) -> Iterator[np.ndarray]:
        return windows(texts, size)

    def run(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        words, rows = worker_words(), []
        split = [t.encode("utf-8", "replace").split() for t in pdf["text"]]
        held = [rolling(parts, size, words) for parts in split]
        every = common.distinct(np.concatenate(held) >> shift) if held else np.zeros(0, np.uint64)
        again = every[classes_of(every, bits, owners, replies) > 0]
        table = np.zeros(1 << 22, bool)  # most windows are told apart by a look into this
        table[(again & wide).astype(np.int64)] = True
        for uid, key, parts, own in zip(pdf["uid"], pdf["key"], split, held):
            short = own >> shift
            at = np.flatnonzero(table[(short & wide).astype(np.int64)])
            if len(at):
                at = at[again[np.minimum(np.searchsorted(again, short[at]), len(again) - 1)] == short[at]]
            if not len(at):
                continue
            opens = np.flatnonzero(np.r_[True, np.diff(at) >= size])  # windows that overlap or touch share a stretch
            starts, ends = at[opens], at[np.r_[opens[1:], len(at)] - 1] + size
            body = b"\n".join(b" ".join(parts[a:b]) for a, b in zip(starts, ends))
            hashes = np.concatenate([own[a:b - size + 1] for a, b in zip(starts, ends)])
            rows.append((uid, key, starts.astype("<i4").tobytes(), (ends - starts).astype("<i4").tobytes(), body, hashes.astype("<u8").tobytes()))
        out = pd.DataFrame(rows, columns=["uid", "key", "starts", "lengths", "body", "hashes"])
        return out.assign(chunk=int(pdf["chunk"].iloc[0]) if len(pdf) else 0)

    answers = frequencies(chunked.select("chunk", "uid", "key", "text"), bits, owners, sets, copies=2)
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, STRETCHES)


STRETCHES = "chunk long, uid long, key long, starts binary, lengths binary, body binary, hashes binary"


def _packed(ids: np.ndarray) -> bytes:
    """Ids that repeat a lot: the distinct ones and their places."""
    who, which = np.unique(ids, return_inverse=True)
    return zlib.compress(np.array([len(who)], "<i8").tobytes() + who.astype("<i8").tobytes() + which.astype("<u2" if len(who) < 1 << 16 else "<u4").tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    m = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, "<i8", m, 8)[np.frombuffer(raw, "<u2" if m < 1 << 16 else "<u4", offset=8 + 8 * m)]


def _least(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes and the smallest id of each."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], ids[first]


def claims(stretches: DataFrame, owners: int, size: int) -> DataFrame:
    """(source, uid, key, runs, n_bytes): ``runs`` holds first and last window of each run that claims ``source``,
    counted in words over the document's stretches with one place between them.

    Each window names one source, so all 64 bits of its hash go: a source that only shares some of them would displace
    the true one.
    """
    owners = max(2, owners)  # the range of a single one would not fit into 64 bits
    bits, span = 64, -(-(1 << 64) // owners)
    slim = stretches.select("chunk", "uid", "key", "lengths", "hashes", F.octet_length("body").alias("n_bytes"))

    def own(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        held = [np.frombuffer(h, "<u8") for h in pdf["hashes"]]
        return held, *_least(np.concatenate(held), np.repeat(pdf["key"].to_numpy(np.int64), [len(h) for h in held]))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        _, every, ids = own(pdf)
        rows, chunk = [], int(pdf["chunk"].iloc[0])
        for owner, place, offsets in owned(every, bits, owners):
            width = common.rice_width(span, len(offsets))
            rows.append((chunk, owner, len(offsets), width, common.rice_encode(offsets, width), _packed(ids[place])))
        return pd.DataFrame(rows, columns=["chunk", "owner", "n", "width", "blob", "ids"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [common.rice_decode(b, n, w) for b, n, w in zip(pdf["blob"], pdf["n"], pdf["width"])]
        every, smallest = _least(np.concatenate(lists), np.concatenate([_unpacked(b) for b in pdf["ids"]]))
        return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "ids": [_packed(smallest[np.searchsorted(every, x)]) for x in lists]})

    def claim(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["source", "uid", "key", "runs", "n_bytes"]
        if pdf.empty:
            return pd.DataFrame(columns=columns).astype({c: "int64" for c in columns if c != "runs"})
        held, every, _ = own(pdf)
        known = dict(zip(replies["owner"], replies["ids"]))
        smallest = np.concatenate([_unpacked(known[o]) for o, _, _ in owned(every, bits, owners)])
        rows = []
        for uid, key, lengths, n_bytes, hashes in zip(pdf["uid"], pdf["key"], pdf["lengths"], pdf["n_bytes"], held):
            source = smallest[np.searchsorted(every, hashes)]
            source = np.where(source < key, source, NO_ID)
            counts = np.frombuffer(lengths, "<i4").astype(np.int64) - size + 1
            stretch = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(hashes)) + stretch * size  # a stretch has size - 1 more words than windows, and one place follows
            new = np.r_[True, (source[1:] != source[:-1]) | (stretch[1:] != stretch[:-1])]
            starts = np.flatnonzero(new)
            ends, of = np.r_[starts[1:], len(source)] - 1, source[starts]
            runs = np.stack([place[starts], place[ends]], axis=1).astype("<i4")
            for s in np.unique(of[of < NO_ID]):
                rows.append((int(s), uid, key, runs[of == s].tobytes(), n_bytes))
        return pd.DataFrame(rows, columns=columns)

    sent = slim.groupBy("chunk").applyInPandas(send, "chunk long, owner int, n int, width int, blob binary, ids binary")
    answers = sent.groupBy("owner").applyInPandas(answer, "chunk long, owner int, ids binary")
    return slim.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        claim, "source long, uid long, key long, runs binary, n_bytes long")


class Automaton:
    """Phrases (tuples of word numbers) and, once the sources were streamed, the smallest source that holds each."""

    def __init__(self, phrases: set[tuple]):
        import ahocorasick
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.source: list[int] = []
        for phrase in phrases:
            self.machine.add_word(phrase, (len(self.source), len(phrase)))
            self.source.append(NO_ID)
        if phrases:
            self.machine.make_automaton()

    def confirm(self, key: int, numbers: tuple) -> None:
        if self.source:
            for _, (phrase, _) in self.machine.iter(numbers):
                if key < self.source[phrase]:
                    self.source[phrase] = key

    def locate(self, key: int, numbers: tuple, marks: np.ndarray) -> None:
        """Add to ``marks`` (one longer than the text) where confirmed phrases begin and end."""
        if self.source:
            for end, (phrase, length) in self.machine.iter(numbers):
                if self.source[phrase] < key:
                    marks[end - length + 1] += 1
                    marks[end + 1] -= 1


def phrases_of(numbers: tuple, runs: np.ndarray, size: int) -> Iterator[tuple]:
    """Phrases of at most PHRASE words that together hold every window of the runs."""
    for first, last in runs.tolist():
        past = last + size
        while True:
            yield numbers[first:min(past, first + PHRASE)]
            if first + PHRASE >= past:
                break
            first += PHRASE - size + 1


def search(claiming: pd.DataFrame, sources: pd.DataFrame, size: int) -> pd.DataFrame:
    """(uid, spans): the covered words of each claiming document of a shard, as first and one past the last."""
    numbers: dict[bytes, int] = {}

    def numbered(body: bytes) -> tuple:
        """Word numbers from 1, with a 0 between stretches."""
        out: list[int] = []
        for line in body.split(b"\n"):
            out += [numbers.setdefault(w, len(numbers) + 1) for w in line.split(b" ")]
            out.append(0)
        return tuple(out[:-1])

    docs: dict[int, tuple] = {}
    runs: list[tuple[int, np.ndarray]] = []
    for uid, key, body, starts, lengths, own in zip(*(claiming[c] for c in ("uid", "key", "body", "starts", "lengths", "runs"))):
        if uid not in docs:
            docs[uid] = key, numbered(body), np.frombuffer(starts, "<i4"), np.frombuffer(lengths, "<i4")
        runs.append((uid, np.frombuffer(own, "<i4").reshape(-1, 2)))
    known = [(key, numbered(body)) for key, body in zip(sources["source"], sources["body"])]
    long = Automaton({p for uid, own in runs for p in phrases_of(docs[uid][1], own, size)})
    for key, text in known:
        long.confirm(key, text)
    marks = {uid: np.zeros(len(doc[1]) + 1, np.int64) for uid, doc in docs.items()}
    for uid, doc in docs.items():
        long.locate(doc[0], doc[1], marks[uid])
    covered = {uid: np.cumsum(m[:-1]) > 0 for uid, m in marks.items()}

    def missed(uid: int, own: np.ndarray) -> Iterator[tuple]:
        text, cover = docs[uid][1], covered[uid]
        for first, last in own.tolist():
            if not cover[first:last + size].all():
                for at in range(first, last + 1):
                    if not cover[at:at + size].all():
                        yield text[at:at + size]

    short = Automaton({w for uid, own in runs for w in missed(uid, own)})
    for key, text in known:
        short.confirm(key, text)
    out = []
    for uid, (key, text, starts, lengths) in docs.items():
        short.locate(key, text, marks[uid])
        edges = np.flatnonzero(np.diff((np.cumsum(marks[uid][:-1]) > 0).astype(np.int8), prepend=0, append=0))
        if len(edges):
            offsets = np.cumsum(np.r_[0, lengths[:-1] + 1])  # where each stretch begins in ``text``
            first, past = edges[::2], edges[1::2]
            of = np.searchsorted(offsets, first, side="right") - 1
            move = starts[of] - offsets[of]
            out.append((uid, np.stack([first + move, past + move], axis=1).astype("<i4").tobytes()))
    return pd.DataFrame(out, columns=["uid", "spans"])


def dedup(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) per row.

    ``spans`` are the word ranges that go: words inside a window of ``size`` words that also starts in a document with
    a smaller id.  Null, empty and blank texts have no words; texts shorter than a window keep all.  Repeated rows with
    the same id take nothing from each other, a null id counts as larger than every other.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = common.texts_of(docs, id_col, text_col)
    texts = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = max(common.shuffle_partitions(spark), -(-total // chunk_bytes))
    owners = common.owners_for(spark, total // 6, 1 << 22)
    bits = min(60, max(20, int(np.log2(total + 1)) + 5))
    key = F.coalesce("doc_id", F.lit(int(NO_ID)))
    chunked = texts.select(F.pmod("uid", F.lit(chunks)).alias("chunk"), "uid", key.alias("key"), "text")
    stretches = common.staged(recurring(chunked, bits, owners, size), "substring-stretches")
    left = stretches.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    claimed = common.staged(claims(stretches, owners, size), "substring-claims")

    # a source's claims go to one shard, or over several where they are many
    shards = max(common.shuffle_partitions(spark), -(-left // shard_bytes))
    sums = claimed.groupBy("source").agg(F.sum("n_bytes").alias("bytes"))
    salts = F.ceil(F.col("bytes") / shard_bytes).cast("long")
    placed = claimed.join(sums, "source").select(
        "source", "uid", "runs", F.when(salts > 1, F.xxhash64("source", F.pmod(F.xxhash64("uid"), salts))).otherwise(
            F.pmod(F.xxhash64("source"), F.lit(shards))).alias("shard"))
    placed = common.staged(placed, "substring-placed")
    bodies = stretches.select("uid", "key", "starts", "lengths", "body").dropDuplicates(["uid"])  # repeated rows are alike
    claiming = placed.distinct().join(bodies, "uid").select("shard", "uid", "key", "runs", "starts", "lengths", "body")
    # every text under the source's id may hold the passage
    wanted = placed.select("shard", "source").distinct()
    sources = wanted.join(stretches.select(F.col("key").alias("source"), "body"), "source").select(
        F.col("shard").alias("at"), "source", F.col("body").alias("body"))

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return search(one, two, size)

    spans = claiming.groupBy("shard").cogroup(sources.groupBy("at")).applyInPandas(run, "uid long, spans binary")
    spans = common.staged(spans.groupBy("uid").agg(F.collect_list("spans").alias("spans")), "substring-spans")  # one for each shard

    def make():
        def cut(rows: list[dict]) -> tuple[None, list]:
            n_words, n_removed, sha, kept_spans = [], [], [], []
            for row in rows:
                words = row["text"].encode("utf-8", "replace").split()
                n_words.append(len(words))
                ranges: list[list[int]] = []
                for first, past in sorted(x for blob in row["spans"] or () for x in np.frombuffer(blob, "<i4").reshape(-1, 2).tolist()):
                    if ranges and first <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], past)
                    else:
                        ranges.append([first, past])
                for first, past in reversed(ranges):
                    del words[first:past]
                n_removed.append(n_words[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                kept_spans.append(";".join(f"{a}-{b}" for a, b in ranges))
            return None, [n_words, n_removed, sha, kept_spans]
        return cut

    found = texts.join(spans.select(F.col("uid").alias("of"), "spans"), F.col("uid") == F.col("of"), "left")
    found = found.select("doc_id", F.struct("text", "spans").alias("row"))
    out = common.map_column(found, "row", "n_words long, n_removed long, kept_sha256 string, cut string", make)
    ranges = F.filter(F.split("cut", ";"), lambda x: x != "")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.transform(ranges, lambda x: F.struct(
        F.split(x, "-")[0].cast("int").alias("first"), F.split(x, "-")[1].cast("int").alias("past"))).alias("spans"))
