"""Token ids of documents in files of compressed byte or bit planes.

Ids run in ascending doc_id order, each document closed by an end id.  A file holds the ids of a range of documents:
blocks of a fixed number of ids, each transposed into planes that are compressed one by one with zstandard, then a
chunk index (blocks and documents) and its length.  Every part ends with a mark, which lets Spark's own writer and
reader carry the files to and from any store it knows.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchtide.llm import common
from watchtide.operators.running import running
from watchtide.session import cut_lineage

MARK = "\x1eTPL1"
BLOCK_IDS = 1 << 16
FILE_BYTES = 24 << 20  # text behind one file, about
LEVEL = 3
KNOWN_WORDS = 900_000  # pieces and words in a generation of those whose ids a worker remembers
KNOWN_LETTERS = 64  # longest of them
_DOUBLE = re.compile(r"\s\s")

#: The split pattern for texts of printable ASCII, letters of Latin-1, spaces and line ends, and the bytes of these.
_PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[!-/:-@\[-`{-~]+|[ \n]+(?![^ \n])|[ \n]+")
_PLAIN = bytes([0x0A, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memory(dict):
    """Ids by word, computed on first sight; short words of the last two generations are remembered."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > KNOWN_LETTERS:
            return self.compute(word)
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        self[word] = found = self.compute(word) if found is None else found
        return found


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


class Encoder:
    """Ids of whole texts with the tokenizers library.

    A text of printable ASCII, Latin-1 letters, spaces and line ends is cut as the split pattern cuts it, and each distinct
    piece goes to the library's model once.  For other texts: the pattern never goes from a visible character on into
    white space.  Where there are no two white space characters in a row, lines and words with the space before them
    therefore have the same ids alone as in the text, and each distinct word is encoded once.  What is left is encoded
    in one piece, as are texts that hold one of the library's added tokens.
    """

    letters = _byte_letters()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.known = Memory(self._word)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one piece or word, with the space before it, as they are alone."""
        if not _plain(word):
            return self._whole([word])[0]
        if len(pieces := _PIECES.findall(word)) > 1:
            return b"".join(map(self.known.__getitem__, pieces))
        written = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, out = self.known.__getitem__, []
        for text in texts:
            if any(token in text for token in self.added):
                out += self._whole([text])
            elif _plain(text):
                out.append(b"".join(map(known, _PIECES.findall(text))))
            elif _DOUBLE.search(text):
                out += self._whole([text])
            else:
                lines = []
                for line in text.split("\n"):
                    head, *rest = line.split(" ")
                    lines.append(known(head) + b"".join([known(" " + word) for word in rest]))
                out.append(known("\n").join(lines))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray, planes: str) -> bytes:
    """One block: kind, number of planes, number of ids, plane lengths, compressed planes (lowest first)."""
    import zstandard
    tool = zstandard.ZstdCompressor(level=LEVEL)
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        parts = [tool.compress(np.packbits(bits[:, i]).tobytes()) for i in range(max(1, top.bit_length()))]
    else:
        parts = [tool.compress(raw[:, i].tobytes()) for i in range(max(1, -(-top.bit_length() // 8)))]
    return struct.pack("<cBI", planes[:1].encode().replace(b"b", b"b" if planes == "bit" else b"y"), len(parts), len(ids)) + struct.pack(
        f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unpack(block: bytes) -> np.ndarray:
    import zstandard
    tool = zstandard.ZstdDecompressor()
    kind, count, n = struct.unpack_from("<cBI", block)
    sizes, at, parts = struct.unpack_from(f"<{count}I", block, 6), 6 + 4 * count, []
    for size in sizes:
        parts.append(np.frombuffer(tool.decompress(block[at:at + size]), np.uint8))
        at += size
    if kind == b"b":
        bits = np.zeros((n, 32), np.uint8)
        for i, part in enumerate(parts):
            bits[:, i] = np.unpackbits(part)[:n]
        raw = np.packbits(bits, axis=1, bitorder="little")
    else:
        raw = np.zeros((n, 4), np.uint8)
        for i, part in enumerate(parts):
            raw[:, i] = part
    return raw.view("<u4").reshape(-1)


def index_of(blocks: list[tuple[int, int]], docs: list[tuple[int | None, int]]) -> bytes:
    """Blocks as (length in bytes, ids), documents as (id, whether it is null, ids)."""
    return (struct.pack("<II", len(blocks), len(docs)) + np.array(blocks, "<u4").tobytes()
            + np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], np.uint8).tobytes()
            + np.array([n for _, n in docs], "<u4").tobytes())


def read_index(blob: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    n_blocks, n_docs = struct.unpack_from("<II", blob)
    at = 8 + 8 * n_blocks
    blocks = np.frombuffer(blob, "<u4", 2 * n_blocks, 8).reshape(-1, 2)
    ids, null = np.frombuffer(blob, "<i8", n_docs, at), np.frombuffer(blob, np.uint8, n_docs, at + 8 * n_docs)
    return blocks, [None if x else int(i) for i, x in zip(ids, null)], np.frombuffer(blob, "<u4", n_docs, at + 9 * n_docs)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, planes: str = "byte", block_ids: int = BLOCK_IDS,
          id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every text, a null one as the empty one, below ``path``.  Rows with equal ids stay together."""
    texts = common.texts_of(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    files = max(common.shuffle_partitions(docs.sparkSession), -(-size // file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        waiting, held, blocks, listed = [], 0, [], []

        def out(blob: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["part"])

        def flush(ids: bytes) -> pa.RecordBatch:
            blob = pack(np.frombuffer(ids, "<u4"), planes)
            blocks.append((len(blob), len(ids) // 4))
            return out(blob)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    listed.append((doc, len(ids) // 4 + 1))
                    waiting += [ids, end]
                    held += len(ids) + 4
                if held >= 4 * block_ids:
                    joined = b"".join(waiting)
                    cut = held - held % (4 * block_ids)
                    for a in range(0, cut, 4 * block_ids):
                        yield flush(joined[a:a + 4 * block_ids])
                    waiting, held = [joined[cut:]], held - cut
        if held:
            yield flush(b"".join(waiting))
        if listed:
            index = index_of(blocks, listed)
            yield out(index + struct.pack("<I", len(index)))

    parts = texts.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "part binary")
    parts.select(F.col("part").cast("string")).write.option("lineSep", MARK).text(path)


def read(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files below ``path``; ids: little-endian unsigned 32-bit integers.

    ``columns`` come in place of ``ids`` and are worked out from them where the files are read, so the ids stay there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = len(MARK.encode())
        for batch in batches:
            for content in batch.column(0):
                blob = content.as_py()
                if not blob:
                    continue
                tail = len(blob) - mark
                size = struct.unpack_from("<I", blob, tail - 4)[0]
                blocks, docs, counts = read_index(blob[tail - 4 - size:tail - 4])
                at, ids, have, done, starts = 0, [], 0, 0, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                first = docs[0]
                for length, n in blocks.tolist():
                    ids.append(unpack(blob[at:at + length]))
                    at, have = at + length + mark, have + n
                    ready = int(np.searchsorted(starts, have, side="right")) - 1  # documents that are complete
                    if ready > done:
                        flat = np.concatenate(ids)
                        base = int(starts[done])
                        rows = [flat[int(a) - base:int(b) - base].tobytes() for a, b in zip(starts[done:ready], starts[done + 1:ready + 1])]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([first] * len(rows), pa.int64()), pa.array(docs[done:ready], pa.int64()),
                            pa.array(starts[done:ready]), pa.array(counts[done:ready].astype(np.int64)), pa.array(rows, pa.binary())],
                            names=["first", "doc_id", "place", "n_tokens", "ids"])
                        ids, done = [flat[int(starts[ready]) - base:]], ready

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = len(MARK.encode())
        for batch in batches:
            firsts, sizes = [], []
            for content in batch.column(0):
                blob = content.as_py()
                if blob:
                    tail = len(blob) - mark
                    _, docs, counts = read_index(blob[tail - 4 - struct.unpack_from("<I", blob, tail - 4)[0]:tail - 4])
                    firsts.append(docs[0])
                    sizes.append(int(counts.sum(dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64())], names=["of", "size"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInArrow(run, "first long, doc_id long, place long, n_tokens long, ids binary").select(
        "first", "doc_id", "place", "n_tokens", *(columns or ["ids"]))
    # ids of all files before: one row for each file, from the indexes alone
    sizes = cut_lineage(files.mapInArrow(count, "of long, size long"))
    bases = running(sizes, [], [F.col("of").asc_nulls_first()], {"upto": F.col("size")}).select("of", (F.col("upto") - F.col("size")).alias("base"))
    return rows.join(bases, F.col("first").eqNullSafe(F.col("of"))).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", *rows.columns[4:])
