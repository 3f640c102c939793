"""Byte-level BPE with the tiktoken library: ids of whole texts, and the raw bytes back from ids.

The ranks come from a local file.  Long texts are cut at safe boundaries, places the split pattern never spans, so
that the library gets pieces of bounded size and the ids stay those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Between a visible character and one space that a visible character follows: every alternative of the pattern that
#: can match the space begins there, and none that matches the character goes on into white space.
SAFE = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The library's encoder, built once in each Python worker."""
    import tiktoken
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that end at safe boundaries; without one, a piece goes on."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _encoder(rank_path: str, pattern: str, piece_chars: int, names: list[str]):
    """A task's function from batches with ``_text`` to the columns ``names``, the last of which are the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = []
                for text in part.column("_text").to_pylist():
                    ids: list[int] = []
                    for piece in pieces(text, piece_chars):
                        ids += enc.encode_ordinary(piece)
                    lists.append(np.array(ids, np.int32))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names[:-1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))], names=names)

    return run


def _decoder(rank_path: str, pattern: str, names: list[str]):
    """A task's function from batches with the columns ``names`` to the same with ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("ids")
                flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
                raw = [enc.decode_bytes(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(raw, pa.binary())], names=[*names, "decoded"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    """The id, the columns ``keep`` and ``_text``; the names and the schema of what encoding makes of them."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    names = ["doc_id", *keep, "ids"]
    return texts, names, "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in names[:-1]) + "ids array<int>"


def encode(docs: DataFrame, rank_path: str, pattern: str, piece_chars: int = 1 << 15, id_col: str = "doc_id",
           text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids array<int>, and the columns ``keep``) per row.

    A null or empty text has no ids; special tokens are ordinary text; an empty table gives an empty result.
    """
    texts, names, schema = _texts(docs, id_col, text_col, keep)
    return texts.mapInArrow(_encoder(rank_path, pattern, piece_chars, names), schema)


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``encoded``, which has ``ids``, with ``decoded``: the raw bytes of the ids, which need not be valid UTF-8."""
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoder(rank_path, pattern, encoded.columns), kept + "decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, piece_chars: int = 1 << 15, id_col: str = "doc_id",
               text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``decode`` of ``encode`` in one Python worker for each task; as two steps of a stage they would hold two.

    Spark keeps its Python workers, so the second ones would also lie beside all later stages, with all they remember.
    """
    texts, names, schema = _texts(docs, id_col, text_col, keep)
    encoder, decoder = _encoder(rank_path, pattern, piece_chars, names), _decoder(rank_path, pattern, names)
    return texts.mapInArrow(lambda batches: decoder(encoder(batches)), f"{schema}, decoded binary")
