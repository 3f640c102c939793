"""Small helpers shared by the corpus operators: column choice, numbering, staging and bit packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchtide.session import checkpoint_root

CHUNK_BITS = 16  # rows that share one chunk id: 2 ** CHUNK_BITS at most


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; every other column, whatever its name, is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark, name: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def owners_for(spark, rows: int, per_owner: int) -> int:
    """Number of owner tasks: grows with the rows so that one owner never holds more than about ``per_owner``."""
    return int(max(shuffle_partitions(spark), -(-rows // per_owner), 1))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"),
                              F.lit("")).cast("binary")) % 4 == 2


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.r_[starts, len(values)])


# Golomb coding of sorted integers, with a power of two as divisor: quotients in unary, remainders in fixed width.

def rice_width(span: int, n: int) -> int:
    """Bits of the remainder for ``n`` values spread over ``span``."""
    return max(0, int(np.log2(max(1.0, span / max(1, n)))))


def rice_encode(values: np.ndarray, width: int) -> bytes:
    """Sorted uint64 values as the unary stream's length, the unary stream and the remainder stream."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary)
    rest = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width:]
    return np.array([len(head)], "<u4").tobytes() + head.tobytes() + np.packbits(rest).tobytes()


def rice_decode(blob: bytes, n: int, width: int) -> np.ndarray:
    size = int(np.frombuffer(blob, "<u4", 1)[0])
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 4)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(width)
    if width:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + size))[: n * width].reshape(n, width)
        full = np.zeros((n, 64), np.uint8)
        full[:, 64 - width:] = bits
        gaps |= np.packbits(full, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def map_column(df: DataFrame, column: str, added: str, make: Callable[[], Callable[[list], tuple[Sequence[int] | None, list[Sequence]]]],
               rows: int = 500) -> DataFrame:
    """``df`` without ``column`` and with the columns ``added``, by a function over lists of its values.

    ``make`` runs once in each task; its function returns, for a list of values, the place in the list that each result
    row comes from (None: one row for each value) and the added columns.  All other columns pass through untouched.
    """
    kept = [c for c in df.columns if c != column]
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    names, kinds = zip(*((x.split()[0], arrow[x.split()[1]]) for x in added.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                places, columns = apply(part.column(column).to_pylist())
                same = [part.column(c) if places is None else part.column(c).take(pa.array(places, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*kept, *names])

    kept_schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != column)
    return df.mapInArrow(run, kept_schema + added)
