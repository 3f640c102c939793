"""Vector code compression: every part of a vector becomes the index of its nearest codebook entry.

Vectors are turned to integers once and kept in blocks with a dictionary of values for each dimension.  For a block and a
codebook, the squared differences of every distinct value to all entries are tabulated; the distances of a part are then
gathers of table rows by the dictionary codes, and adds.  A round of refinement returns sums and counts for each entry,
so only the codebooks (vector length times entries) ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from watchtide.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELLS = 1 << 19  # components in one block


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector of doubles) of the rows whose vector has finite components only."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x * SCALE) < float("inf"), F.lit(False)))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))


def blocks_of(rows: DataFrame, length: int) -> DataFrame:
    """Blocks of integer vectors: ids, labels, the size of each dimension's dictionary, its values and the codes."""
    kind = rows.schema["label"].dataType.simpleString()
    at_once = max(1, CELLS // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                n = part.num_rows
                whole = np.floor(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, length) * SCALE) + 0.0
                found = [np.unique(whole[:, d], return_inverse=True) for d in range(length)]
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([
                    *lists, pa.array([np.array([len(v) for v, _ in found], "<i4").tobytes()], pa.binary()),
                    pa.array([b"".join(v.astype("<f8").tobytes() for v, _ in found)], pa.binary()),
                    pa.array([b"".join(c.astype("<i4").tobytes() for _, c in found)], pa.binary())],
                    names=["ids", "labels", "sizes", "values", "codes"])

    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, sizes binary, values binary, codes binary")


def _dictionaries(sizes: bytes, values: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    counts = np.frombuffer(sizes, "<i4")
    return np.split(np.frombuffer(values, "<f8"), np.cumsum(counts)[:-1]), np.frombuffer(codes, "<i4").reshape(len(counts), -1)


def nearest(dictionaries: list[np.ndarray], codes: np.ndarray, books: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each part, the index of the nearest entry and the squared distance to it; of equal ones the lower index."""
    width = len(books[0][0])
    picked, errors = [], []
    for p, book in enumerate(books):
        mine = dictionaries[p * width:(p + 1) * width]
        reach = max([abs(e) for entry in book for e in entry] + [int(np.abs(v).max()) for v in mine])
        largest = 4 * reach * reach * width  # no distance is larger; beyond 64 bits Python's own integers are used
        kind = np.int32 if largest < 1 << 31 else np.int64 if largest < 1 << 63 else object
        entries = np.array(book, dtype=kind)
        total = 0
        for j, values in enumerate(mine):
            whole = values.astype(kind) if kind is not object else np.array([int(x) for x in values], object)
            table = (whole[:, None] - entries[None, :, j]) ** 2
            total = total + table[codes[p * width + j]]
        best = total.argmin(axis=1)
        picked.append(best)
        errors.append(total[np.arange(len(best)), best])
    return np.array(picked), errors


def _refined(blocks: DataFrame, books: list) -> list:
    """Each entry replaced by the mean, rounded down, of the parts it is nearest to; unused entries stay."""
    width = len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for row in batch.select(["sizes", "values", "codes"]).to_pylist():
                dictionaries, codes = _dictionaries(**row)
                picked, _ = nearest(dictionaries, codes, books)
                for p in range(len(books)):
                    counts = np.bincount(picked[p], minlength=len(books[p]))
                    for j in range(width):
                        d = p * width + j
                        # how often each value meets each entry: sums stay exact whatever the values are
                        cells, times = np.unique(picked[p] * len(dictionaries[d]) + codes[d], return_counts=True)
                        for cell, n in zip(cells.tolist(), times.tolist()):
                            e, v = divmod(cell, len(dictionaries[d]))
                            sums[p, e, j] = sums.get((p, e, j), 0) + n * int(dictionaries[d][v])
                    for e in np.flatnonzero(counts).tolist():
                        sums[p, e, -1] = sums.get((p, e, -1), 0) + int(counts[e])
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)),
                                          pa.array([str(sums[k]) for k in keys], pa.string())], names=["part", "entry", "place", "total"])

    found = blocks.mapInArrow(run, "part int, entry int, place int, total string").groupBy("part", "entry", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {(r.part, r.entry, r.place): int(r.total) for r in found.collect()}
    return [[[totals[p, e, j] // totals[p, e, -1] for j in range(width)] if (p, e, -1) in totals else entry
             for e, entry in enumerate(book)] for p, book in enumerate(books)]


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
           vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    Dropped are null vectors, those with null, NaN or infinite components (also such as become infinite when scaled), and
    those whose length is not that of the usable vector with the smallest id among lengths that the parts divide.
    Null ids come after all others, equal ids are ordered by their vectors; repeated rows are all coded.  Null labels are
    one group.  Codebooks have fewer entries where fewer vectors are there; an empty table gives no row.  Errors and
    sums of errors beyond 64 bits are null.  ``entries`` is at most 256, since a code has two hex digits for each part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    rows = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = [r.vector for r in rows.orderBy(*by_id).limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, code string, "
                                         "error bigint, label_error bigint, codebooks_sha256 string")
    length = len(first[0])
    rows = rows.where(F.size("vector") == length)
    if any(len(v) != length for v in first):
        first = [r.vector for r in rows.orderBy(*by_id).limit(entries).collect()]
    width = length // parts
    start = [[int(np.floor(x * SCALE)) for x in v] for v in first]
    books = [[v[p * width:(p + 1) * width] for v in start] for p in range(parts)]
    blocks = common.staged(blocks_of(rows, length), "vector-blocks")
    for _ in range(rounds):
        books = _refined(blocks, books)
    kind = rows.schema["label"].dataType.simpleString()
    final = books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                picked, errors = nearest(*_dictionaries(*(one.column(c)[0].as_py() for c in ("sizes", "values", "codes"))), final)
                total = sum(e.astype(object) for e in errors)
                codes = np.ascontiguousarray(picked.T.astype(np.uint8))
                yield pa.RecordBatch.from_arrays([
                    one.column("ids").flatten(), one.column("labels").flatten(), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    pa.array([e if e < 1 << 63 else None for e in total.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = common.staged(blocks.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint"), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.expr(
        "if(count(error) = count(*), try_cast(sum(cast(error AS decimal(38,0))) AS bigint), NULL)").alias("label_error"))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn(
        "codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest()))
