"""Hash-chained audit log: numbering, appending, verifying and searching.

A single linear chain cannot be written in parallel, because each hash needs the one before it.  The
records of one append form a segment: they are chained in blocks of a fixed number, each block's last
hash becomes a record of the next level, chained the same way, up to one root.  A head row states the
segment's first sequence, count and root, and is linked to the head before it.  Verification checks
every hash and link, that numbers are dense, that each block's last hash is what the next level holds
and that counts and roots are what the heads say; with the last head known from elsewhere it also
notices a log that was cut at the end.  ``block=None`` covers a plain linear chain written elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide import fixed
from watchtide.operators.running import running
from watchtide.session import cut_lineage

BLOCK = 64
FIELDS = ["action", "actor", "actor_type", "details", "evidence_refs", "prompt_hash", "resource_id", "resource_type",
          "tenant_id", "timestamp"]


def number_records(df: DataFrame, key: str, start: int = 0, name: str = "sequence") -> DataFrame:
    """Dense numbers after ``start`` in order of a unique column of any orderable type, dense, sparse or hashed."""
    return running(df, [], [F.col(key)], number=name).withColumn(name, F.lit(start) + F.col(name))


def canonical_record(columns: list[str]) -> Column:
    """Record content as JSON with sorted keys; nulls are spelled out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def record_hash(content: Column, sequence: Column, prev_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", sequence.cast("string"), prev_hash, content), 256)


def _chain(rows: DataFrame, block: int, last: int = 0) -> DataFrame:
    """Rows (level, sequence, content) chained inside blocks of ``block`` consecutive numbers after ``last``."""
    grouped = rows.groupBy("level", F.floor((F.col("sequence") - 1 - last) / block).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("sequence", "content"))).alias("r"))  # at most `block` records
    empty = F.array().cast("array<struct<sequence:bigint,content:string,prev_hash:string,record_hash:string>>")

    def step(acc: Column, r: Column) -> Column:
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1))["record_hash"], F.lit(fixed.GENESIS_HASH))
        return F.array_append(acc, F.struct(
            r["sequence"].alias("sequence"), r["content"].alias("content"), prev.alias("prev_hash"),
            record_hash(r["content"], r["sequence"], prev).alias("record_hash")))

    return grouped.select("level", "block", F.inline(F.aggregate("r", empty, step)))


HEAD = -1  # level of the head rows


def head_content(first: Column, count: Column, root: Column) -> Column:
    return F.concat_ws("|", first.cast("string"), count.cast("string"), root)


def last_head(chain: DataFrame) -> tuple[int, int, str]:
    """(number of the last segment, last sequence, last head hash) of a chain, to continue it or to pin it."""
    row = chain.where(F.col("level") == HEAD).orderBy(F.col("segment").desc()).select("segment", "content", "record_hash").first()
    if row is None:
        return 0, 0, fixed.GENESIS_HASH
    first, count, _ = row["content"].split("|")
    return row["segment"], int(first) + int(count) - 1, row["record_hash"]


def append_events(events: DataFrame, block: int = BLOCK, after: tuple[int, int, str] = (0, 0, fixed.GENESIS_HASH)) -> DataFrame:
    """Chained rows (segment, level, block, sequence, content, prev_hash, record_hash) of a new segment.

    ``events``: sequence and content, numbered densely after ``after``, the :func:`last_head` of the log so far.
    Level 0 holds the records, level n + 1 the last hash of every level-n block, up to the level with one record;
    the head row ties the segment to the one before.
    """
    segment, last, head = after
    base = events.select(F.col("sequence").cast("long").alias("sequence"), "content")
    count = base.count()
    if not count:
        return _chain(base.select(F.lit(0).alias("level"), "sequence", "content"), block).select(
            F.lit(segment).cast("int").alias("segment"), "*").where("false")
    # inside the segment numbers start at 1; the record hashes use the numbers of the whole log
    level = cut_lineage(_chain(base.select(F.lit(0).alias("level"), "sequence", "content"), block, last))  # read by the next level and the result
    out, left, n = level, count, 0
    while left > 1 or n == 0:
        n, left = n + 1, -(-left // block)
        tails = level.groupBy("block").agg(F.max_by("record_hash", "sequence").alias("content")).select(
            F.lit(n).alias("level"), (F.col("block") + 1).alias("sequence"), "content")
        level = _chain(tails, block)
        out = out.unionByName(level)
    top = level.agg(F.max("record_hash").alias("root")).select(
        F.lit(HEAD).alias("level"), F.lit(0).cast("long").alias("block"), F.lit(segment + 1).cast("long").alias("sequence"),
        head_content(F.lit(last + 1), F.lit(count), F.col("root")).alias("content"), F.lit(head).alias("prev_hash"))
    top = top.withColumn("record_hash", record_hash(F.col("content"), F.col("sequence"), F.col("prev_hash")))
    return out.unionByName(top).select(F.lit(segment + 1).cast("int").alias("segment"), "*")


def broken_records(chain: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """(level, sequence, problem, at) of records whose hash, link, number, block or segment is not what it should be.

    Every record is checked on its own: its hash is recomputed, its previous hash is compared with record
    ``sequence - 1``, found by an equi-join, the last record of a block with its record one level up, and the
    segment with its head.  A block that is missing altogether is reported at its first number.  ``at`` is the
    first record of the log that the row stands for.
    """
    if block is None or "level" not in chain.columns:
        return _broken_linear(chain)
    heads = chain.where(F.col("level") == HEAD).select(
        F.col("segment").alias("head_segment"), F.col("sequence").alias("number"), "content", "prev_hash", "record_hash",
        *(F.split("content", "[|]")[i].alias(c) for i, c in enumerate(("first", "count", "root"))))
    heads = heads.withColumn("first", F.col("first").cast("long")).withColumn("count", F.col("count").cast("long"))
    # one row per append; broadcast, because joined by key all records of a segment would meet in one task
    known = F.broadcast(heads.select("head_segment", "first"))
    rows = chain.where(F.col("level") >= 0).join(known, F.col("segment") == F.col("head_segment"), "left").drop("head_segment")
    # place inside the segment and level: 0, 1, 2, ...
    rows = rows.withColumn("place", F.col("sequence") - F.when(F.col("level") == 0, F.coalesce("first", F.lit(1))).otherwise(F.lit(1)))
    key = ["segment", "level", "place"]
    before = rows.select("segment", "level", (F.col("place") + 1).alias("place"), F.col("record_hash").alias("expected")).dropDuplicates(key)
    times = rows.groupBy(*key).agg(F.count("*").alias("times"))
    checked = rows.join(before, key, "left").join(times, key)
    opens = F.pmod("place", F.lit(block)) == 0
    lone = (F.col("place") > 0) & F.col("expected").isNull()
    bad_link = lone | ~F.coalesce(F.col("prev_hash") == F.when(opens, F.lit(fixed.GENESIS_HASH)).otherwise(F.col("expected")), F.lit(False))
    bad_hash = ~F.coalesce(F.col("record_hash") == record_hash(F.col("content"), F.col("sequence"), F.col("prev_hash")), F.lit(False))
    below = F.coalesce("first", F.lit(1)) + F.col("place") * F.pow(F.lit(block), F.col("level")).cast("long")
    own = checked.withColumn("at", below).select("level", "sequence", "at", F.when((F.col("times") > 1) | (F.col("place") < 0), F.lit("sequence not dense")).when(
        bad_link, F.lit("prev_hash mismatch")).when(bad_hash, F.lit("record_hash mismatch")).alias("problem"))

    # last hash of each block against its record one level up, both ways
    tails = rows.groupBy("segment", "level", F.floor(F.col("place") / block).cast("long").alias("up")).agg(
        F.max_by("record_hash", "place").alias("tail"), F.max("sequence").alias("at"))
    ups = rows.where("level > 0").select("segment", (F.col("level") - 1).alias("level"), F.col("place").alias("up"), F.col("content").alias("said"))
    tops = rows.groupBy("segment").agg(F.max("level").alias("top"))
    ties = tails.join(ups, ["segment", "level", "up"], "full").join(F.broadcast(tops), "segment").join(known, F.col("segment") == F.col("head_segment"), "left")
    start = F.col("up") * block + F.when(F.col("level") == 0, F.coalesce("first", F.lit(1))).otherwise(F.lit(1))
    under = F.coalesce("first", F.lit(1)) + F.col("up") * F.pow(F.lit(block), F.col("level") + 1).cast("long")
    ties = ties.where("level < top").select("level", F.coalesce("at", start).alias("sequence"), F.when(
        F.col("level") == 0, F.coalesce("at", start)).otherwise(under).alias("at"), F.when(F.col("tail").isNull(), F.lit("block missing")).when(
        F.col("said").isNull() | (F.col("said") != F.col("tail")), F.lit("block hash mismatch")).alias("problem"))

    # heads: hash, link to the head before, numbers, counts and roots of their segments
    sizes = rows.where("level = 0").groupBy("segment").agg(F.count("*").alias("have"))
    roots = rows.join(F.broadcast(tops.withColumnRenamed("segment", "of")), (F.col("segment") == F.col("of")) & (F.col("level") == F.col("top"))).groupBy("segment").agg(
        F.max("record_hash").alias("have_root"))
    facts = tops.join(sizes, "segment", "left").join(roots, "segment", "left")
    order = Window.orderBy("number")  # one row per append
    heads = heads.withColumn("want_prev", F.lag("record_hash", 1, fixed.GENESIS_HASH).over(order)).withColumn(
        "want_first", F.lag(F.col("first") + F.col("count"), 1, 1).over(order)).withColumn("want_number", F.row_number().over(order))
    heads = heads.join(facts, F.col("head_segment") == F.col("segment"), "full")
    told = F.when(F.col("number").isNull(), F.lit("head missing")).when(
        (F.col("number") != F.col("want_number")) | (F.col("first") != F.col("want_first")), F.lit("sequence not dense")).when(
        F.col("prev_hash") != F.col("want_prev"), F.lit("prev_hash mismatch")).when(
        F.col("record_hash") != record_hash(F.col("content"), F.col("number"), F.col("prev_hash")), F.lit("record_hash mismatch")).when(
        ~F.coalesce(F.col("have") == F.col("count"), F.lit(False)), F.lit("record count mismatch")).when(
        ~F.coalesce(F.col("have_root") == F.col("root"), F.lit(False)), F.lit("root mismatch"))
    heads = heads.select(F.lit(HEAD).alias("level"), F.coalesce("number", "segment").cast("long").alias("sequence"),
                         F.coalesce("first", F.lit(1)).alias("at"), told.alias("problem"))
    return own.unionByName(ties).unionByName(heads).where("problem IS NOT NULL").select("level", "sequence", "problem", "at").distinct()


def _broken_linear(chain: DataFrame) -> DataFrame:
    before = chain.select((F.col("sequence") + 1).alias("sequence"), F.col("record_hash").alias("expected"))
    rows = chain.join(before, "sequence", "left")
    expected = F.when(F.col("sequence") == 1, F.lit(fixed.GENESIS_HASH)).otherwise(F.col("expected"))
    bad_link = ~F.coalesce(F.col("prev_hash") == expected, F.lit(False))
    bad_hash = F.col("record_hash") != record_hash(F.col("content"), F.col("sequence"), F.col("prev_hash"))
    return rows.select(F.lit(0).alias("level"), "sequence", F.when(bad_link, F.lit("prev_hash mismatch")).when(
        bad_hash, F.lit("record_hash mismatch")).alias("problem"), F.col("sequence").alias("at")).where("problem IS NOT NULL")


def verify(chain: DataFrame, block: int | None = BLOCK, pinned: tuple[int, int, str] | None = None) -> DataFrame:
    """One row: valid, records checked before the first break, first broken sequence, detail.

    A break above level 0 counts at the first record below it.  ``pinned`` is the :func:`last_head` that somebody
    kept elsewhere: a log that does not reach it was cut.
    """
    levels = block is not None and "level" in chain.columns
    bad = broken_records(chain, block).select("at", "level", "problem")
    if levels and pinned:
        segment, last, head = pinned
        reached = chain.where(F.col("level") == HEAD).agg(F.count_if((F.col("sequence") == segment) & (F.col("record_hash") == head)).alias("n"))
        bad = bad.unionByName(reached.where("n = 0").select(F.lit(last).cast("long").alias("at"), F.lit(HEAD).alias("level"), F.lit("log cut").alias("problem")))
    # what records and blocks show comes first; a head only says that something is wrong with its segment
    first = bad.agg(F.min(F.struct((F.col("level") < 0).alias("head"), "at", "level", "problem")).alias("f"))
    rows = (chain.where("level = 0") if levels else chain).select("sequence")
    found = first.select(F.to_json("f")).scalar()
    f = F.from_json(found, "head boolean, at long, level int, problem string")
    checked = rows.agg(F.count_if(F.col("sequence") < F.coalesce(f["at"], F.lit(2 ** 62))).alias("events_checked"))
    return checked.select(
        f["at"].isNull().alias("valid"), "events_checked", f["at"].alias("first_broken_sequence"),
        F.coalesce(F.concat(f["problem"], F.lit(" at sequence="), f["at"].cast("string")), F.lit("chain intact")).alias("detail"))


def query_events(log: DataFrame, since=None, until=None, limit: int = 100, **equals: str) -> DataFrame:
    """Equality and time-range filters, newest first."""
    out = log
    for name, value in equals.items():
        if value:
            out = out.where(F.col(name) == value)
    if since is not None:
        out = out.where(F.col("timestamp") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("timestamp") <= F.lit(until))
    return out.orderBy(F.col("sequence").desc()).limit(limit)


def search_log(log: DataFrame, q: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Substring search over the whole row, newest first, with the total before paging."""
    found = log.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(q.lower())))
    total = found.agg(F.count("*").alias("total")).scalar()
    return found.orderBy(F.col("sequence").desc()).offset(offset).limit(limit).withColumn("total", total)
