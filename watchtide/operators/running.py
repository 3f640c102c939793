"""Numbers, running sums and as-of joins over sorted rows, without one task that sees a whole group.

Rows are dealt out by measured quantiles of (group, order), so a slice is of a bounded size however the keys are
distributed, and a hot group spreads over many slices.  Each slice is summed once; only these totals, one row for each
slice and group, are added up in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.session import cut_lineage, stored


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, Column] | None = None,
            number: str | None = None) -> DataFrame:
    """``df`` with the running sums of each group up to and including the row, in the given order.

    ``number`` names a dense 1-based number of the row in its group; ``sums`` maps new names to summed columns, nulls
    counting as 0.  ``order`` should end with something unique: rows that tie are put in any order, and stay in one
    slice.  The quantiles are drawn once, because the rows are stored with the slice they fell in.  Only a group that began
    in an earlier slice carries sums on, and a slice begins inside one group at most, so what is carried is a small table.
    """
    sums = {name: F.coalesce(c, F.lit(0)) for name, c in (sums or {}).items()}
    kept = df.columns
    sliced = stored(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_slice", F.spark_partition_id()), "slices")
    summed = [c.alias(f"_v{i}") for i, c in enumerate(sums.values())]  # worked out after each exchange, not sent
    values = [f"_v{i}" for i in range(len(sums))]
    totals = sliced.select("_slice", *group, *summed).groupBy("_slice", *group).agg(F.count("*").alias("_n"), *[F.sum(v).alias(v) for v in values])
    upto = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(totals.select(F.col("_slice").alias("_s"), *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)],
                                   F.sum("_n").over(upto).alias("_before"), *[F.sum(v).over(upto).alias(f"{v}c") for v in values]).where("_before > 0"), "carried")
    inside = Window.partitionBy("_slice", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.repartition("_slice", *group).select("*", *summed)
    out = out.select("*", F.count(F.lit(1)).over(inside).alias("_i"), *[F.sum(v).over(inside).alias(f"{v}i") for v in values])
    meet = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        meet = meet & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(carried, meet, "left")
    zero = F.lit(0)
    numbered = [(F.coalesce("_before", zero) + F.col("_i")).alias(number)] if number else []
    return out.select(*kept, *numbered, *[(F.coalesce(f"_v{i}c", zero) + F.col(f"_v{i}i")).alias(name) for i, name in enumerate(sums)])


def as_of(rows: DataFrame, versions: DataFrame, keys: Sequence[str], t: str, since: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` that the newest version of their key has at time ``t``: since <= t, null before the first.

    Rows and versions lie on one time line for each key.  It is cut into slices of measured size, so a hot key takes
    many; each slice starts from the last version of the slices before it.  Of versions with equal times the largest
    value counts; rows with a null key or time get null.  A version may hold null, for a key that was taken away.
    """
    kept = rows.columns
    boxed = versions.where(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("_t")).agg(F.max(F.struct(F.col(value).alias("v"))).alias("_v"))
    asks = rows.withColumns({"_t": F.col(t), "_o": F.lit(1), "_h": F.xxhash64(*kept)})
    line = asks.unionByName(boxed.withColumns({"_o": F.lit(0), "_h": F.lit(0).cast("long")}), allowMissingColumns=True)
    order = [F.col("_t"), F.col("_o"), F.col("_h")]
    line = cut_lineage(line.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()))
    # a row that asks has no version and must not stand for one, however late it is
    last = line.groupBy("_slice", *keys).agg(F.max_by("_v", F.when(F.col("_o") == 0, F.col("_t"))).alias("_last"))
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("_slice").alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                          F.last("_last", ignorenulls=True).over(upto).alias("_before"))
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    meet = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        meet = meet & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = line.withColumn("_now", F.last("_v", ignorenulls=True).over(inside)).where("_o = 1").join(carried, meet)
    known = F.lit(True)
    for k in (*keys, t):
        known = known & F.col(k).isNotNull()
    return out.select(*kept, F.when(known, F.coalesce("_now", "_before")["v"]).alias(value))
