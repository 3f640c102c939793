"""Running numbers and sums against pandas, with hot, null and hashed keys."""

from pyspark.sql import functions as F

from watchtide.operators.audit import number_records
from watchtide.operators.running import as_of, running


def rows(spark, n=6000):
    g = F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 5 < 3, "hot").otherwise((F.col("id") % 40).cast("string")))
    return spark.range(n).select(g.alias("g"), (F.xxhash64("id") % 500).alias("k"), "id",
                                 F.when(F.col("id") % 11 > 0, F.col("id")).alias("v"))


def test_running_by_group(spark):
    got = running(rows(spark), ["g"], [F.col("k"), F.col("id")], {"s": F.col("v")}, "n").toPandas()
    got["g"], got["v"] = got.g.fillna("none"), got.v.fillna(0)
    got = got.sort_values(["g", "k", "id"])
    assert len(got) == 6000
    assert (got.groupby("g").cumcount() + 1 == got.n).all()
    assert (got.groupby("g").v.cumsum() == got.s).all()


def test_running_over_everything_and_nothing(spark):
    got = running(rows(spark), [], [F.col("id").desc()], {"s": F.lit(2)}, "n").toPandas().sort_values("id", ascending=False)
    assert got.n.tolist() == list(range(1, 6001)) and got.s.tolist() == list(range(2, 12002, 2))
    assert running(rows(spark).where("false"), ["g"], [F.col("id")], {"s": F.col("v")}, "n").count() == 0


def test_numbers_of_hashed_keys(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("key"))
    got = number_records(df, "key", start=7).toPandas().sort_values("key")
    assert got.sequence.tolist() == list(range(8, 5008))


def test_one_hot_group_spreads_over_slices(spark):
    df = spark.range(40000).select(F.lit("one").alias("g"), "id")
    # rows of the one group that share a slice: none holds more than twice its share of four
    spread = df.repartitionByRange(4, "g", "id").groupBy(F.spark_partition_id().alias("p")).count().toPandas()
    assert len(spread) == 4 and spread["count"].max() < 20000
    got = running(df, ["g"], [F.col("id")], number="n")
    assert got.where(F.col("n") != F.col("id") + 1).count() == 0


def test_as_of_takes_the_newest_version_before(spark):
    import random
    rnd = random.Random(1)
    versions = [(rnd.choice(["a", "b", "hot", None]), rnd.randrange(200), rnd.choice([None, "x", "y", "z"])) for _ in range(120)]
    rows = [(i, rnd.choice(["a", "hot", "hot", "hot", "c", None]), rnd.choice([None, *range(-5, 210)])) for i in range(1500)]
    v = spark.createDataFrame(versions, "k string, since int, value string")
    got = as_of(spark.createDataFrame(rows, "id int, k string, t int"), v, ["k"], "t", "since", "value")
    assert got.columns == ["id", "k", "t", "value"]
    newest = {}
    for k, since, value in versions:
        newest[k, since] = max([newest.get((k, since), None), value], key=lambda x: (x is not None, x or ""))
    want = {}
    for i, k, t in rows:
        before = [s for n, s in newest if n == k and t is not None and s <= t] if k is not None else []
        want[i] = newest[k, max(before)] if before else None
    assert {r.id: r.value for r in got.collect()} == want
    assert as_of(spark.createDataFrame(rows, "id int, k string, t int"), v.where("false"), ["k"], "t", "since", "value").where("value IS NOT NULL").count() == 0


def test_as_of_carries_a_version_past_the_rows_that_ask(spark):
    """A slice that ends in asking rows hands its last version on, not the one before."""
    v = spark.createDataFrame([("k", 0, "a"), ("k", 150, "b"), ("k", 260, None)], "k string, since int, value string")
    rows = spark.range(1, 400).select("id", F.lit("k").alias("k"), F.col("id").cast("int").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # four slices of a hundred rows
    try:
        got = {r.id: r.value for r in as_of(rows, v, ["k"], "t", "since", "value").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: "a" if i < 150 else "b" if i < 260 else None for i in range(1, 400)}
