"""Sinks: topics, dead letters and keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from watchtide.operators import graph_build
from watchtide.schema import ENVELOPE


def topic_source(spark: SparkSession, folder: str, schema=ENVELOPE, files_per_trigger: int = 100) -> DataFrame:
    """A topic as a stream of parquet files from the earliest record on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def kafka_source(spark: SparkSession, servers: str, topic: str, schema=ENVELOPE, records_per_trigger: int = 1_000_000) -> DataFrame:
    """The same from Kafka; needs the Kafka connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", records_per_trigger).load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def topic_records(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Key and JSON value of records to publish."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_topic(df: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def save_batch(df: DataFrame, folder: str, batch_id: int, partition_by: list[str] = []) -> None:
    """Write one micro-batch to its own folder; a replayed batch overwrites itself."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/batch_id={batch_id}")


def split_routes(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that sends accepted records and dead letters to their own tables."""
    from watchtide.operators.ingest import dead_letters

    def write(batch: DataFrame, batch_id: int) -> None:
        save_batch(batch.where("status = 'accepted'"), f"{folder}/accepted", batch_id)
        save_batch(dead_letters(batch), f"{folder}/dead_letter", batch_id)
    return write


def read_batches(spark: SparkSession, folder: str, schema: str | None) -> DataFrame:
    """A table of micro-batches; empty, with the given schema, before the first."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


MERGED = {"nodes": ["node_id"], "edges": ["edge_id"]}


def graph_sink(folder: str, epoch: int = 16) -> Callable[[DataFrame, int], None]:
    """Batch writer for graph deltas: each batch aggregates first, then writes one delta per key.

    The batch is written once and read back, so normalizing and enriching run once for three tables.  After every
    ``epoch`` batches their deltas are merged into a new generation (:func:`compact`).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.drop("body") if "body" in batch.columns else batch
        save_batch(rows, f"{folder}/events", batch_id)
        events = spark.read.schema(rows.schema).parquet(f"{folder}/events/batch_id={batch_id}")
        if "raw" in events.columns:
            events = events.withColumn("body", F.try_parse_json("raw"))
        at = f"epoch={batch_id // epoch}"
        save_batch(graph_build.upsert_nodes(graph_build.node_rows(events)), f"{folder}/nodes/{at}", batch_id)
        save_batch(graph_build.upsert_edges(graph_build.edge_rows(events)), f"{folder}/edges/{at}", batch_id)
        save_batch(graph_build.update_summary(events), f"{folder}/updates", batch_id)
        if batch_id % epoch == epoch - 1:
            compact(spark, folder, batch_id // epoch)
    return write


def generation(spark: SparkSession, folder: str) -> int:
    """Newest complete generation, -1 before the first: the manifest's newest row."""
    newest = read_batches(spark, f"{folder}/manifest", "epoch int, tables string").agg(F.max("epoch")).first()[0]
    return -1 if newest is None else newest


def _merged(spark: SparkSession, folder: str, name: str, pinned: int) -> DataFrame:
    """Generation ``pinned`` of a table and the deltas of the epoch after it, merged by key."""
    paths = [f"{folder}/{name}-generations/epoch={pinned}"] if pinned >= 0 else []
    rows = None
    for path in [*paths, f"{folder}/{name}/epoch={pinned + 1}"]:
        try:
            part = spark.read.parquet(path)
        except AnalysisException:  # no batch of the epoch yet
            continue
        part = part.drop("batch_id")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise FileNotFoundError(f"no {name} below {folder}")
    return graph_build.merge_upserts(rows.limit(0), rows, MERGED[name])


def compact(spark: SparkSession, folder: str, epoch: int) -> None:
    """Merge the generation before ``epoch`` and the deltas of the epoch into generation ``epoch``.

    The manifest's row is written last, so readers see a generation whole or not at all, and keep the one they began
    with.  Doing it again, as after a failure or for a replayed batch, writes the same rows to the same places.
    """
    for name in MERGED:
        _merged(spark, folder, name, epoch - 1).write.mode("overwrite").parquet(f"{folder}/{name}-generations/epoch={epoch}")
    spark.createDataFrame([(",".join(MERGED),)], "tables string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/epoch={epoch}")


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Current nodes and edges: the newest generation with the deltas after it, however many batches there were."""
    pinned = generation(spark, folder)
    return _merged(spark, folder, "nodes", pinned), _merged(spark, folder, "edges", pinned)


def latest_by_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Current rows of an append-only table: the newest version per key, by one aggregate."""
    rest = [c for c in df.columns if c not in key and c != order]
    return df.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("m")).select(*key, "m.*")


def save_table(df: DataFrame, folder: str, partition_by: list[str] = [], mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(folder)
