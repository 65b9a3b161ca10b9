"""Structured Streaming jobs: log, daily statistics, status, repeats, incremental ingest.

Every job reads a stream, writes to a table and keeps its progress in a checkpoint
folder. ``run_to_end`` processes what is there and stops; on a cluster the same writers
run with a processing-time trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexiloom.functions.answers import has_error
from lexiloom.functions.urls import doc_hash
from lexiloom.operators.status import current_state
from lexiloom.plans.ingest import ingest_new

CHANGES = "batch"


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available, in as many micro-batches as the source makes, and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log_writer(records: DataFrame, path: str) -> DataStreamWriter:
    """Continuous append to the date-partitioned log."""
    return records.writeStream.format("parquet").partitionBy("log_date").option("path", path).outputMode("append")


def change_writer(updates: DataFrame, path: str) -> DataStreamWriter:
    """Write every micro-batch's changed rows to its own folder; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{CHANGES}={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(write)


def latest_changes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state out of the change folders: the newest row per key."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in keys + [CHANGES]]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), CHANGES).alias("s"))
    return newest.select(*keys, *[F.col(f"s.{v}").alias(v) for v in values])


def daily_counts(records: DataFrame) -> DataFrame:
    """Running daily statistics except the distinct documents.

    Sums and counts are merged in the state store after a partial aggregate per input
    partition, so a busy day is no hot task. There is no watermark: the state holds one row
    per day, and a record counts for its day however late it comes.
    """
    answered = F.coalesce(F.size("answers"), F.lit(0)) > 0
    failed = has_error(F.col("answers"))
    timed = F.when(F.col("processing_time") != 0, F.col("processing_time"))
    day = F.window("ts", "1 day")
    counted = records.where(F.col("ts").isNotNull()).groupBy(day).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(timed).alias("time_sum"),
        F.count(timed).alias("time_n"),
        F.count_if(answered & ~failed).alias("success_count"),
        F.count_if(answered & failed).alias("error_count"),
        F.sum(F.coalesce("question_count", F.lit(0))).alias("total_questions"),
    )
    return counted.select(F.to_date(F.col("window.start")).alias("log_date"), *[c for c in counted.columns if c != "window"])


def daily_documents(records: DataFrame) -> DataFrame:
    """Day and document of every record that names one, for :func:`seen_writer`."""
    return records.where(F.coalesce(F.col("documents"), F.lit("")) != "").select("log_date", "documents")


def seen_writer(rows: DataFrame, path: str) -> DataStreamWriter:
    """Write the distinct rows of every micro-batch to its own folder; readers count distinct rows.

    No state is kept, so no row comes too late; a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{path}/{CHANGES}={batch_id}")

    return rows.writeStream.foreachBatch(write)


def finished_stats(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """Daily statistics out of the two streams' tables."""
    distinct = documents.groupBy("log_date").agg(F.count_distinct("documents").alias("unique_documents"))
    joined = counts.join(distinct, "log_date", "left")
    return joined.select(
        "log_date", "total_requests",
        F.coalesce(F.round(F.col("time_sum") / F.nullif("time_n", F.lit(0)), 2), F.lit(0.0)).alias("avg_processing_time"),
        "success_count", "error_count",
        F.coalesce("unique_documents", F.lit(0).cast("long")).alias("unique_documents"),
        "total_questions",
        F.round(F.col("success_count") / F.col("total_requests") * 100, 2).alias("success_rate"),
    )


def status_updates(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Latest status and latest stated protection per document, kept in the state store.

    ``max_by`` combines before the shuffle, so a document with most of the events sends
    one row per input partition.
    """
    return current_state(events, key)


def first_submissions(requests: DataFrame, url: str = "url", delay: str | None = None) -> DataFrame:
    """Suppress repeated submissions of a document.

    The state holds one short hash per document, for ever; on a cluster keep it in the RocksDB
    state store. A ``delay`` bounds the state to that time: repeats further apart then pass
    again, and rows that come later than it are dropped.
    """
    keyed = requests.withColumn("doc_hash", doc_hash(F.col(url)))
    if delay is None:
        return keyed.dropDuplicates(["doc_hash"])
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_hash"])


def ingest_writer(documents: DataFrame, table: str, **layout) -> DataStreamWriter:
    """Ingest documents as they arrive, skipping those already indexed.

    Chunks are merged by document prefix, so a repeated micro-batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_new(batch.sparkSession, batch, table, **layout)

    return documents.writeStream.foreachBatch(write)
