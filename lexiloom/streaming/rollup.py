"""Daily request statistics as stored partial aggregates that are merged when they are read.

Every micro-batch (or appended file) is reduced to one row per day of sums, counts and a sketch of
its documents, and to its distinct (day, document) pairs, in a folder of its own. Nothing is
kept in a state store, so the state is bounded however many days there are, no row comes too
late, and a repeated batch overwrites itself. Only the days a batch touches have a row in it.

Any range of days is answered from the partial rows: sums add up, and the sketches' union gives
the number of distinct documents of the range without another look at the log. The exact
number comes from the pairs. Compaction merges the folders so far into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexiloom.functions.answers import has_error
from lexiloom.session import folders_in, remove_folder

#: Logarithm of a sketch's registers; the standard error is some 1.04 / 2^(this / 2), 1.6 %.
SKETCH_BITS = 12

_SUMS = ("total_requests", "time_sum", "time_n", "success_count", "error_count", "total_questions")


def partial_rows(records: DataFrame) -> DataFrame:
    """One row per day: sums and counts, and a sketch of the documents (empty ones left out)."""
    answered = F.coalesce(F.size("answers"), F.lit(0)) > 0
    failed = has_error(F.col("answers"))
    timed = F.when(F.col("processing_time") != 0, F.col("processing_time"))
    named = F.when(F.col("documents") != "", F.col("documents"))
    return records.where("log_date is not null").groupBy("log_date").agg(
        F.count(F.lit(1)).alias("total_requests"), F.coalesce(F.sum(timed), F.lit(0.0)).alias("time_sum"), F.count(timed).alias("time_n"),
        F.count_if(answered & ~failed).alias("success_count"), F.count_if(answered & failed).alias("error_count"),
        F.sum(F.coalesce("question_count", F.lit(0))).alias("total_questions"),
        F.hll_sketch_agg(named, F.lit(SKETCH_BITS)).alias("sketch"),
    )


def document_rows(records: DataFrame) -> DataFrame:
    """Distinct days and documents."""
    return records.where("log_date is not null and documents <> ''").select("log_date", "documents").distinct()


def _merged(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return parts.groupBy("log_date").agg(*sums, F.hll_union_agg("sketch").alias("sketch"))


def add_batch(records: DataFrame, path: str, number: int) -> None:
    """Store a batch's partial rows; the same number again replaces them."""
    partial_rows(records).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
    document_rows(records).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")


def rollup_writer(records: DataFrame, path: str) -> DataStreamWriter:
    """Store the partial rows of every micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        add_batch(batch, path, number)
        batch.unpersist()

    return records.writeStream.foreachBatch(write)


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind: those Spark's writer marked as complete."""
    return sorted(int(name.split("=")[1]) for name in folders_in(spark, path, finished=True) if name.startswith(f"{kind}="))


def _stored(spark: SparkSession, path: str, what: str) -> list[str]:
    """Folders that make up the whole: the last compacted one and the batches after it."""
    root = f"{path}/{what}"
    base = max(_numbers(spark, root, "upto"), default=None)
    later = [n for n in _numbers(spark, root, "batch") if base is None or n > base]
    return [f"{root}/upto={base}"] * (base is not None) + [f"{root}/batch={n}" for n in later]


def daily_sums(spark: SparkSession, path: str) -> DataFrame:
    """Merged sums and sketch of every day."""
    return _merged(spark.read.parquet(*_stored(spark, path, "sums")))


def daily_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct days and documents of all batches."""
    return spark.read.parquet(*_stored(spark, path, "documents")).distinct()


def daily_stats(spark: SparkSession, path: str) -> DataFrame:
    """Daily statistics in the columns of ``operators.requests.request_stats``."""
    distinct = daily_pairs(spark, path).groupBy("log_date").agg(F.count(F.lit(1)).alias("unique_documents"))
    mean = F.coalesce(F.round(F.col("time_sum") / F.nullif("time_n", F.lit(0)), 2), F.lit(0.0))
    return daily_sums(spark, path).join(distinct, "log_date", "left").select(
        "log_date", "total_requests", mean.alias("avg_processing_time"), "success_count", "error_count",
        F.coalesce("unique_documents", F.lit(0).cast("long")).alias("unique_documents"), "total_questions",
        F.round(F.col("success_count") / F.col("total_requests") * 100, 2).alias("success_rate"),
    )


def estimated_documents(sums: DataFrame, ranges: DataFrame) -> DataFrame:
    """``range_id, estimate``: distinct documents between ``first_day`` and ``last_day``, from the sketches.

    ``ranges`` are few; there is one row of sums per day.
    """
    inside = F.col("log_date").between(F.col("first_day"), F.col("last_day"))
    held = sums.join(F.broadcast(ranges), inside)
    return held.groupBy("range_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def within(estimate: Column, exact: Column, errors: float = 3.0) -> Column:
    """Whether an estimate lies within so many standard errors (and one) of the exact number."""
    return F.abs(estimate - exact) <= exact * (errors * 1.04 / 2 ** (SKETCH_BITS / 2)) + 1


def compact_rollup(spark: SparkSession, path: str, keep_batches: bool = False) -> int | None:
    """Merge all batches so far into one folder; the number of the last one, None if there is none.

    Readers go over to the new folder when its writer has finished; the folders it stands for are
    removed afterwards.
    """
    last = max(_numbers(spark, f"{path}/sums", "batch"), default=None)
    known = max(_numbers(spark, f"{path}/sums", "upto"), default=-1)
    if last is None or last <= known:
        return None
    for what, rows in (("documents", daily_pairs(spark, path)), ("sums", daily_sums(spark, path))):
        rows.write.mode("overwrite").parquet(f"{path}/{what}/upto={last}")
    if not keep_batches:
        for what in ("documents", "sums"):
            for kind in ("batch", "upto"):
                for number in _numbers(spark, f"{path}/{what}", kind):
                    if number < last or (kind == "batch" and number == last):
                        remove_folder(spark, f"{path}/{what}/{kind}={number}")
    return last
