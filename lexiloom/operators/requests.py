"""Request-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexiloom.functions.answers import has_error


def flat_log(records: DataFrame) -> DataFrame:
    """Nested log records as the flat columns the statistics work on.

    Embedding calls carry ``document_urls`` instead of ``documents``; theirs is NULL.
    """
    return records.select(
        "request_id", "log_date", "unix_timestamp", "endpoint",
        F.col("request.documents").alias("documents"),
        F.coalesce(F.size("request.questions"), F.lit(0)).alias("question_count"),
        F.col("response.processing_time").alias("processing_time"),
        F.col("response.answers").alias("answers"),
        F.col("response.success").alias("success"),
        F.col("response.method").alias("method"),
        F.col("response.error").alias("error"),
    )


def request_metrics(log: DataFrame) -> DataFrame:
    """Per-request derived metrics over ``answers`` and ``question_count``."""
    return log.select(
        "request_id",
        F.coalesce(F.size("answers"), F.lit(0)).alias("answer_count"),
        has_error(F.col("answers")).alias("has_errors"),
        F.coalesce("question_count", F.lit(0)).alias("question_count"),
    )


def request_stats(log: DataFrame, day: str = "log_date", approximate: bool = False) -> DataFrame:
    """Daily statistics: one partial aggregate per day, plus a distinct count of documents.

    Zero and missing processing times are left out of the mean; a request without answers
    counts neither as success nor as error; the empty document is not counted.
    """
    answered = F.coalesce(F.size("answers"), F.lit(0)) > 0
    failed = has_error(F.col("answers"))
    document = F.when(F.col("documents") != "", F.col("documents"))
    distinct = F.approx_count_distinct(document) if approximate else F.count_distinct(document)
    total = F.count(F.lit(1))
    succeeded = F.count_if(answered & ~failed)
    return log.groupBy(day).agg(
        total.alias("total_requests"),
        F.coalesce(
            F.round(F.avg(F.when(F.col("processing_time") != 0, F.col("processing_time"))), 2), F.lit(0.0)
        ).alias("avg_processing_time"),
        succeeded.alias("success_count"),
        F.count_if(answered & failed).alias("error_count"),
        distinct.alias("unique_documents"),
        F.sum(F.coalesce("question_count", F.lit(0))).alias("total_questions"),
        F.round(succeeded / total * 100, 2).alias("success_rate"),
    )


def stats_for_days(log: DataFrame, days: DataFrame, day: str = "log_date") -> DataFrame:
    """Statistics of the given days; a day without requests has zeros and no success rate."""
    stats = days.select(day).distinct().join(request_stats(log, day), day, "left")
    zeros = {c: 0 for c in stats.columns if c not in (day, "success_rate", "avg_processing_time")}
    return stats.fillna({**zeros, "avg_processing_time": 0.0})


def last_requests(log: DataFrame, count: int = 10, day: str = "log_date", with_answers: bool = True) -> DataFrame:
    """Newest ``count`` records of every day; a record without a time stamp is the oldest.

    The rank limit is applied before the shuffle, so a busy day sends at most ``count``
    rows per input partition.
    """
    newest = Window.partitionBy(day).orderBy(F.coalesce("unix_timestamp", F.lit(0.0)).desc(), "request_id")
    top = log.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= count)
    return top if with_answers else without_answers(top)


def without_answers(log: DataFrame) -> DataFrame:
    """Drop ``answers``, as a column or inside the ``response`` struct."""
    if "response" in log.columns:
        log = log.withColumn("response", F.col("response").dropFields("answers"))
    return log.drop("answers")
