"""Document status, request routing and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom import dimensions as D
from lexiloom.functions.answers import is_unavailable, mentions_any
from lexiloom.functions.scalars import repeat_message


def latest_status(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Last written status and protection per document (partial aggregates, then one merge)."""
    newest = F.max_by(F.struct("status", "protected"), F.struct("ts", "seq")).alias("s")
    return events.groupBy(key).agg(newest).select(key, "s.status", "s.protected")


def lifecycle_events(actions: DataFrame) -> DataFrame:
    """Turn actions into status events: ``new``, ``start``, ``done``, ``failed``.

    A new document is protected and finishing either way clears that. Starting says
    nothing about protection: NULL, so that :func:`current_state` keeps what was said last.
    """
    status = (
        F.when(F.col("action") == "new", "not_started")
        .when(F.col("action") == "start", "processing")
        .when(F.col("action") == "done", "completed")
        .when(F.col("action") == "failed", "failed")
    )
    protected = F.when(F.col("action") == "new", True).when(F.col("action").isin("done", "failed"), False)
    return actions.withColumn("status", status).withColumn("protected", protected)


def current_state(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Latest status and latest stated protection per document."""
    order = F.struct("ts", "seq")
    return events.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.coalesce(
            F.max_by("protected", F.when(F.col("protected").isNotNull(), order)), F.lit(False)
        ).alias("protected"),
    )


def with_status(documents: DataFrame, statuses: DataFrame, key: str = "document_id") -> DataFrame:
    """Status of any document; a document without one is ``not_started`` and not protected."""
    joined = documents.join(statuses.select(key, "status", "protected"), key, "left")
    return joined.select(
        *documents.columns,
        F.coalesce("status", F.lit("not_started")).alias("rag_status"),
        F.coalesce("protected", F.lit(False)).alias("cache_protected"),
    )


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(*D.STATUSES), F.lit(False))


def is_completed(status: Column) -> Column:
    return F.coalesce(status == "completed", F.lit(False))


def is_in_progress(status: Column) -> Column:
    return F.coalesce(status == "processing", F.lit(False))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.count(F.lit(1)).alias("tracked_documents"), F.count_if("protected").alias("protected_documents")
    )


def route(requests: DataFrame, cache_enabled: bool = False) -> DataFrame:
    """Route of each request, first match wins.

    Needs ``is_blocked, rag_status, is_indexed, cache_protected``. Adds ``decision``, the
    labels ``method, source, rag_processing`` and ``marks_completed`` (an indexed document
    whose status was not yet ``completed``).
    """
    status = F.col("rag_status")
    decision = (
        F.when(F.col("is_blocked"), "blocked")
        .when(is_completed(status), "completed")
        .when(F.col("is_indexed"), "indexed")
        .when(is_in_progress(status), "processing")
        .when(F.col("cache_protected"), "protected")
        .otherwise("new")
    )
    through_cache = "cache" if cache_enabled else "retrieval"
    family = (
        F.when(F.col("decision") == "blocked", "blocked")
        .when(F.col("decision").isin("completed", "indexed"), "existing")
        .otherwise(through_cache)
    )

    def label(position: int) -> Column:
        branches = F
        for name, labels in D.ROUTES.items():
            branches = branches.when(F.col("__family") == name, F.lit(labels[position]))
        return branches

    return (
        requests.withColumn("decision", decision)
        .withColumn("__family", family)
        .withColumn("method", label(0))
        .withColumn("source", label(1))
        .withColumn("rag_processing", label(2))
        .withColumn("marks_completed", F.col("decision") == "indexed")
        .drop("__family")
    )


def with_fallback(cached: DataFrame, retrieved: DataFrame, key: str = "request_id") -> DataFrame:
    """Replace unavailable cache answers (or a failed cache call) by retrieval answers.

    ``cached`` has ``answers, error, n_questions``; ``retrieved`` has ``answers``.
    """
    fallback = retrieved.select(F.col(key), F.col("answers").alias("__retrieved"))
    needs = is_unavailable(F.col("answers")) | mentions_any(F.col("error"), D.ROUTE_ERROR_WORDS)
    joined = cached.join(fallback, key, "left").withColumn("__needs", needs)
    answers = F.when(
        F.col("__needs"), F.coalesce("__retrieved", repeat_message(D.MSG_FALLBACK_FAILED, F.col("n_questions")))
    ).otherwise(F.col("answers"))
    chosen = F.when(F.col("__needs"), "retrieval").otherwise("cache")
    return joined.withColumn("answers", answers).withColumn("answer_source", chosen).drop("__retrieved", "__needs")
