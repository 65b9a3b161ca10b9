"""Batch-ingest gates, result rows and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom import dimensions as D
from lexiloom.functions.filetypes import is_supported, with_file_type
from lexiloom.functions.urls import chunk_prefix, document_key


def indexed_keys(chunks: DataFrame) -> DataFrame:
    """Keys of indexed documents: those whose first chunk exists."""
    return chunks.where(F.col("ordinal") == 0).select("doc_key")


def with_key(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add the document's key and, for display, its short prefix."""
    return urls.withColumns({"chunk_prefix": chunk_prefix(F.col(url)), "doc_key": document_key(F.col(url))})


def new_documents(urls: DataFrame, chunks: DataFrame, url: str = "url") -> DataFrame:
    return with_key(urls, url).join(indexed_keys(chunks), "doc_key", "left_anti").drop("doc_key")


def indexed_documents(urls: DataFrame, chunks: DataFrame, url: str = "url") -> DataFrame:
    return with_key(urls, url).join(indexed_keys(chunks), "doc_key", "left_semi").drop("doc_key")


def skip_message(category: Column) -> Column:
    branches = F
    for name, message in D.SKIP_MESSAGES.items():
        branches = branches.when(category == name, F.lit(message))
    return branches.otherwise(F.concat(F.lit("File type '"), category, F.lit("' is not supported")))


def outcome_message(success: Column, category: Column, error: Column) -> Column:
    """Message of a processed document, by file kind and outcome."""
    done = F.when(
        category.isin(*D.FORCED_RETRIEVAL_CATEGORIES), F.concat(F.initcap(category), F.lit(" processed via RAG pipeline"))
    ).otherwise(F.lit(D.MSG_INDEXED))
    return F.when(success, done).otherwise(F.concat(F.lit("Processing failed: "), error))


def batch_outcomes(urls: DataFrame, results: DataFrame, url: str = "url") -> DataFrame:
    """Requested URLs with their batch result; a missing result counts as failed."""
    joined = urls.join(results.select(F.col("url").alias(url), "success", "error", "processing_time"), url, "left")
    return (
        joined.withColumn("success", F.coalesce("success", F.lit(False)))
        .withColumn("error", F.coalesce("error", F.lit("")))
        .withColumn("processing_time", F.coalesce("processing_time", F.lit(0.0)))
    )


def ingest_results(gated: DataFrame, results: DataFrame) -> DataFrame:
    """One result row per requested URL.

    ``gated`` holds ``url, ext, category, is_blocked, is_indexed``. The branches are
    disjoint by construction, so the union is one ``CASE`` over a single pass: blocked,
    unsupported, already indexed, processed.
    """
    rows = batch_outcomes(gated, results)
    category = F.col("category")
    blocked, known = F.col("is_blocked"), F.col("is_indexed")
    status = (
        F.when(blocked, "failed").when(~is_supported(category) | known, "skipped")
        .when(F.col("success"), "success").otherwise("failed")
    )
    message = (
        F.when(blocked, D.MSG_BLOCKED)
        .when(~is_supported(category), skip_message(category))
        .when(known, D.MSG_ALREADY_INDEXED)
        .otherwise(outcome_message(F.col("success"), category, F.col("error")))
    )
    untouched = blocked | ~is_supported(category) | known
    return rows.select(
        "url",
        status.alias("status"),
        message.alias("message"),
        F.when(untouched, F.lit(0.0)).otherwise(F.col("processing_time")).alias("processing_time"),
        F.when(~blocked, category).alias("file_type"),
    )


def gate(urls: DataFrame, blocked_flags: DataFrame, chunks: DataFrame) -> DataFrame:
    """URLs with file kind, block flag and already-indexed flag. ``blocked_flags`` has ``url, is_blocked``."""
    typed = with_key(with_file_type(blocked_flags.join(urls.select("url").distinct(), "url", "left_semi")))
    known = indexed_keys(chunks).distinct().withColumn("is_indexed", F.lit(True))
    return typed.join(known, "doc_key", "left").withColumn(
        "is_indexed", F.coalesce("is_indexed", F.lit(False))
    ).drop("chunk_prefix", "doc_key")


def ingest_summary(results: DataFrame) -> DataFrame:
    """Counts by status over every requested URL."""
    return results.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(F.col("status") == "success").alias("processed_successfully"),
        F.count_if(F.col("status") == "failed").alias("failed_documents"),
        F.count_if(F.col("status") == "skipped").alias("skipped_documents"),
        F.coalesce(F.round(F.sum("processing_time"), 2), F.lit(0.0)).alias("processing_time"),
    )


def batch_success(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("success").alias("successful"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.try_divide(F.count_if("success").cast("double"), F.count(F.lit(1))), 4).alias("success_ratio"),
    )
