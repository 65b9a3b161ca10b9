"""Request run ledger: gate, prefix, route and log a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from lexiloom.functions.answers import has_error
from lexiloom.operators.gates import flag_blocked
from lexiloom.operators.ingest import indexed_keys, with_key
from lexiloom.operators.status import route, with_status
from lexiloom.plans.retrieval import prefixed_questions
from lexiloom.schemas import REQUEST_LOG


def run_ledger(
    requests: DataFrame, patterns: DataFrame, statuses: DataFrame, chunks: DataFrame, cache_enabled: bool = False
) -> DataFrame:
    """Requests (``request_id, url, questions``) with gate, route, labels and prefixed questions.

    Gate and route depend on the document alone, so they are worked out once per distinct
    URL and joined back; a document asked for by most requests costs no more than another.
    """
    urls = requests.select("url").distinct()
    flagged = flag_blocked(urls, patterns)
    known = indexed_keys(chunks).distinct().withColumn("__known", F.lit(True))
    located = with_key(flagged).join(known, "doc_key", "left").withColumn(
        "is_indexed", F.coalesce("__known", F.lit(False))
    ).drop("__known", "chunk_prefix", "doc_key")
    routed = route(with_status(located, statuses, "url"), cache_enabled)
    # Every request stays: one without a document has no decision, and its questions stay as asked.
    joined = requests.join(routed.where("url is not null"), "url", "left")
    return joined.withColumn(
        "questions",
        F.when(F.coalesce("is_blocked", F.lit(True)), F.col("questions")).otherwise(prefixed_questions(F.col("url"), F.col("questions"))),
    ).withColumn("question_count", F.size("questions"))


def log_records(runs: DataFrame, endpoint: str = "/run") -> DataFrame:
    """Log records (schema ``REQUEST_LOG``, plus ``log_date``) of finished runs.

    ``runs`` has ``request_id, ts, url, questions, method, source, rag_processing,
    processing_time, answers, error``. A run with an error is logged as not successful.
    """
    failed = F.col("error").isNotNull()
    request = F.struct(
        F.col("url").alias("documents"), "questions", F.size("questions").alias("question_count"),
    )
    response = F.struct(
        (~failed).alias("success"), "method", "processing_time", "rag_processing", "source",
        F.coalesce(F.size("answers"), F.lit(0)).alias("answer_count"), has_error(F.col("answers")).alias("has_errors"),
        "answers", "error",
    )
    rows = runs.select(
        "request_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        (F.unix_micros("ts") / 1000000.0).alias("unix_timestamp"),
        F.lit(endpoint).alias("endpoint"), F.lit("POST").alias("method"),
        request.alias("request"), response.alias("response"),
        F.to_date("ts").alias("log_date"),
    )
    return conform(rows, REQUEST_LOG, "log_date")


def conform(df: DataFrame, schema: StructType, *extra: str) -> DataFrame:
    """Bring nested rows to a schema: its fields in its order, missing ones NULL."""

    def shaped(kind: DataType, have: DataType | None, value: Column) -> Column:
        if have is None:
            return F.lit(None).cast(kind)
        if not isinstance(kind, StructType):
            return value.cast(kind)
        return F.struct(*[
            shaped(f.dataType, have[f.name].dataType if f.name in have.names else None, value[f.name] if f.name in have.names else value).alias(f.name)
            for f in kind.fields
        ])

    columns = [
        shaped(f.dataType, df.schema[f.name].dataType if f.name in df.columns else None, F.col(f.name) if f.name in df.columns else F.lit(None)).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*columns, *extra)
