"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("chunk_prefix", T.StringType()),
    T.StructField("doc_key", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

CACHE_MAP = T.StructType([
    T.StructField("doc_hash", T.StringType()),
    T.StructField("cache_name", T.StringType()),
])

LOG_REQUEST = T.StructType([
    T.StructField("documents", T.StringType()),
    T.StructField("questions", T.ArrayType(T.StringType())),
    T.StructField("question_count", T.IntegerType()),
    T.StructField("document_urls", T.ArrayType(T.StringType())),
    T.StructField("document_count", T.IntegerType()),
    T.StructField("use_async", T.BooleanType()),
    T.StructField("num_workers", T.IntegerType()),
])

LOG_RESPONSE = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("method", T.StringType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("rag_processing", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("answer_count", T.IntegerType()),
    T.StructField("has_errors", T.BooleanType()),
    T.StructField("queue_time", T.DoubleType()),
    T.StructField("total_time", T.DoubleType()),
    T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("error_type", T.StringType()),
])

REQUEST_LOG = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("unix_timestamp", T.DoubleType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("request", LOG_REQUEST),
    T.StructField("response", LOG_RESPONSE),
    T.StructField("user", T.MapType(T.StringType(), T.StringType())),
    T.StructField("processing_info", T.MapType(T.StringType(), T.StringType())),
])

EMAIL = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("stem", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("recipient", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("has_attachments", T.BooleanType()),
    T.StructField("body", T.StringType()),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
    ]))),
    T.StructField("error", T.StringType()),
])
