"""Document ingest: one job over any number of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.functions.vectors import TERM_COUNTS, Embedding
from lexiloom.operators.chunking import semantic_chunks
from lexiloom.operators.gates import flag_blocked
from lexiloom.operators.ingest import gate, ingest_results, new_documents
from lexiloom.sources.chunk_table import open_chunks, save_chunks


def readable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull())


def document_outcomes(urls: DataFrame, docs: DataFrame) -> DataFrame:
    """Per-URL result of a batch: a document without text is a failed row, not a failed job."""
    texts = docs.select("url", F.col("text").isNotNull().alias("__ok"), F.lit(True).alias("__seen"))
    joined = urls.join(texts, "url", "left")
    ok = F.coalesce("__ok", F.lit(False))
    error = F.when(ok, F.lit("")).when(F.col("__seen"), F.lit("document has no text")).otherwise("document not found")
    return joined.select(
        "url", ok.alias("success"), error.alias("error"), F.lit(0.0).alias("processing_time")
    )


def one_version(docs: DataFrame) -> DataFrame:
    """One row per URL: of several versions in a batch the one with the greatest text stays.

    Only the URLs are counted where none repeats; texts move only for the repeated ones.
    """
    repeated = docs.groupBy("url").count().where("count > 1").select("url")
    if repeated.isEmpty():
        return docs
    several = docs.join(repeated, "url", "left_semi")
    chosen = several.groupBy("url").agg(F.max_by(F.struct(*docs.columns), "text").alias("d")).select("d.*")
    return docs.join(repeated, "url", "left_anti").unionByName(chosen.select(*docs.columns))


def ingest_documents(
    spark: SparkSession, docs: DataFrame, table: str, mode: str = "replace", embedding: Embedding = TERM_COUNTS, **layout
) -> None:
    """Chunk, embed and store documents.

    Where to cut is decided on term counts; the stored vectors are those of ``embedding``, for
    any other than term counts computed when the chunks are written.
    """
    chunks = semantic_chunks(one_version(readable(docs)))
    if embedding is not TERM_COUNTS:
        chunks = chunks.drop("embedding")
    save_chunks(spark, table, chunks, mode, embedding=embedding, **layout)


def ingest_new(spark: SparkSession, docs: DataFrame, table: str, **layout) -> None:
    """Ingest only documents that are not indexed yet; what is stored is not read or rewritten."""
    fresh = new_documents(docs, open_chunks(spark, table)).drop("chunk_prefix")
    ingest_documents(spark, fresh, table, "append", **layout)


def batch_ingest_report(urls: DataFrame, docs: DataFrame, patterns: DataFrame, chunks: DataFrame) -> DataFrame:
    """Result rows of a batch request after the block, support and already-indexed gates."""
    asked = urls.select("url").distinct()
    flagged = flag_blocked(asked, patterns)
    return ingest_results(gate(asked, flagged, chunks), document_outcomes(asked, docs))
