"""Document-to-cache mapping: hits, creation, eviction, status, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.dimensions import CACHE_ERROR_WORDS
from lexiloom.functions.answers import mentions_any
from lexiloom.functions.filetypes import needs_retrieval, with_file_type
from lexiloom.functions.scalars import stable_name, strip
from lexiloom.functions.urls import doc_hash
from lexiloom.operators.ordering import previous_values, row_numbers


def get_or_create(
    requests: DataFrame, mapping: DataFrame, url: str = "url", cache_enabled: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Cache name of every request and the mapping with the missing documents added.

    A known document reuses its name, an unknown one gets one name however often it is
    asked for; documents that must be retrieved, and all while the cache is off, get NULL.
    """
    if not cache_enabled:
        off = requests.withColumn("cache_name", F.lit(None).cast("string")).withColumn("is_hit", F.lit(False))
        return off, mapping
    # Every row keeps its own hash as join key: NULL keys would all meet in one task.
    keyed = with_file_type(requests.withColumn("doc_hash", doc_hash(F.col(url))), url).withColumn(
        "__cacheable", ~needs_retrieval(F.col("category"), F.lit(True))
    ).drop("ext", "category")
    wanted = keyed.where("__cacheable").select("doc_hash").distinct()
    created = wanted.join(mapping, "doc_hash", "left_anti").withColumn("cache_name", stable_name("cache", F.col("doc_hash")))
    updated = mapping.select("doc_hash", "cache_name").unionByName(created)
    known = mapping.select("doc_hash", F.col("cache_name").alias("__known"))
    named = keyed.join(known, "doc_hash", "left").withColumn(
        "cache_name", F.when(F.col("__cacheable"), F.coalesce("__known", stable_name("cache", F.col("doc_hash"))))
    ).withColumn("is_hit", F.col("__cacheable") & F.col("__known").isNotNull())
    return named.select(*requests.columns, "cache_name", "is_hit"), updated


def hit_ordinals(requests: DataFrame, order: list[str], url: str = "url", **bounds) -> DataFrame:
    """Number requests per document; every one after the first is a cache hit."""
    keyed = requests.withColumn("doc_hash", doc_hash(F.col(url)))
    numbered = row_numbers(keyed, ["doc_hash"], order, "request_no", **bounds)
    return numbered.withColumn("is_hit", F.col("request_no") > 1)


def repeat_submissions(requests: DataFrame, tenant: str, order: list[str], url: str = "url", **bounds) -> DataFrame:
    """Flag a request whose trimmed URL equals the previous one of the same tenant."""
    trimmed = requests.withColumn("__url", strip(F.col(url)))
    lagged = previous_values(trimmed, [tenant], order, "__url", "__previous", **bounds)
    return lagged.withColumn("is_repeat", F.coalesce(F.col("__url") == F.col("__previous"), F.lit(False))).drop(
        "__url", "__previous"
    )


def evict(mapping: DataFrame, documents: DataFrame, url: str = "url") -> DataFrame:
    """Mapping without the entries of the given documents."""
    gone = documents.select(doc_hash(F.col(url)).alias("doc_hash")).distinct()
    return mapping.join(gone, "doc_hash", "left_anti")


def evict_all(mapping: DataFrame) -> DataFrame:
    return mapping.where(F.lit(False))


def worth_another_try(error: Column) -> Column:
    """A cache call's error message that tells of an overloaded model."""
    return mentions_any(error, CACHE_ERROR_WORDS)


def cache_status(mapping: DataFrame, enabled: bool) -> DataFrame:
    """``cache_enabled``, number of mapped documents and a message."""
    total = F.count(F.lit(1)) if enabled else F.lit(0).cast("long")
    return mapping.agg(total.alias("total_cached_documents")).select(
        F.lit(enabled).alias("cache_enabled"),
        "total_cached_documents",
        F.lit("Cache is enabled and active" if enabled else "Cache is disabled").alias("message"),
    )


def active_entries(mapping: DataFrame, enabled: bool = True) -> DataFrame:
    return mapping.where(F.lit(enabled)).withColumn("status", F.lit("active"))
