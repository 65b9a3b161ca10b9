"""File category, processing strategy and parse route of a URL or path.

The extension families are fixed and small, so a category is a look-up in a map literal:
no join, no broadcast, no shuffle, and the URL is taken apart once per use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom import dimensions as D
from lexiloom.functions.urls import file_extension, is_pdf_path, is_pdf_url


def extension_category(ext: Column) -> Column:
    """Category of an extension; unknown and empty ones are ``unsupported``."""
    pairs = [F.lit(x) for category, exts in D.EXTENSIONS.items() for e in exts for x in (e, category)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit(D.UNSUPPORTED))


def file_category(url: Column) -> Column:
    return extension_category(file_extension(url))


def is_supported(category: Column) -> Column:
    """Rejected categories and unknown extensions fail (the families are disjoint)."""
    return category.isin(*D.SUPPORTED_CATEGORIES)


def is_forced_retrieval(category: Column) -> Column:
    """Presentations and spreadsheets are never cached."""
    return category.isin(*D.FORCED_RETRIEVAL_CATEGORIES)


def can_be_cached(category: Column, cache_enabled: Column) -> Column:
    """Forced-retrieval kinds are not among the cacheable ones, so one test is enough."""
    return cache_enabled & category.isin(*D.CACHEABLE_CATEGORIES)


def is_word_document(ext: Column) -> Column:
    return ext.isin(*D.WORD_EXTENSIONS)


def is_presentation_document(ext: Column) -> Column:
    return ext.isin(*D.EXTENSIONS["presentation"])


def is_spreadsheet_document(ext: Column) -> Column:
    return ext.isin(*D.EXTENSIONS["spreadsheet"])


def is_email_file(ext: Column) -> Column:
    return ext.isin(*D.EXTENSIONS["email"])


def processing_method(category: Column, cache_enabled: Column) -> Column:
    return F.when(can_be_cached(category, cache_enabled), "cache").otherwise("rag")


def needs_retrieval(category: Column, cache_enabled: Column) -> Column:
    """True where answers must come from retrieval instead of a document cache."""
    return ~can_be_cached(category, cache_enabled)


def processing_strategy(ext: Column, category: Column, cache_enabled: Column) -> Column:
    return F.struct(
        ext.alias("extension"),
        category.alias("category"),
        is_supported(category).alias("is_supported"),
        can_be_cached(category, cache_enabled).alias("should_cache"),
        is_forced_retrieval(category).alias("force_rag"),
        processing_method(category, cache_enabled).alias("processing_method"),
        category.isin(*D.PARSED_CATEGORIES).alias("requires_llamaparse"),
        category.isin(*D.UPLOADED_CATEGORIES).alias("can_direct_upload"),
    )


def file_info(url: Column, ext: Column, category: Column, cache_enabled: Column) -> Column:
    """Strategy plus recommendations as one nested struct."""
    strategy = processing_strategy(ext, category, cache_enabled)
    return F.struct(
        url.alias("file_path_or_url"),
        ext.alias("extension"),
        category.alias("category"),
        is_supported(category).alias("is_supported"),
        strategy.alias("processing_strategy"),
        F.struct(
            can_be_cached(category, cache_enabled).alias("use_cache"),
            is_forced_retrieval(category).alias("force_rag"),
            category.isin(*D.PARSED_CATEGORIES).alias("use_llamaparse"),
            processing_method(category, cache_enabled).alias("processing_method"),
        ).alias("recommendations"),
    )


def file_kind(url: Column, is_local: Column) -> Column:
    """Kind record of a local path or remote URL."""
    ext = file_extension(url)
    pdf = F.when(is_local, ext == ".pdf").otherwise(is_pdf_path(url) | is_pdf_url(url))
    return F.struct(
        is_local.alias("is_local"),
        pdf.alias("is_pdf"),
        F.when(is_local, ext).when(pdf, ".pdf").otherwise("unknown").alias("file_type"),
        F.when(pdf, "direct").otherwise("parse_first").alias("cache_strategy"),
        F.when(is_local & pdf, "direct").otherwise("parse_first").alias("rag_strategy"),
    )


def parse_route(url: Column, ext: Column, category: Column, image_heavy: Column) -> Column:
    """How a document is turned into cacheable content; the first test that holds wins.

    A PDF without page statistics counts as image-heavy.
    """
    heavy = F.coalesce(image_heavy, F.lit(True))
    return (
        F.when(needs_retrieval(category, F.lit(True)), "forced_retrieval")
        .when(is_pdf_url(url) & ~heavy, "pdf_direct_upload")
        .when(is_pdf_url(url), "pdf_parse")
        .when(is_word_document(ext), "word_markdown")
        .when(is_email_file(ext), "email_markdown")
        .otherwise("parse")
    )


def with_file_type(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``ext`` and ``category`` columns, each computed once."""
    return df.withColumn("ext", file_extension(F.col(url))).withColumn(
        "category", extension_category(F.col("ext"))
    )


def extension_dimension(spark: SparkSession) -> DataFrame:
    """The extension families as a table (146 rows)."""
    rows = [(ext, category) for category, exts in D.EXTENSIONS.items() for ext in exts]
    return spark.createDataFrame(rows, "ext string, category string")
