"""Block-list gate and block-list maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiloom.dimensions import BLOCK_MARKER
from lexiloom.operators.substring import any_term_in, bounded_terms, containments


def flag_blocked(
    urls: DataFrame, patterns: DataFrame, url: str = "url", key: str = "url", pattern: str = "pattern",
    markers: tuple[str, ...] = (BLOCK_MARKER,), enabled: bool = True, limit: int | None = None,
) -> DataFrame:
    """Add ``is_blocked``: the URL holds a block pattern or a marker, whatever the case.

    Equality and prefix tests are special cases of containment. ``key`` identifies a row
    of ``urls``. A short list is tested inside the row; a longer one is joined.
    """
    if not enabled:
        return urls.withColumn("is_blocked", F.lit(False))
    rows = bounded_terms(patterns, [pattern], **({} if limit is None else {"limit": limit}))
    if rows is not None:
        return urls.withColumn("is_blocked", any_term_in(F.col(url), [r[0] for r in rows] + list(markers)))
    listed = patterns.select(pattern).distinct().withColumn("term_id", F.col(pattern))
    hits = containments(urls.select(F.col(key).alias("__key"), F.col(url).alias("__url")).distinct(),
                        "__key", "__url", listed, "term_id", pattern).select("__key").distinct()
    marked = any_term_in(F.col(url), list(markers))
    joined = urls.join(hits.withColumn("__hit", F.lit(True)), urls[key] == hits["__key"], "left")
    return joined.withColumn("is_blocked", marked | F.col("__hit").isNotNull()).drop("__key", "__hit")


def blocked(urls: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    return flag_blocked(urls, patterns, **options).where("is_blocked").drop("is_blocked")


def allowed(urls: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    return flag_blocked(urls, patterns, **options).where("not is_blocked").drop("is_blocked")


def add_patterns(patterns: DataFrame, added: DataFrame) -> DataFrame:
    """Block list with new patterns; ones already listed are not repeated."""
    return patterns.select("pattern").union(added.select("pattern")).distinct()


def remove_patterns(patterns: DataFrame, removed: DataFrame) -> DataFrame:
    return patterns.join(removed.select("pattern").distinct(), "pattern", "left_anti")


def blocklist_status(patterns: DataFrame, enabled: bool = True) -> DataFrame:
    """``enabled`` and the number of patterns, as one row."""
    return patterns.agg(F.count(F.lit(1)).alias("blocked_urls_count")).select(
        F.lit(enabled).alias("enabled"), "blocked_urls_count"
    )


def blocklist_entries(patterns: DataFrame, enabled: bool = True) -> DataFrame:
    """The listed patterns, one per row; none while the gate is off."""
    return patterns.select("pattern").where(F.lit(enabled))
