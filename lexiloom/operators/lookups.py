"""Dictionary lookups: exact, fuzzy, first term in a text, default value, two-key fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.functions.vectors import let
from lexiloom.operators.substring import MAX_LITERAL_TERMS, bounded_terms, containments


def _entries(rows: list, lowered: int) -> Column:
    """Dictionary rows ``ord, key, value`` in dictionary order as an array literal.

    ``probe`` is the column to search by (1 key, 2 value), in lower case beforehand.
    """
    return F.array(*[
        F.struct(F.lower(F.lit(r[lowered])).alias("probe"), F.lit(r[2]).alias("value"))
        for r in sorted(rows, key=lambda r: (r[0], r[lowered], r[2] or "")) if r[lowered]
    ])


def _first(entries: Column, test) -> Column:
    return F.get(F.filter(entries, test), F.lit(0))["value"]


def fuzzy_lookup(
    rows: DataFrame, dictionary: DataFrame, key: str, name: str = "value", limit: int = MAX_LITERAL_TERMS
) -> DataFrame:
    """Add the dictionary value of ``key``: exact match ignoring case, else the first entry
    (in dictionary order) of which either string holds the other; NULL if there is none.

    ``dictionary`` has ``ord, key, value``. A short dictionary is looked up inside the
    row; a longer one by joins over the distinct keys.
    """
    dictionary = dictionary.where("key <> ''")
    known = bounded_terms(dictionary, ["ord", "key", "value"], limit)
    if known is not None:
        asked = F.nullif(F.lower(F.col(key)), F.lit(""))

        def find(entries: Column) -> Column:
            exact = _first(entries, lambda e: e.probe == asked)
            partial = _first(entries, lambda e: F.contains(e.probe, asked) | F.contains(asked, e.probe))
            return F.coalesce(exact, partial)

        return rows.withColumn(name, find(_entries(known, lowered=1)) if known else F.lit(None).cast("string"))
    wanted = rows.select(F.col(key).alias("asked")).where("asked <> ''").distinct()
    entries = dictionary.select(F.struct("ord", "key", F.coalesce("value", F.lit("")).alias("v")).alias("ord"), F.col("key").alias("entry"), "value").distinct()
    exact = wanted.join(entries, F.lower("asked") == F.lower("entry")).groupBy("asked").agg(
        F.min_by("value", "ord").alias("exact")
    )
    within_entry = containments(entries.select("ord", "entry"), "ord", "entry", wanted.withColumn("term", F.col("asked")), "asked", "term")
    holds_entry = containments(wanted.withColumn("text", F.col("asked")), "asked", "text", entries, "ord", "entry")
    partial = (
        within_entry.select("asked", "ord").unionByName(holds_entry.select("asked", "ord"))
        .groupBy("asked").agg(F.min("ord").alias("ord")).join(entries.select("ord", F.col("value").alias("partial")), "ord")
    )
    found = wanted.join(exact, "asked", "left").join(partial.drop("ord"), "asked", "left").select(
        "asked", F.coalesce("exact", "partial").alias(name)
    )
    return rows.join(found.withColumnRenamed("asked", "__asked"), F.col(key) == F.col("__asked"), "left").drop("__asked")


def first_term(
    texts: DataFrame, dictionary: DataFrame, text: str, text_id: str, name: str = "value", limit: int = MAX_LITERAL_TERMS
) -> DataFrame:
    """Add the first dictionary value (in dictionary order) that occurs in the text."""
    dictionary = dictionary.where("value <> ''")
    known = bounded_terms(dictionary, ["ord", "key", "value"], limit)
    if known is not None:
        lowered = let(
            F.lower(F.col(text)),
            lambda t: _first(_entries(known, lowered=2), lambda e: F.contains(t, e.probe)),
        ) if known else F.lit(None).cast("string")
        return texts.withColumn(name, lowered)
    entries = dictionary.select(F.struct("ord", "value").alias("ord"), "value").distinct()
    hits = containments(texts.select(text_id, text), text_id, text, entries, "ord", "value")
    first = hits.groupBy(text_id).agg(F.min("ord").alias("ord")).join(entries, "ord").select(
        text_id, F.col("value").alias(name)
    )
    return texts.join(first, text_id, "left")


def default_lookup(rows: DataFrame, dictionary: DataFrame, key: str, default: str, name: str = "value") -> DataFrame:
    """Add the value of an equal key, or the default entry; of a repeated key the first in dictionary order.

    A dictionary without ``ord`` gives the least value. ``rows`` gain and lose no rows.
    """
    first = F.min_by("value", F.struct("ord", "value")) if "ord" in dictionary.columns else F.min("value")
    entries = dictionary.where("value IS NOT NULL").groupBy(F.col("key").alias(key)).agg(first.alias("__found"))
    return rows.join(entries, key, "left").withColumn(name, F.coalesce("__found", F.lit(default))).drop("__found")


def percent_decoded(text: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone; NULL for a malformed escape."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def status_lookup(asked: DataFrame, statuses: DataFrame, asked_id: str = "document_id", valid: tuple[str, ...] = ()) -> DataFrame:
    """Status of a document by its raw id, else by its URL-decoded id; unknown states are not found.

    Of several rows of a document the least status counts, an unprotected one first; ``asked``
    gains and loses no rows.
    """
    least = F.min(F.struct("status", "protected"))
    statuses = statuses.groupBy("document_id").agg(least.alias("__least")).select("document_id", "__least.*")
    raw = statuses.select(F.col("document_id").alias("__raw"), F.struct("status", "protected").alias("__by_raw"))
    decoded = statuses.select(F.col("document_id").alias("__dec"), F.struct("status", "protected").alias("__by_dec"))
    joined = asked.join(raw, asked[asked_id] == F.col("__raw"), "left").join(
        decoded, percent_decoded(asked[asked_id]) == F.col("__dec"), "left"
    )
    hit = F.coalesce("__by_raw", "__by_dec")
    result = joined.withColumn("__hit", hit).withColumn("found_id", F.coalesce("__raw", "__dec"))
    found = F.col("__hit.status").isin(*valid) if valid else F.col("__hit").isNotNull()
    return result.select(
        *[asked[c] for c in asked.columns],
        F.coalesce(found, F.lit(False)).alias("found"),
        F.when(found, F.col("found_id")).alias("found_id"),
        F.when(found, F.col("__hit.status")).alias("rag_status"),
        F.when(found, F.col("__hit.protected")).alias("cache_protected"),
    )
