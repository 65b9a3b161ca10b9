"""Small shared column helpers: trimming, padding, defaults, flags, dates, ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Unicode counts as white space, for a trim that ignores all of it.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def pad_to(items: Column, n: Column, message: str) -> Column:
    """Exactly ``n`` items: extra ones cut off, missing ones filled with ``message``."""
    filler = F.array_repeat(F.lit(message), F.greatest(n - F.size(items), F.lit(0)))
    return F.slice(F.concat(items, filler), F.lit(1), n)


def repeat_message(message: Column | str, n: Column) -> Column:
    """One message per question."""
    column = F.lit(message) if isinstance(message, str) else message
    return F.array_repeat(column, n)


def parse_flag(value: Column) -> Column:
    """``true``, ``1``, ``yes`` and ``on`` in any case are true, anything else is false."""
    return F.coalesce(F.lower(value).isin("true", "1", "yes", "on"), F.lit(False))


def or_today(day: Column) -> Column:
    """The given day as ``yyyy-MM-dd``, today where it is missing."""
    return F.date_format(F.coalesce(day.cast("date"), F.current_date()), "yyyy-MM-dd")


def round2(value: Column) -> Column:
    return F.round(value, 2)


def default_to(value: Column, default: str) -> Column:
    """The value, or a default where it is missing."""
    return F.coalesce(value, F.lit(default))


def unique_name(base: str, extension: str = "") -> Column:
    """``base_<8 random characters>_<epoch seconds><extension>``, one per row."""
    return F.concat(
        F.lit(base + "_"), F.substring(F.expr("uuid()"), 1, 8),
        F.lit("_"), F.unix_timestamp().cast("string"), F.lit(extension),
    )


def request_id() -> Column:
    return F.expr("uuid()")


def stable_name(base: str, key: Column) -> Column:
    """A repeatable name for a key, used where a rerun has to give the same one."""
    return F.concat(F.lit(base + "_"), F.md5(key))
