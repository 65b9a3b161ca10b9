"""Sentence splitting and HTML-to-text, as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexiloom.functions.scalars import strip

_BOUNDARY = "\x01"


def sentences(text: Column) -> Column:
    """Sentences of a text in order; a text without any is an empty array.

    A sentence ends at ``.``, ``!`` or ``?`` followed by white space.
    """
    return F.filter(fragments(text), lambda s: s != "")


def fragments(text: Column) -> Column:
    """What stands between sentence boundaries, empty strings at the ends included."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1" + _BOUNDARY)
    return F.split(F.coalesce(marked, F.lit("")), _BOUNDARY)


# The named character references that are resolved, in this order.
ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
)


def html_to_text(html: Column) -> Column:
    """Text nodes of a page, each stripped, one per line; empty ones are dropped.

    Comments and the doctype are not text. Script and style bodies are left out.
    """
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", _BOUNDARY)
    body = F.regexp_replace(body, r"(?is)<script[^>]*>.*?</script>", _BOUNDARY)
    body = F.regexp_replace(body, r"(?is)<style[^>]*>.*?</style>", _BOUNDARY)
    # A tag boundary becomes \x01, so that a line break inside a text node survives.
    body = F.regexp_replace(body, r"<[^>]*>", _BOUNDARY)
    for name, character in ENTITIES:
        body = F.replace(body, F.lit(name), F.lit(character))
    nodes = F.transform(F.split(body, _BOUNDARY), strip)
    return F.array_join(F.filter(nodes, lambda n: n != ""), "\n")
