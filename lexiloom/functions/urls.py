"""URL and path expressions. All are plain columns, evaluated in the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexiloom.functions.scalars import strip

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def _without_params(path: Column) -> Column:
    """Drop the ``;parameters`` of the last path segment."""
    return F.regexp_replace(path, r";[^/]*$", "")


def is_web_url(url: Column) -> Column:
    """Starts with ``http://`` or ``https://``; the test is case-sensitive."""
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def url_path(url: Column) -> Column:
    """Path part of a URL, without query, fragment and segment parameters."""
    cleaned = F.regexp_replace(url, r"[\t\r\n]", "")
    return _without_params(F.regexp_extract(cleaned, _AUTHORITY, 1))


def file_extension(url: Column) -> Column:
    """Last suffix of the file name in lower case, dot included; empty if there is none."""
    path = F.when(is_web_url(url), url_path(url)).otherwise(url)
    trimmed = F.regexp_replace(path, r"(/\.?)+$", "")
    return F.lower(F.regexp_extract(trimmed, r"[^/](\.[^./]+)$", 1))


def doc_basename(url: Column) -> Column:
    """Text after the last slash of the path (of the whole string if not http(s))."""
    web = F.lower(url).startswith("http://") | F.lower(url).startswith("https://")
    path = F.when(web, url_path(url)).otherwise(url)
    return F.substring_index(path, "/", -1)


def doc_hash(url: Column) -> Column:
    """Key of the document-level tables: md5 of the trimmed lower-case URL."""
    return F.md5(F.lower(strip(url)))


def document_key(url: Column) -> Column:
    """Identity of a document in the chunk table: md5 of the raw URL."""
    return F.md5(url)


def chunk_prefix(url: Column) -> Column:
    """Display form of a document's identity, first eight hex digits; not unique, so never a key."""
    return F.substring(F.md5(url), 1, 8)


def chunk_id(prefix: Column, ordinal: Column) -> Column:
    return F.concat(prefix, F.lit("_"), ordinal.cast("string"))


def is_pdf_path(url: Column) -> Column:
    return F.lower(url_path(url)).endswith(".pdf")


def is_pdf_url(url: Column) -> Column:
    """PDF test that needs no network: path suffix, else ``.pdf`` anywhere in the URL."""
    return is_pdf_path(url) | F.contains(F.lower(url), F.lit(".pdf"))


# Marker and export form of a shared online document.
SHARED_DOC_MARKER = "docs.google.com/document/d/"
SHARED_DOC_EXPORT = "https://docs.google.com/document/d/{}/export?format=docx"


def shared_doc_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"document/d/([\w-]+)", 1)
    return F.when(F.contains(url, F.lit(SHARED_DOC_MARKER)) & (found != ""), found)


def rewrite_shared_link(url: Column) -> Column:
    """Shared-document links become their export link; other URLs stay."""
    before, after = SHARED_DOC_EXPORT.split("{}")
    return F.coalesce(F.concat(F.lit(before), shared_doc_id(url), F.lit(after)), url)


# File names by a bare suffix and by part of the announced content type, first match wins.
SUFFIX_NAMES = {
    ".pdf": "data.pdf", ".docx": "data.docx", ".doc": "data.docx", ".pptx": "data.pptx", ".ppt": "data.pptx",
    ".xlsx": "data.xlsx", ".xls": "data.xlsx", ".eml": "data.eml", ".msg": "data.eml",
}
TYPE_NAMES = (
    ("pdf", "data.pdf"), ("wordprocessingml", "data.docx"), ("msword", "data.docx"), ("presentationml", "data.pptx"),
    ("mspowerpoint", "data.pptx"), ("spreadsheetml", "data.xlsx"), ("excel", "data.xlsx"),
)
# Part of the response's type, the suffixes it accepts, the name otherwise.
RESPONSE_NAMES = (
    ("application/vnd.openxmlformats", r"\.docx?$", "data.docx"),
    ("officedocument.wordprocessingml", r"\.docx?$", "data.docx"),
    ("officedocument.presentationml", r"\.pptx?$", "data.pptx"),
    ("officedocument.spreadsheetml", r"\.xlsx?$", "data.xlsx"),
    ("application/pdf", r"\.pdf$", "data.pdf"),
)
DEFAULT_NAME = "data.pdf"


def _first_contained(text: Column, table: tuple) -> Column:
    """The row of a table of literals whose first value occurs in the text; NULL without one."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(f"_{i}") for i, v in enumerate(row)]) for row in table])
    return F.get(F.filter(rows, lambda row: F.contains(text, row["_0"])), F.lit(0))


def requested_filename(url: Column, content_type: Column) -> Column:
    """File name to store a fetched URL under, before the response is seen.

    The URL's own suffix wins, then a bare suffix as the whole file name, then the
    announced content type, then ``data.pdf``. A shared document without an id has none.
    """
    ext = file_extension(url)
    bare = F.lower(F.substring_index(url_path(url), "/", -1))
    by_suffix = F.create_map(*[F.lit(v) for pair in SUFFIX_NAMES.items() for v in pair])
    by_type = _first_contained(F.lower(F.coalesce(content_type, F.lit(""))), TYPE_NAMES)["_1"]
    plain = F.coalesce(F.when(ext != "", F.concat(F.lit("data"), ext)), F.try_element_at(by_suffix, bare), by_type, F.lit(DEFAULT_NAME))
    shared = F.contains(url, F.lit(SHARED_DOC_MARKER))
    return F.when(shared, F.when(shared_doc_id(url).isNotNull(), "data.docx")).otherwise(plain)


def target_filename(url: Column, content_type: Column) -> Column:
    """File name after the response's content type has been taken into account."""
    name = requested_filename(url, content_type)
    told = _first_contained(F.lower(F.coalesce(content_type, F.lit(""))), RESPONSE_NAMES)
    return F.when(told.isNull() | F.regexp_like(name, told["_1"]), name).when(name.isNotNull(), told["_2"])
