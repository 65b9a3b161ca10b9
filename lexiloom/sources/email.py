"""Mail corpus: one row per ``.eml`` file, parsed partition by partition."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email.parser import HeaderParser
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom import dimensions as D
from lexiloom.functions.scalars import default_to
from lexiloom.schemas import EMAIL


class _TextNodes(HTMLParser):
    """Collects the stripped text nodes of a page, without script and style bodies."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.nodes.append(data.strip())


def _page_text(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.nodes)


def _record(path: str, content: bytes) -> dict:
    """Header values (None where missing), body text and attachments of one message."""
    message = email.message_from_bytes(content)
    headers = HeaderParser().parsestr(content.decode("utf-8", "ignore"))
    leaves = [p for p in message.walk() if p.get_content_maintype() != "multipart"]
    bodies, attachments = [], []
    for part in leaves:
        kind = part.get_content_type()
        if "attachment" in str(part.get("Content-Disposition", "")).lower():
            if part.get_filename():
                attachments.append({"filename": part.get_filename(), "content_type": kind})
            continue
        if kind not in ("text/plain", "text/html"):
            continue
        payload = part.get_payload(decode=True)
        if not payload:
            continue
        try:
            text = payload.decode(part.get_content_charset() or "utf-8", "ignore")
        except LookupError:  # unknown character set: the part has no readable text
            continue
        bodies.append(text if kind == "text/plain" else _page_text(text))
    name = path.rsplit("/", 1)[-1]

    def header(key: str) -> str | None:
        return headers.get(key)

    return {
        "path": path, "stem": name.rsplit(".", 1)[0], "subject": header("subject"), "sender": header("from"),
        "recipient": header("to"), "date": header("date"), "content_type": message.get_content_type(),
        "has_attachments": any(p.get("Content-Disposition") is not None for p in leaves),
        "body": "\n\n".join(bodies), "attachments": attachments, "error": None,
    }


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows.append(_record(path, bytes(content)))
            except Exception as failure:  # one bad message is a row with an error, not a failed job
                rows.append({**dict.fromkeys(EMAIL.names), "path": path, "error": str(failure)})
        yield pd.DataFrame(rows, columns=EMAIL.names)


def parse_messages(messages: DataFrame) -> DataFrame:
    """Messages ``path, content`` to typed rows; missing headers get their defaults."""
    parsed = messages.select("path", "content").mapInPandas(_parse, EMAIL)
    headers = {"subject": "subject", "sender": "from", "recipient": "to", "date": "date"}
    return parsed.withColumns({c: default_to(F.col(c), D.EMAIL_DEFAULTS[h]) for c, h in headers.items()})


def read_emails(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true")
    return parse_messages(files.load(path))


def email_markdown() -> Column:
    """Markdown of an email row: heading, headers, then body and attachments where present."""
    lines = F.transform(
        "attachments", lambda a: F.concat(F.lit("- "), a.filename, F.lit(" ("), a.content_type, F.lit(")"))
    )
    headers = F.concat_ws(
        "\n",
        F.concat(F.lit("Subject: "), "subject"), F.concat(F.lit("From: "), "sender"),
        F.concat(F.lit("To: "), "recipient"), F.concat(F.lit("Date: "), "date"),
        F.concat(F.lit("Content-Type: "), "content_type"), F.lit(""),
    )
    body = F.when(F.col("body") != "", F.concat(F.lit("BODY:\n"), "body", F.lit("\n")))
    attached = F.when(F.size("attachments") > 0, F.concat(F.lit("ATTACHMENTS:\n"), F.array_join(lines, "\n")))
    return F.concat(F.lit("# Email: "), "stem", F.lit("\n\n"), F.concat_ws("\n", headers, body, attached))


def email_documents(emails: DataFrame) -> DataFrame:
    """Parsed emails as documents ready for chunking."""
    return emails.where(F.col("error").isNull()).select(
        F.col("path").alias("url"), email_markdown().alias("text"),
        F.create_map(F.lit("content_type"), F.col("content_type")).alias("metadata"),
    )
