"""Chat formatting by schema fingerprints.

Records come in many layouts: lists of messages, prompt and completion, instruction, input and
output. A record's fingerprint is the hash of the nested field paths it fills; it selects a
declarative mapping that turns the record into canonical turns. Canonical turns are written
with a template whose marks cannot occur inside a text: control characters of the template are
escaped, reversibly. All of it is column expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from lexiloom.llm.tables import query, table

END = "</turn>\n"


@dataclass(frozen=True)
class ListOf:
    """Turns are the elements of a list of records; paths as in fingerprints, ``text`` may name parts of a list."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Fields:
    """Turns are single fields, in order: (role, paths joined by an empty line)."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]


#: Field paths of a layout and how its turns are read.
MAPPINGS: dict[tuple[str, ...], ListOf | Fields] = {
    ("messages[].content", "messages[].role"): ListOf("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): ListOf("conversations", "from", "value"),
    ("messages[].content[].text", "messages[].role"): ListOf("messages", "role", "content[].text"),
    ("data.messages[].content", "data.messages[].role"): ListOf("data.messages", "role", "content"),
    ("data.messages[].content[].text", "data.messages[].role"): ListOf("data.messages", "role", "content[].text"),
    ("completion", "prompt"): Fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    ("prompt", "response"): Fields((("user", ("prompt",)), ("assistant", ("response",)))),
    ("prompt", "response", "system"): Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    ("instruction", "output"): Fields((("user", ("instruction",)), ("assistant", ("output",)))),
    ("input", "instruction", "output"): Fields((("user", ("instruction", "input")), ("assistant", ("output",)))),
}
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _nested(kind: DataType) -> list[tuple[str, Callable[[Column], Column]]]:
    """Paths below a value of this type, each with the test that a value fills it, at any depth."""
    if isinstance(kind, StructType):
        return [(f".{f.name}{below}", _field_test(f.name, test)) for f in kind.fields for below, test in _nested(f.dataType)]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return [(f"[]{below}", _element_test(test)) for below, test in _nested(kind.elementType)]
    return [("", Column.isNotNull)]


def _field_test(name: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda record: test(record.getField(name))


def _element_test(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda items: F.exists(items, lambda x: test(x))


def filled_paths(schema: StructType) -> list[tuple[str, Column]]:
    """Every field path of a schema (``data.messages[].content[].text``) with the condition that a record fills it."""
    return [
        (field.name + below, test(F.col(f"`{field.name}`"))) for field in schema.fields for below, test in _nested(field.dataType)
    ]


def _at(value: Column, path: str) -> Column:
    """The text at ``path`` below ``value``; the parts of a list are joined, null parts left out."""
    name, _, rest = path.partition(".")
    inner = value.getField(name.removesuffix("[]"))
    if name.endswith("[]"):
        return F.array_join(F.transform(inner, lambda x: _at(x, rest) if rest else x), "")
    return _at(inner, rest) if rest else inner


def _top(path: str) -> Column:
    """The value at ``path`` of a record."""
    name, _, rest = path.partition(".")
    return _at(F.col(f"`{name}`"), rest) if rest else F.col(f"`{name}`")


def _list_turns(mapping: ListOf) -> Column:
    return F.transform(_top(mapping.path), lambda m: _turn(_canonical_role(_at(m, mapping.role)), _at(m, mapping.text)))


def schema_fingerprint(schema: StructType, among: set[str]) -> Column:
    """Hash of the sorted paths (of those any mapping knows) that a record fills."""
    paths = sorted((p, c) for p, c in filled_paths(schema) if p in among) if among else []
    names = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in sorted(paths, key=lambda x: x[0]))) if paths else F.array()
    return F.sha2(F.array_join(F.array_compact(names.cast("array<string>")), "\n").cast("binary"), 256)


def _canonical_role(role: Column) -> Column:
    known = F.lower(role)
    out = role
    for name, canonical in ROLES.items():
        out = F.when(known == name, F.lit(canonical)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_turns(records: DataFrame, mappings: dict = MAPPINGS) -> DataFrame:
    """``records`` with ``fingerprint`` and ``turns`` (role, text); columns of these names are replaced.

    A null text is empty, a null role too. A record no mapping fits has no turns (null); extra
    columns do not count for the fingerprint unless a mapping knows their path.
    """
    records = records.drop("fingerprint", "turns")
    present = {p for p, _ in filled_paths(records.schema)}
    among = {p for paths in mappings for p in paths}
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    mark = F.col("fingerprint")
    for paths, mapping in mappings.items():
        if not set(paths) <= present:
            continue
        if isinstance(mapping, ListOf):
            made = _list_turns(mapping)
        else:
            made = F.array(*(
                _turn(F.lit(role), F.concat_ws("\n\n", *(_top(n) for n in names))) for role, names in mapping.turns
            ))
        turns = F.when(mark == fingerprint_of(paths), made).otherwise(turns)
    return records.withColumn("fingerprint", schema_fingerprint(records.schema, among)).withColumn("turns", turns)


def escape(text: Column) -> Column:
    """Replace the template's control characters; a backslash only ever stands before b, h, l or c."""
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(turns: Column) -> Column:
    """``### role: text</turn>`` lines."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("### "), escape(t["role"]), F.lit(": "), escape(t["text"]), F.lit(END)
    )), "")


def _running_sums(numbers: Column) -> Column:
    """Sums up to every element, in one walk.

    Nothing but the walk's own variables stands in the lambda: what stands there is evaluated
    again for every element.
    """
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(numbers, start, lambda held, x: F.struct(
        (held["sum"] + x).alias("sum"), F.concat(held["sums"], F.array(held["sum"] + x)).alias("sums")
    ), lambda held: held["sums"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, with the span of each text (``start`` from 1, ``length``)."""
    lines = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    ends = _running_sums(F.transform(lines, lambda x: F.length(x) + len(END)))
    turns = F.zip_with(lines, ends, lambda x, end: F.struct(
        unescape(F.regexp_extract(x, r"(?s)^### (.*?): ", 1)).alias("role"),
        unescape(F.regexp_replace(x, r"(?s)^### .*?: ", "")).alias("text"),
        (end - len(END) - F.length(F.regexp_replace(x, r"(?s)^### .*?: ", "")) + 1).alias("start"),
        F.length(F.regexp_replace(x, r"(?s)^### .*?: ", "")).alias("length"),
    ))
    return F.when(F.size(lines) > 0, turns).otherwise(F.array().cast("array<struct<role:string,text:string,start:int,length:int>>"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns, formatted, loss_spans`` of conversations given row by row.

    Rows of a conversation are ordered by turn, then role and text; a null text is empty, a
    null role too; repeated rows are turns of their own. Rows with a null ``conv_id`` are one
    conversation. ``loss_spans`` mark the assistant texts in ``formatted``. Further columns
    are not read; an empty table gives no rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    records = rows.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")
    )
    made = canonical_turns(records).withColumn("formatted", format_turns(F.col("turns")))
    return made.withColumn("read", read_turns(F.col("formatted"))).select(
        "conv_id", F.transform("read", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), "formatted",
        F.transform(F.filter("read", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


_ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 14 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query("op4_chat_formatting", _ORACLE)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], given.schema)
    made = format_conversations(given.union(control))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"], s["length"]))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
