"""Normalising raw model outputs into answer lists, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lexiloom import dimensions as D
from lexiloom.functions.scalars import pad_to, repeat_message, strip
from lexiloom.functions.vectors import let

_FENCE = "```"
# Quoted strings in which only a backslashed quote does not end the string. The quantifiers
# are possessive: they run in a loop, where greedy ones recurse once per escape and would
# overflow the executor's stack on a long answer.
COMPLETE_STRING = r'"([^"\\]*+(?:\\++[^\\][^"\\]*+)*+)"'
# Fixed value: a comma that stands right before a closing bracket.
TRAILING_COMMA = r",(\s*[}\]])"
PLAIN_STRING = r'"([^"]*)"'


def _last_index(text: Column, part: str) -> Column:
    """1-based start of the last occurrence of ``part`` (a run of one character)."""
    back = F.locate(part, F.reverse(text))
    return F.when(back > 0, F.length(text) - back - (len(part) - 2)).otherwise(0)


def strip_fence(text: Column) -> Column:
    """Content between the first and the last code fence of a text that starts with one."""
    last = _last_index(text, _FENCE)
    inner = F.substr(text, F.lit(1), last - 1)
    body = F.when(inner.startswith(_FENCE + "json"), F.substr(inner, F.lit(8))).otherwise(F.substr(inner, F.lit(4)))
    return F.when(text.startswith(_FENCE) & (last > 1), strip(body)).otherwise(text)


def parsed(text: Column) -> Column:
    """The text as a VARIANT inside a one-element array, NULL unless it is exactly one JSON value."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_variant_get(boxed, "$[0]", "variant").isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(one, boxed)


def _field(boxed: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(boxed, f"$[0]{path}", kind)


def _has(boxed: Column, path: str) -> Column:
    return _field(boxed, path, "variant").isNotNull()


def _is_object(boxed: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(_field(boxed, "", "variant")), F.lit("OBJECT")), F.lit(False))


def parse_strict(raw: Column, n: Column) -> Column:
    """Exactly ``n`` answers of a JSON text: ``answers``, else ``answer``, else a list, else the value as text."""

    def read(boxed: Column) -> Column:
        whole = F.array(_field(boxed, "", "string"))
        answers = (
            F.when(_is_object(boxed) & _has(boxed, ".answers"), _field(boxed, ".answers", "array<string>"))
            .when(_is_object(boxed) & _has(boxed, ".answer"), F.array(_field(boxed, ".answer", "string")))
            .when(_is_object(boxed), whole)
            .when(boxed.isNotNull(), F.coalesce(_field(boxed, "", "array<string>"), whole))
        )
        return F.coalesce(pad_to(answers, n, D.MSG_NO_ANSWER), repeat_message(D.MSG_JSON_FAILED, n))

    return let(parsed(strip_fence(strip(F.coalesce(raw, F.lit(""))))), read)


def _first_index(text: Column, part: str) -> Column:
    return F.locate(part, text)


def _truncated(text: Column, n: Column) -> Column:
    """Complete strings of an answers array that was cut off; NULL if there is no such array."""
    from_key = F.substr(text, _first_index(text, '"answers"'))
    section = F.substr(from_key, _first_index(from_key, "[") + 1)
    found = F.transform(
        F.regexp_extract_all(section, F.lit(COMPLETE_STRING), 1), lambda s: F.replace(s, F.lit('\\"'), F.lit('"'))
    )
    applies = (
        text.startswith("{") & ~text.endswith("}")
        & (_first_index(text, '"answers"') > 0) & (_first_index(from_key, "[") > 0)
    )
    return F.when(applies, pad_to(found, n, D.MSG_INCOMPLETE))


def _object_answers(boxed: Column, n: Column) -> Column:
    return F.when(_is_object(boxed), pad_to(_field(boxed, ".answers", "array<string>"), n, D.MSG_NO_ANSWER))


def _whole(text: Column, n: Column) -> Column:
    """``answers`` padded to ``n``, or a lone ``answer`` as it is."""

    def read(boxed: Column) -> Column:
        single = F.when(
            _is_object(boxed) & ~_has(boxed, ".answers") & _has(boxed, ".answer"),
            F.array(_field(boxed, ".answer", "string")),
        )
        return F.coalesce(_object_answers(boxed, n), single)

    return F.when(text.startswith("{") & text.endswith("}"), let(parsed(text), read))


def _without_trailing_commas(text: Column, n: Column) -> Column:
    fixed = F.regexp_replace(text, TRAILING_COMMA, "$1")
    return F.when(
        text.startswith("{") & text.endswith("}") & parsed(text).isNull(),
        let(parsed(fixed), lambda boxed: _object_answers(boxed, n)),
    )


def _embedded(text: Column, n: Column) -> Column:
    """The object between the first opening and the last closing brace."""
    start, end = _first_index(text, "{"), _last_index(text, "}")
    inside = F.substr(text, start, end - start + 1)
    return F.when((start > 0) & (end > start), let(parsed(inside), lambda boxed: _object_answers(boxed, n)))


def plausible_strings(text: Column) -> Column:
    """Quoted strings that are no field names and longer than ten characters."""
    return F.filter(
        F.regexp_extract_all(text, F.lit(PLAIN_STRING), 1),
        lambda s: ~s.isin("answers", "answer") & (F.length(s) > 10),
    )


def _quoted(text: Column, n: Column) -> Column:
    return let(plausible_strings(text), lambda found: F.when(F.size(found) > 0, pad_to(found, n, D.MSG_EXTRACTED)))


def parse_salvage(raw: Column, n: Column) -> Column:
    """Answers of a possibly damaged output; the first stage that yields a list wins."""

    def ladder(text: Column) -> Column:
        return F.coalesce(
            _truncated(text, n),
            _whole(text, n),
            _without_trailing_commas(text, n),
            _embedded(text, n),
            _quoted(text, n),
            repeat_message(D.MSG_INVALID, n),
        )

    return let(strip(strip_fence(strip(F.coalesce(raw, F.lit(""))))), ladder)


def wrap_single(raw: Column) -> Column:
    """A JSON object with ``answer`` stays; anything else becomes ``{"answer": text}``."""

    def wrap(text: Column) -> Column:
        fine = text.startswith("{") & text.endswith("}") & let(
            parsed(text), lambda b: _is_object(b) & _has(b, ".answer")
        )
        return F.when(F.coalesce(fine, F.lit(False)), text).otherwise(F.to_json(F.struct(text.alias("answer"))))

    return let(strip_fence(strip(F.coalesce(raw, F.lit("")))), wrap)


def unwrap_envelope(raw: Column) -> Column:
    """``answers`` of an envelope, else its ``answer``, else the text itself."""
    return let(
        parsed(raw),
        lambda b: F.coalesce(
            F.when(_is_object(b), _field(b, ".answers", "array<string>")),
            F.when(_is_object(b) & _has(b, ".answer"), F.array(_field(b, ".answer", "string"))),
            F.array(raw),
        ),
    )


def validated(answers: Column) -> Column:
    """Trimmed answers; blank and missing ones become an error message."""
    return F.transform(
        answers,
        lambda a: F.when(strip(F.coalesce(a, F.lit(""))) == "", F.lit(D.MSG_EMPTY_ANSWER)).otherwise(strip(a)),
    )


def violates(answers: Column) -> Column:
    """True for a missing or empty answer list, which a valid record must not have."""
    return F.coalesce(F.size(answers), F.lit(0)) < 1


def answers_json(answers: Column) -> Column:
    return F.to_json(F.struct(answers.alias("answers")))


def _any(answers: Column, test) -> Column:
    return F.coalesce(F.exists(answers, lambda a: F.coalesce(test(a), F.lit(False))), F.lit(False))


def has_error(answers: Column) -> Column:
    """Any answer holds ``Error:`` (case-sensitive)."""
    return _any(answers, lambda a: F.contains(a, F.lit("Error:")))


def is_overloaded(answers: Column) -> Column:
    return _any(
        answers,
        lambda a: F.contains(a, F.lit("503"))
        | F.contains(F.lower(a), F.lit("overload"))
        | F.contains(F.lower(a), F.lit("unavailable")),
    )


def override_overload(answers: Column, n: Column) -> Column:
    return F.when(is_overloaded(answers), repeat_message(D.MSG_OVERLOADED, n)).otherwise(answers)


def is_unavailable(answers: Column) -> Column:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in D.UNAVAILABLE_PATTERNS)
    return _any(answers, lambda a: F.rlike(a, F.lit(pattern)))


def is_denied(answers: Column) -> Column:
    """A non-empty list whose every answer reports that access was refused."""
    every = F.forall(answers, lambda a: F.coalesce(F.contains(a, F.lit(D.MSG_DENIED)), F.lit(False)))
    return F.coalesce((F.size(answers) > 0) & every, F.lit(False))


def denied_answer(url: Column) -> Column:
    return F.array(F.concat(F.lit("Error: "), url, F.lit(" is not accessable")))


def mentions_any(message: Column, words: tuple[str, ...]) -> Column:
    """Lower-case substring test of an error message against a few fixed words."""
    tests = [F.contains(F.lower(message), F.lit(w)) for w in words]
    return F.coalesce(reduce(lambda x, y: x | y, tests), F.lit(False))


def json_field(body: Column, path: str) -> Column:
    """A nested field, else a plain JSON string, else the whole JSON, else the unquoted text."""

    def read(boxed: Column) -> Column:
        return F.coalesce(
            F.when(_is_object(boxed), _field(boxed, path, "string")),
            _field(boxed, "", "string"),
            F.btrim(strip(body), F.lit('"')),
        )

    return let(parsed(body), read)
