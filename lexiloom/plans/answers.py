"""Answer normalisation over a table of raw model outputs, one row per question batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiloom import dimensions as D
from lexiloom.functions.answers import override_overload, parse_salvage, parse_strict, validated
from lexiloom.functions.vectors import let


def normalised_batches(outputs: DataFrame, salvage: bool = False) -> DataFrame:
    """Parse, pad, validate and overload-check each output (``raw, n_questions``)."""
    parse = parse_salvage if salvage else parse_strict
    n = F.col("n_questions")
    clean = let(validated(parse(F.col("raw"), n)), lambda answers: override_overload(answers, n))
    return outputs.withColumn("answers", clean)


def concatenated(batches: DataFrame, request_id: str = "request_id", size: int = D.MAX_QUESTIONS_PER_BATCH) -> DataFrame:
    """Answers of all batches in question order, one row per answer.

    A batch's place gives its questions' numbers, so nothing is gathered per request. The
    outer form keeps the optimizer from parsing every output once more to test its size.
    """
    rows = batches.select(request_id, "batch_no", F.posexplode_outer("answers").alias("pos", "answer"))
    return rows.where(F.col("pos").isNotNull()).select(
        request_id,
        ((F.col("batch_no") - 1) * size + F.col("pos") + 1).cast("long").alias("question_no"),
        "answer",
    )


def complete_answers(questions: DataFrame, answers: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Exactly one answer per asked question; a missing one is an error message."""
    return questions.select(request_id, "question_no").join(answers, [request_id, "question_no"], "left").withColumn(
        "answer", F.coalesce("answer", F.lit(D.MSG_MISSING))
    )
