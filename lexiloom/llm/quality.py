"""Quality rules with risk-controlled thresholds, in built-in functions only.

The measures of a text (symbols, repeated lines, repeated words, word length) share one path of
cutoffs, from loose to strict, so the good texts that a step rejects contain those of the step
before. Every stratum walks that path on its labelled texts, which nothing else learns from. A
step is taken only if the exact binomial probability of seeing so few rejected good texts, were
the rate of all measures together higher than ``RISK``, is below the error level; the first step
that is not proved ends the walk. Steps in a fixed order need no correction among themselves;
the error level is divided by the number of strata. The last proved step gives a stratum's
thresholds; where not even the first is proved, the measures reject nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.llm.tables import only_ids, query, small, table
from lexiloom.session import cut_lineage

#: Largest rate of good texts the thresholds of a stratum may reject together, and the error level over all strata.
RISK, LEVEL = 0.04, 0.05
#: Steps from loose to strict (a text above any value of a step is rejected by it).
MEASURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
STEPS = (
    (2.0, 0.9, 0.48, 14.0),
    (1.0, 0.8, 0.45, 12.0),
    (0.5, 0.7, 0.4, 11.0),
    (0.3, 0.6, 0.35, 10.0),
    (0.2, 0.5, 0.3, 9.0),
    (0.1, 0.4, 0.25, 8.0),
    (0.05, 0.3, 0.2, 7.0),
)
_SPACES = " \t\n\x0b\x0c\r"
_WORDS = r"[^\x20\x09-\x0D]+"


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    The windows of a text are hashed and sorted with their places; equal neighbours mark
    repeats, and the places covered by marked windows are counted from their gaps. Sorting
    keeps the cost near linear in the length of a text.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(
        F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")
    ))

    def covered(found: Column) -> Column:
        n = F.size(found)
        repeated = F.filter(
            F.transform(found, lambda x, k: F.when(
                (F.get(found, k - 1)["h"] == x["h"]) | (F.get(found, k + 1)["h"] == x["h"]), x["i"]
            )), lambda p: p.isNotNull(),
        )

        def gaps(places: Column) -> Column:
            return F.aggregate(
                places, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
                lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
                lambda s: s["n"],
            )

        return F.when(n > 0, gaps(F.sort_array(repeated))).otherwise(0)

    # transform over one element binds the sorted windows once.
    held = F.element_at(F.transform(F.array(F.sort_array(windows)), covered), 1)
    return F.when(F.size(words) >= 3, held).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum`` and the measures of every whole text; a null text measures nothing.

    The rows are written, as a filter on them would otherwise repeat the measuring per column.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("stratum"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.struct(F.regexp_extract_all(text, F.lit(_WORDS), 0).alias("ws")).alias("held"),
    )
    counted = rows.select("*", F.size("held.ws").cast("long").alias("n_words"), n_repeat_words(F.col("held.ws")).alias("n_repeat_words")).drop("held")
    words = F.greatest("n_words", F.lit(1))
    return cut_lineage(counted.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }))


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 9, brought down again."""
    z = x + 9.0
    down = F.log((x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0)) + F.log((x + 5.0) * (x + 6.0) * (x + 7.0) * (x + 8.0))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + 0.918938533204672742 + series - down


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial with n trials, summed downwards from k.

    Counts further than ten times the root of n from the mean weigh less than a double can
    show, so the number of terms grows with that root and not with k.
    """
    wide = F.ceil(10 * F.sqrt(n)).cast("long") + 1
    start = F.least(k, F.floor(n * rate).cast("long") + wide)
    first = (
        log_factorial(n) - log_factorial(start) - log_factorial(n - start)
        + start * F.log(F.lit(rate)) + (n - start) * F.log(F.lit(1 - rate))
    )
    # Terms from the top down, each with the running sum in units of the first.
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (i / (n - i + 1.0) * ((1 - rate) / rate))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    down = F.when(start >= 1, F.sequence(start, F.greatest(F.lit(1).cast("long"), start - 2 * wide), F.lit(-1).cast("long")))
    total = F.aggregate(F.coalesce(down, F.array().cast("array<bigint>")), state, step, lambda s: s["total"])
    return F.least(F.lit(1.0), F.exp(first + F.log(total)))


def _over(cutoffs: tuple[float, ...]) -> Column:
    hits = [F.col(name) > F.lit(value) for name, value in zip(MEASURES, cutoffs)]
    return hits[0] | hits[1] | hits[2] | hits[3]


def thresholds(rows: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``stratum, n_good, step, step_rejected`` and a limit per measure, for strata with good labelled texts.

    ``rows`` are :func:`measured` texts. Good texts are those labelled with quality 1 that the
    base rules pass; an id labelled both ways is good, equal rows of one id count once. ``step``
    is the number of steps proved; with none, it is 0 and the limits are null. ``step_rejected``
    counts the good texts each step of the path rejects. One aggregate counts all steps.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    known = only_ids(rows.where("not base_failed").select("doc_id", "stratum", *MEASURES), good).distinct()
    counts = cut_lineage(known.groupBy("stratum").agg(
        F.count("*").alias("n_good"), F.array(*(F.count_if(_over(cutoffs)) for cutoffs in STEPS)).alias("step_rejected"),
    ))
    allowed = level / max(1, counts.count())
    # Above the risk itself no count can prove it, so nothing is summed there.
    unproved = F.transform("step_rejected", lambda k: F.when(
        k <= F.col("n_good") * risk, binomial_tail(k, F.col("n_good"), risk) > allowed
    ).otherwise(True))
    walked = counts.withColumn("step", (F.array_position(F.concat(unproved, F.array(F.lit(True))), True) - 1).cast("int"))
    limits = (F.get(F.array(*(F.lit(s[i]) for s in STEPS)), F.col("step") - 1).alias(f"limit_{m}") for i, m in enumerate(MEASURES))
    return walked.select("stratum", "n_good", "step", "step_rejected", *limits)


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Measures of every document with ``base_failed``, ``rejected_by`` and ``kept``.

    A null text has no words and fails the base rules. Documents without a language are a
    stratum of their own; a stratum without enough labelled texts rejects by the base rules
    only. A value equal to a threshold passes. Repeated rows are judged alike. The thresholds,
    one row a stratum that labelled texts show, are broadcast when counted and few.
    """
    rows = measured(docs)
    limits = cut_lineage(thresholds(rows, labels, risk, level)).drop("n_good", "step", "step_rejected")
    over = F.array_compact(F.array(*(F.when(F.col(m) > F.col(f"limit_{m}"), F.lit(m)) for m in MEASURES)))
    return rows.join(small(limits), "stratum", "left").withColumn("rejected_by", over).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)
    )


_ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), g AS (
  SELECT r, u.i AS i, u.k AS k FROM (
    SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'k': [ws[i], ws[i + 1], ws[i + 2]]}})) AS u FROM w)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY r
), counted AS (
  SELECT r, doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(ls) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (r)
), m AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS symbol_rate, n_dup_lines / greatest(n_lines, 1) AS dup_line_rate,
    n_repeat_words / greatest(n_words, 1) AS repeat_rate, word_chars / greatest(n_words, 1) AS word_length FROM counted
), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1
), known AS (
  SELECT DISTINCT doc_id, stratum, {", ".join(MEASURES)} FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)
), steps(step, {", ".join(f"l_{m}" for m in MEASURES)}) AS (
  VALUES {", ".join(f"({i + 1}, {', '.join(f'{v}::DOUBLE' for v in s)})" for i, s in enumerate(STEPS))}
), tried AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER ({" OR ".join(f"{m} > l_{m}" for m in MEASURES)}) AS k
  FROM known, steps GROUP BY stratum, step
), proved AS (
  SELECT stratum, step, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {LEVEL} / (SELECT count(DISTINCT stratum) FROM known) AS ok FROM tried
), walked AS (
  SELECT stratum, max(step) AS step FROM (
    SELECT stratum, step, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM proved) WHERE ok GROUP BY stratum
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({" OR ".join(f"{m} > l_{m}" for m in MEASURES)}, false) AS kept
FROM m LEFT JOIN walked USING (stratum) LEFT JOIN steps USING (step)
"""


@query("op6_quality_rules", _ORACLE)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
