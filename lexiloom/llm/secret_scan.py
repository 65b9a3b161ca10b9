"""Secret scans with a random forest that removes false findings, in built-in functions only.

Candidates are words of eight or more characters that hold a digit or follow a secret's name,
found in every whole text; typographic marks around them are no part of them. Each is described by its
length, its changes between letter classes, how much of it dictionary words cover, its path
(the source it stands in, and separators inside it) and the words around it. A forest trained
on labelled findings tells secrets from numbers, hashes, addresses and names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiloom.llm.tables import hash_draw, held_out, query, table
from lexiloom.session import cut_lineage

#: Labelled findings the forest is trained on (the documented bound of the sample).
TRAIN_FINDINGS = 20_000
#: Most frequent words of all documents that count as the dictionary; bounds its broadcast.
DICTIONARY = 20_000
TREES, DEPTH = 30, 6
THRESHOLD = 0.5

_SPLIT = r"[\x20\x09-\x0D]+"
#: Characters that a candidate has at least.
LEAST_LENGTH = 8
#: A sign beyond ASCII that is no letter, digit or part of a letter, such as a typographic quote.
_MARK = r"[^\x00-\x7F\p{L}\p{M}\p{N}]"
#: Marks ahead of a word, and behind it read backwards, with the ASCII quotes, brackets and stops
#: outside them; loops over one class only, which long words of marks do not slow down.
_MARKS_AHEAD = rf"^[{_MARK}\"'(\[{{<]*{_MARK}"
_MARKS_BEHIND = rf"^[{_MARK}\"')\]}}>.,:;!?]*{_MARK}"
#: The name inside a word, with the sign after it (in quotes as in JSON, too).
_INLINE = r"^[\"'`{(\[<,]*([A-Za-z_.\-]{2,40})[\"'`]?[=:]"
#: Names that announce a secret, and names that announce something public (fixed values).
SECRET_NAMES = r"(?i)pass(word|wd|phrase)?|secret|token|api|key|auth|credential|login"
#: A secret's name that is a word of its own within the name (not ``author`` or ``keywords``).
WHOLE_NAMES = (
    r"(?i:(?<![a-z])(?:user|db|my|api|access|private|client|auth|secret)?(?:pass(?:word|wd|phrase)?|secret|token|api|key|auth|credential|login)s?(?![a-z]))"
    r"|(?<=[a-z])(?:Pass(?:word|wd|phrase)?|Secret|Token|Key|Credential)s?(?![a-z])"
)
PUBLIC_NAMES = r"(?i)sha|md5|commit|hash|uuid|id|version|phone|tel|card|ip|mail|order"

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "other_share", "change_rate", "distinct_share", "coverage",
    "assigned", "name_secret", "before_secret", "after_secret", "before_public", "dots", "slashes", "source_bin", "before_colon",
    "name_whole",
)


def _bare(word: Column) -> Column:
    """``word`` without the typographic marks at its ends; a word of marks only stays."""
    bare = F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(word, _MARKS_AHEAD, "")), _MARKS_BEHIND, ""))
    return F.when(bare == "", word).otherwise(bare)


def _name(word: Column, before: Column, ahead: Column) -> Column:
    """The name inside the word, before a separate sign, or before the sign that ends the word before."""
    inline = F.regexp_extract(word, _INLINE, 1)
    return (
        F.when(inline != "", inline).when(before.isin("=", ":", "=>", ":="), ahead)
        .when(before.rlike("[=:]$"), F.regexp_replace(before, "[=:]+$", "")).otherwise(F.lit(""))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, source, place, word, ahead, before, after`` of every candidate of every text.

    A word is taken whole however long it is. Places count words from 0. A word without a digit
    is a candidate where its name or the word before it holds a secret's name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.split(F.coalesce("text", F.lit("")), _SPLIT, -1).alias("ws"))
    near = lambda i: F.coalesce(F.get("ws", i), F.lit(""))
    # Few words pass the first test, so that the marks and names of the others are not looked at.
    long = F.filter(F.transform("ws", lambda w, i: F.when(F.length(w) >= LEAST_LENGTH, i)), lambda i: i.isNotNull())
    places = F.filter(long, lambda i: near(i).rlike("[0-9]") | (
        near(i).rlike(SECRET_NAMES) | near(i - 1).rlike(SECRET_NAMES) | near(i - 2).rlike(SECRET_NAMES)
    ) & (_name(near(i), near(i - 1), near(i - 2)).rlike(SECRET_NAMES) | near(i - 1).rlike(SECRET_NAMES)))
    found = F.filter(F.transform(places, lambda i: F.struct(
        i.alias("place"), _bare(near(i)).alias("word"), near(i - 2).alias("ahead"), near(i - 1).alias("before"), near(i + 1).alias("after"),
    )), lambda c: F.length(c.word) >= LEAST_LENGTH)
    return rows.select("doc_id", "source", F.explode(found).alias("c")).select("doc_id", "source", "c.*")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """The most frequent letter-only words of at least three letters over all documents.

    At most ``size``: words at or above the least document count that so few words reach, so
    words of equal count are all in or all out. Only the words per count are ranked.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), _SPLIT, -1))).alias("word"))
    counted = cut_lineage(words.where(r"word rlike '^\\p{L}{3,32}$'").groupBy("word").agg(F.count("*").alias("n_docs")))
    ranked = counted.groupBy("n_docs").agg(F.count("*").alias("n_words")).withColumn(
        "reached", F.sum("n_words").over(Window.orderBy(F.col("n_docs").desc()))
    )
    least = ranked.where(F.col("reached") <= size).agg(F.min("n_docs")).first()[0]
    return counted.where(F.col("n_docs") >= least if least else F.lit(False)).select("word")


def _share(word: Column, pattern: str) -> Column:
    return (F.length(word) - F.length(F.regexp_replace(word, pattern, ""))) / F.length(word)


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the features of the forest; ``found`` gains no rows and loses none."""
    name = _name(F.col("word"), F.col("before"), F.col("ahead"))
    value = _bare(F.regexp_replace("word", _INLINE, ""))
    rows = cut_lineage(found.withColumns({"name": name, "value": F.when(value == "", F.col("word")).otherwise(value)}))
    value = F.col("value")
    runs = rows.select("value").distinct().withColumn("run", F.explode(F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{3,}"), 0)))
    covered = (
        runs.join(F.broadcast(words.withColumnRenamed("word", "run")), "run").groupBy("value")
        .agg(F.sum(F.length("run")).alias("covered"))
    )
    num = lambda condition: condition.cast("double")
    changes = F.size(F.regexp_extract_all(value, F.lit(r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"), 0))
    return rows.join(covered, "value", "left").withColumns({
        "length": F.least(F.length(value), F.lit(1000)).cast("double"),
        "digit_share": _share(value, "[0-9]"), "upper_share": _share(value, "[A-Z]"),
        "lower_share": _share(value, "[a-z]"), "other_share": _share(value, "[^0-9A-Za-z]"),
        "change_rate": changes / F.length(value),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "coverage": F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.length(value)),
        "assigned": num(F.col("name") != ""), "name_secret": num(F.col("name").rlike(SECRET_NAMES)),
        "name_whole": num(F.col("name").rlike(WHOLE_NAMES)),
        "before_secret": num(F.col("before").rlike(SECRET_NAMES)), "after_secret": num(F.col("after").rlike(SECRET_NAMES)),
        "before_public": num(F.col("before").rlike(PUBLIC_NAMES)),
        "dots": num(value.contains(".")), "slashes": num(value.contains("/")),
        "source_bin": F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(16)).cast("double"),
        "before_colon": num(F.col("before").rlike("[:=]$")),
    }).drop("covered")


def scored(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """``features`` with ``score``: the forest's share of votes that a candidate is a secret.

    ``labelled`` has the features and ``label`` (1 secret, 0 not; null teaches nothing). Where
    it holds one label only, that label is the score; where it is empty, the score is 0.
    """
    known = cut_lineage(
        hash_draw(labelled.where("label is not null"), ["value", "doc_id", "place"], TRAIN_FINDINGS)
        .select(*FEATURES, F.col("label").cast("double").alias("label"))
    )
    seen = sorted(r["label"] for r in known.select("label").distinct().limit(3).collect())
    if len(seen) < 2:
        return features.withColumn("score", F.lit(float(seen[0]) if seen else 0.0))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features_")
    forest = RandomForestClassifier(
        featuresCol="features_", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11, probabilityCol="probability_",
        rawPredictionCol="raw_", predictionCol="prediction_",
    ).fit(assembler.transform(known))
    judged = forest.transform(assembler.transform(features))
    return judged.withColumn("score", vector_to_array("probability_")[1]).drop("features_", "probability_", "raw_", "prediction_")


def format_labels(features: DataFrame) -> DataFrame:
    """Labels of findings whose format is beyond doubt; all others are null.

    Secrets: cloud access keys by their fixed prefix and length, values assigned to a secret's
    name (without a digit only where that name is a word of its own). Not secrets: numbers, addresses, mail and web addresses, words covered by the dictionary.
    """
    word, value = F.col("word"), F.col("value")
    secret = value.rlike("^[\"']?AKIA[A-Z0-9]{16}[\"',.;]?$") | (
        (F.col("name_secret") == 1) & (F.length(value) >= LEAST_LENGTH) & (value.rlike("[0-9]") | (F.col("name_whole") == 1))
    )
    plain = (
        value.rlike(r"^[+(]?[0-9][0-9().,:/\-]*$") | word.rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}[.,;]?$") | word.rlike(r"^https?://")
        | (F.col("coverage") > 0.7) | (value.rlike(r"^[0-9a-f]{32,64}$") & (F.col("name") == ""))
    )
    return features.withColumn("label", F.when(secret, 1).when(plain, 0))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, place, word_sha256, length, score, is_secret`` of every candidate of every text.

    Learns from the candidates outside the held-out third whose format is beyond doubt, then
    scores all. Null and empty texts have no candidates; a null source is a source; repeated
    rows give repeated candidates; a score at the threshold is a secret. The word itself is
    only returned as a hash. Columns of other names are not read.
    """
    rows = cut_lineage(described(candidates(docs), cut_lineage(dictionary(docs))))
    judged = scored(rows, format_labels(rows).where(~held_out()))
    return judged.select(
        "doc_id", "place", F.sha2(F.col("value").cast("binary"), 256).alias("word_sha256"), F.length("value").cast("long").alias("length"),
        "score", (F.col("score") >= THRESHOLD).alias("is_secret"),
    )


@query("op7_secret_scans")
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
