"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent between 0 (all alike) and 1 (as
found), normalised. The exponent is bisected to meet a target entropy of the weights or a
limit on how often a source's documents may repeat. The weights are realised as budgeted
block permutations: every source is a sequence of epochs, each a permutation of its documents;
a block of the mixed stream takes from every source the tokens its weight gives it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lexiloom.llm.tables import fresh, query, small, table
from lexiloom.session import cut_lineage

#: Most often a document may occur in the mixed stream.
REPEAT_LIMIT = 2.0
#: Tokens of a block of the mixed stream.
BLOCK_TOKENS = 1 << 18
#: Documents of a range of a permutation: a source has as many ranges, and tasks, as its size needs.
RANGE_ROWS = 2_000
#: Sources that a broadcast may hold; with more, the join shuffles.
MAX_BROADCAST_SOURCES = 100_000
#: The name of the source of rows without one.
NO_SOURCE = ""


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], exponent: float) -> list[float]:
    """Normalised weights: token shares raised to the exponent."""
    total = sum(tokens)
    powers = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [p / sum(powers) for p in powers]


def most_repeats(tokens: list[int], exponent: float) -> float:
    """Epochs of the most repeated source when the least repeated one is seen exactly once."""
    epochs = [w / t for w, t in zip(tempered(tokens, exponent), tokens) if t]
    return max(epochs) / min(epochs)


def bisect_exponent(
    tokens: list[int], target_entropy: float | None = None, repeat_limit: float | None = None, sources: list[int] | None = None
) -> float:
    """The least exponent within [0, 1] that meets the target.

    ``sources`` tells how many sources have each of the sizes (default: one). With
    ``repeat_limit``, no source repeats more often than that; with ``target_entropy`` (nats),
    the entropy of the weights is at most that (bisected from above, so it meets the target
    where it lies between the entropies of exponents 1 and 0). Both may be given; the larger
    exponent holds.
    """
    given = np.asarray(tokens, dtype=np.float64)
    number = np.ones(len(given)) if sources is None else np.asarray(sources, dtype=np.float64)
    given, number = given[given > 0], number[given > 0]
    if number.sum() < 2:
        return 1.0
    share = np.log(given / (given * number).sum())

    def met(exponent: float) -> bool:
        power = np.exp(exponent * share)
        weight = power / (power * number).sum()
        epochs = weight / given
        return (repeat_limit is None or epochs.max() / epochs.min() <= repeat_limit) and (
            target_entropy is None or -(number * weight * np.log(weight)).sum() <= target_entropy
        )

    low, high = 0.0, 1.0
    if met(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        if met(middle):
            high = middle
        else:
            low = middle
    return high


def source_weights(sizes: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT) -> DataFrame:
    """``source, tokens, rows, weight, epochs`` per source of ``source, tokens`` rows (one per document).

    The budget is the least at which every source is seen once in full, so no document is lost
    to the mixture. The exponent's search runs on the driver over the distinct sizes of the
    sources with their frequencies; the sources stay in the table. Distinct sizes are few: d of
    them need d * (d + 1) / 2 tokens, so 10^14 tokens have at most 14 million.
    """
    shares = cut_lineage(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    found = shares.groupBy("tokens").agg(F.count(F.lit(1)).alias("sources")).toArrow()
    known, number = (found.column(c).to_numpy().astype(np.float64) for c in ("tokens", "sources"))
    exponent = bisect_exponent(known, target_entropy, repeat_limit, number)
    held = known > 0
    total = float((known * number).sum()) or 1.0
    norm = float((((known[held] / total) ** exponent) * number[held]).sum()) or 1.0
    least = float(((known[held] / total) ** exponent / norm / known[held]).min()) if held.any() else 1.0
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(norm)
    return shares.select("source", "tokens", "rows", weight.alias("weight")).withColumn(
        "epochs", F.greatest(F.lit(1.0), F.col("weight") / F.col("tokens") / F.lit(least))
    )


def mixed_stream(
    docs: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT,
    block_tokens: int = BLOCK_TOKENS, seed: int = 17,
) -> DataFrame:
    """``row, source, tokens, weight, epoch, block, slot`` for every use of a document.

    ``docs`` has ``row`` (an id), ``source`` and ``tokens``. The first epoch holds every row;
    the last one ends where the source's budget does. ``slot`` orders the uses in a block.
    Ties in the drawn order go by row id; repeated rows are used like any other.
    """
    weights = source_weights(docs.select("source", "tokens"), target_entropy, repeat_limit)
    plan = weights.withColumn("budget", F.col("epochs") * F.col("tokens")).withColumnRenamed("tokens", "source_tokens")
    used = docs.join(small(plan, MAX_BROADCAST_SOURCES), "source").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("epochs") - 1e-9).cast("int") - 1))
    )
    drawn = used.withColumn("draw", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("row"))).withColumn(
        "part", F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("rows") / RANGE_ROWS)).cast("int")
    )
    drawn = cut_lineage(drawn)
    keys = ["source", "epoch", "part"]
    before = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy(keys).agg(F.sum("tokens").alias("held")).select(
        *keys, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*keys).orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        drawn.withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, keys)
        .withColumn("start", F.col("epoch") * F.col("source_tokens") + F.col("offset") + F.col("ahead"))
        .where((F.col("epoch") == 0) | (F.col("start") < F.col("budget")))
        .withColumn("block", F.floor(F.col("start") / F.greatest(F.col("weight") * block_tokens, F.lit(1.0))).cast("long"))
    )
    order = Window.partitionBy("block", "source").orderBy("start", "draw", "row")
    return placed.withColumn("nth", F.row_number().over(order)).select(
        "row", "source", "tokens", "weight", "epoch", "block", F.xxhash64(F.lit(seed), "block", "source", "nth").alias("slot")
    )


def source_and_tokens() -> list[Column]:
    """A document's source (``''`` for null) and its tokens: white-space words plus one."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0))
    return [F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), (words + 1).cast("long").alias("tokens")]


def sized(docs: DataFrame) -> DataFrame:
    """``row, source, tokens`` of documents."""
    return docs.select(F.col("doc_id").cast("long").alias("row"), *source_and_tokens())


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType)


def mix_documents(docs: DataFrame, repeat_limit: float = REPEAT_LIMIT, seed: int = 17) -> DataFrame:
    """The documents as often as the mixed stream uses them, with the columns they came with.

    Null texts count one token, a null source is a source of its own, an empty table stays
    empty. Uses are counted per row, whether or not rows share a ``doc_id`` or have none. Rows
    equal in all columns are told apart by a number while the stream is drawn; afterwards any
    of them stands for any other: each occurs as often as all can, and what is left over comes
    from one of them. (Map columns cannot be hashed and do not count for that.)
    """
    key, copies, uses = fresh(docs, "row_key"), fresh(docs, "row_copies"), fresh(docs, "row_uses")
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)])
    keyed = docs.select(hashed.alias("key"), *source_and_tokens())
    alike = cut_lineage(keyed.groupBy("key").agg(F.first("source").alias("source"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")))
    single = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = single.select(F.xxhash64("key", "copy").alias("row"), "key", "source", "tokens")
    # The stream passes its rows' keys through as their ids: equal rows are drawn apart by the copy's hash.
    stream = mixed_stream(rows.select(F.struct("row", "key").alias("row"), "source", "tokens"), repeat_limit=repeat_limit, seed=seed)
    drawn = stream.groupBy(F.col("row.key").alias("key")).agg(F.count(F.lit(1)).alias("uses"))
    several = cut_lineage(drawn.join(alike.select("key", "copies"), "key").where("uses > 1"))
    plan = small(several.select(F.col("key").alias(key), F.col("copies").alias(copies), F.col("uses").alias(uses)))
    marked = docs.withColumn(key, hashed).join(plan, key, "left")
    every = F.coalesce(F.floor(F.col(uses) / F.col(copies)), F.lit(1)).cast("int")
    spread = marked.withColumn(uses, F.explode(F.array_repeat(F.lit(0), every))).select(docs.columns)
    left = marked.where(F.col(uses) % F.col(copies) > 0).groupBy(key).agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("given"), F.first(F.col(uses) % F.col(copies)).alias("n")
    )
    rest = left.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("given.*")
    return spread.union(rest)


@query("op1_source_mixing")
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = mixed_stream(cut_lineage(sized(table(spark, sf_dir, "documents"))))
    return stream.select(F.col("row").alias("doc_id"), "source", "tokens", "weight", "epoch", "block", "slot")
