"""Language identification by prediction by partial matching.

One variable-order byte context tree per language is counted on labelled texts, then frozen.
A text's code length under a language is the exact sum, over its bytes, of the cost of the
byte in the longest context the tree knows, with the escape costs (method C, no exclusion)
of the longer contexts that did not hold the byte. The shortest code wins.

Because the statistics are frozen, escape chains are folded into tables once: one cost per
language for every sequence of up to four bytes that some language has seen. Most bytes of a
text cost one table read; a byte no language has seen there goes on to the shorter context.

The tables are sparse, so their size follows the labelled sample, not the alphabet: every byte
is a symbol and every context of the sample is kept. Languages are scored in groups of a
fixed number, which bounds the width of a table row and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.llm.tables import byte_view, hash_draw, held_out, query, table
from lexiloom.llm.words import mixed

#: Labelled texts per language that the trees are counted on (the documented bound of the sample).
TRAIN_TEXTS = 600
#: Longest context in bytes.
ORDER = 3
#: Languages whose costs stand in one table row.
GROUP = 8
#: Bytes of text counted or scored at once, whatever the number and length of the texts.
STEP = 1 << 17
UNDETERMINED = "und"

_GRAMS = "lang string, gram long, n long"
_SCORES = "doc_id long, held_out boolean, lang_pred string, score double"


def _folded() -> np.ndarray:
    """Byte values with A-Z lower-cased, digits as one byte and white space as a space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[9:14] = 32
    return fold


FOLD = _folded()


def steps(column: pa.Array, size: int = STEP) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """The column's folded bytes in steps of about ``size``, long texts in several.

    A step is the sequences of ``ORDER`` + 1 bytes as numbers, one ending at each byte, and
    where the bytes of a row lie: (row, first, behind the last). Texts begin after spaces.
    """
    data, bounds = byte_view(column)
    held: list[np.ndarray] = []
    parts: list[tuple[int, int, int]] = []
    filled = 0
    for row in range(len(bounds) - 1):
        low, end = int(bounds[row]), int(bounds[row + 1])
        at = low
        while at < end:
            stop = min(end, at + max(size - filled, 1))
            before = FOLD[data[max(low, at - ORDER) : at]]
            held += [np.full(ORDER - len(before), 32, dtype=np.uint8), before, FOLD[data[at:stop]]]
            parts.append((row, filled, filled + stop - at))
            filled += ORDER + stop - at
            at = stop
            if filled >= size:
                yield _sequences(held), parts
                held, parts, filled = [], [], 0
    if parts:
        yield _sequences(held), parts


def _sequences(held: list[np.ndarray]) -> np.ndarray:
    wide = np.concatenate(held).astype(np.uint32)
    made = wide[ORDER:].copy()
    for back in range(1, ORDER + 1):
        made |= wide[ORDER - back : len(wide) - back] << np.uint32(8 * back)
    return made


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte sequences per language, summed per step."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for grams, parts in steps(batch.column("text")):
            by_lang: dict[str, list[np.ndarray]] = {}
            for row, first, end in parts:
                by_lang.setdefault(langs[row], []).append(grams[first:end])
            for lang, found in sorted(by_lang.items()):
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )


class Places:
    """Distinct numbers and their places, found through a table of hashed slots."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.astype(np.uint32)
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        waiting, at = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys.astype(np.uint64)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 where it is none of the table's."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self._slot(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


@dataclass
class Level:
    """One order of a group's trees: folded costs of seen sequences, escape costs of contexts."""

    grams: Places
    cost: np.ndarray
    contexts: Places
    escape: np.ndarray


@dataclass
class Group:
    """Trees of a few languages, the order without context first."""

    width: int
    levels: list[Level]

    def bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Cost in bits of every sequence's last byte after the ``order`` bytes before it."""
        if order < 0:
            return np.full((len(keys), self.width), 8.0, dtype=np.float32)
        level, keys = self.levels[order], keys & np.uint32((1 << (8 * order + 8)) - 1)
        place = level.grams.find(keys)
        out = level.cost[place]
        missed = np.flatnonzero(place < 0)
        if len(missed):
            lower = self.bits(keys[missed], order - 1)
            context = level.contexts.find(keys[missed] >> np.uint32(8))
            known = context >= 0
            lower[known] += level.escape[context[known]]
            out[missed] = lower
        return out


@dataclass
class ContextTrees:
    """Frozen statistics of all languages, in groups."""

    langs: list[str]
    groups: list[Group]

    def code_lengths(self, column: pa.Array, size: int = STEP) -> np.ndarray:
        """Bits of every text (rows) under every language (columns)."""
        total = np.zeros((len(column), len(self.langs)))
        for keys, parts in steps(column, size):
            at = 0
            for group in self.groups:
                costs = group.bits(keys, ORDER)
                for row, first, end in parts:
                    total[row, at : at + group.width] += costs[first:end].sum(axis=0, dtype=np.float64)
                at += group.width
        return total


def _level(group: Group, order: int, gram: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Level:
    """Folded costs of one order above the levels ``group`` has so far."""
    keys, place = np.unique(gram & ((1 << (8 * order + 8)) - 1), return_inverse=True)
    counts = np.zeros((len(keys), group.width))
    np.add.at(counts, (place, lang), n)
    contexts, above = np.unique(keys >> 8, return_inverse=True)
    total, kinds = np.zeros((len(contexts), group.width)), np.zeros((len(contexts), group.width))
    np.add.at(total, above, counts)
    np.add.at(kinds, above, counts > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total == 0, 0.0, -np.log2(kinds / (total + kinds)))
        seen = -np.log2(counts / (total + kinds)[above])
    lower = group.bits(keys.astype(np.uint32), order - 1)
    cost = np.where(counts > 0, seen, escape[above] + lower)
    return Level(Places(keys), cost.astype(np.float32), Places(contexts), escape.astype(np.float32))


def build_trees(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, group: int = GROUP) -> ContextTrees:
    """Fold counts of byte sequences into tables; ``lang`` holds indices into ``langs``."""
    groups: list[Group] = []
    for low in range(0, len(langs), group):
        mine = (lang >= low) & (lang < low + group)
        made = Group(min(group, len(langs) - low), [])
        for order in range(ORDER + 1):
            made.levels.append(_level(made, order, gram[mine], lang[mine] - low, n[mine]))
        groups.append(made)
    return ContextTrees(langs, groups)


def train(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> ContextTrees:
    """Count the trees on up to ``train_texts`` texts of each language (hash order of the ids).

    Only ``text`` and ``lang`` are learned from, of rows outside the held-out third. Counting
    runs on the executors; what reaches the driver is bounded by the sample.
    """
    learn = docs.where(F.col("lang").isNotNull() & ~held_out())
    chosen = hash_draw(learn.select("lang", "doc_id"), ["doc_id"], train_texts, "lang").select("doc_id").distinct()
    sample = learn.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    grams = (
        sample.where("text is not null").select("lang", "text").mapInArrow(_count_grams, _GRAMS)
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(grams.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(langs)}
    index = np.array([place[name] for name in grams.column("lang").to_pylist()], dtype=np.int64)
    return build_trees(langs, index, grams.column("gram").to_numpy(), grams.column("n").to_numpy())


def posterior(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the shortest code (first of equals) and its share of probability."""
    best = bits.argmin(axis=1)
    behind = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
    return best, 1.0 / np.exp2(-behind).sum(axis=1)


def identify(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its whole text.

    A text that is null or has no letter gives ``und`` with score 0. Without any learned
    language everything is ``und``. Equal codes go to the first language by name; repeated
    rows are scored alike; further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("worded"), "text",
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        names = np.array([*trees.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            worded = batch.column("worded").to_numpy(zero_copy_only=False).astype(bool) & bool(trees.langs)
            if trees.langs:
                best, share = posterior(trees.code_lengths(batch.column("text")))
            else:
                best, share = np.zeros(len(worded), int), np.zeros(len(worded))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"),
                pa.array(names[np.where(worded, best, len(trees.langs))], pa.string()), pa.array(np.where(worded, share, 0.0)),
            ], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(score, _SCORES)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
