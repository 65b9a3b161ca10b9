"""Benchmark decontamination with a distributed positional inverted index.

The index has one part per block of training documents: for every term of the tests, the
documents and word positions that hold it. It is stored as a table in the shared checkpoint
folder over the words of all tests, so tests in any number of blocks are answered from it
without reading a text again.
A phrase is found by intersecting its terms' position lists, each shifted by the term's
offset in the phrase, from the rarest term (by its count over all documents) on.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.llm.tables import query, table, without_ids
from lexiloom.session import cut_lineage

#: Consecutive words of a test item that count as leaked.
WINDOW = 10
#: Test words answered in one pass over the index; more are answered in several passes.
BLOCK_WORDS = 400_000
#: Words of training text whose postings are intersected together, which bounds a task's memory.
MATCH_WORDS = 2_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words for Spark: everything but ASCII that is no digit and no lower-case letter.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_INDEX = "row_id long, doc_id long, n_words long, terms array<int>, sizes array<int>, positions array<int>"
_MATCHES = "row_id long, doc_id long, n_words long, n_hit long, starts array<int>, ends array<int>, items array<long>, near_items array<long>"
_FOUND = ("doc_id", "n_words", "n_hit", "items", "near_items")


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of anything beyond ASCII."""
    return _WORD.findall(text.lower())


def test_words(benchmark: DataFrame) -> DataFrame:
    """``item_id, ws`` of the items that have words; repeated rows count once, null ids not at all."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        benchmark.where("item_id is not null and text is not null")
        .select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), 0).alias("ws"))
        .where("size(ws) > 0").distinct()
    )


@dataclass
class TestPhrases:
    """The phrases of one block of test items, ready to be broadcast.

    ``n_terms`` is the size of the vocabulary; phrase ``p`` has the terms ``grid[p]`` (-1 beyond
    its length) and belongs to item ``items[p]``.
    """

    n_terms: int
    grid: np.ndarray
    lengths: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]], terms: dict[bytes, int], window: int = WINDOW) -> TestPhrases:
        found: dict[tuple[int, tuple[int, ...]], None] = {}
        for item, ws in rows:
            ids = [terms[w.encode()] for w in ws]
            for start in range(max(1, len(ids) - window + 1)):
                found[item, tuple(ids[start : start + window])] = None
        grid = np.full((len(found), window), -1, dtype=np.int64)
        for p, (_, phrase) in enumerate(found):
            grid[p, : len(phrase)] = phrase
        return cls(len(terms), grid, (grid >= 0).sum(axis=1), np.array([item for item, _ in found], dtype=np.int64))

    def rarest_first(self, counts: np.ndarray) -> np.ndarray:
        """Offsets of every phrase's terms by rising count in the training documents."""
        weight = np.where(self.grid >= 0, counts[self.grid], np.iinfo(np.int64).max)
        return np.argsort(weight, axis=1, kind="stable")


def vocabulary_of(tests: DataFrame) -> dict[bytes, int]:
    """Numbers of the distinct words of all tests (``ws``); one row per word reaches the driver."""
    found = tests.select(F.explode("ws").alias("w")).distinct().toArrow().column("w")
    return {w.encode(): i for i, w in enumerate(found.to_pylist())}


def build_index(docs: DataFrame, vocabulary: list[str] | dict[bytes, int]) -> DataFrame:
    """The stored index of all documents over a vocabulary, one row per document.

    ``row_id`` tells repeated documents and those with a null id apart. ``terms`` are a document's distinct vocabulary terms, ``sizes`` their counts, ``positions``
    the word positions term after term. A null text has no words.
    """
    terms = vocabulary if isinstance(vocabulary, dict) else {w.encode(): i for i, w in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value.get
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for low in range(0, batch.num_rows, 512):
                n_words, kinds, sizes, places = [], [], [], []
                for i in range(low, min(low + 512, batch.num_rows)):
                    found = words(texts[i].as_py() or b"")
                    term = np.fromiter((lookup(w, -1) for w in found), dtype=np.int32, count=len(found))
                    at = np.flatnonzero(term >= 0).astype(np.int32)
                    order = np.argsort(term[at], kind="stable")
                    kind, size = np.unique(term[at], return_counts=True)
                    n_words.append(len(found))
                    kinds.append(kind)
                    sizes.append(size.astype(np.int32))
                    places.append(at[order])
                lists = [_lists(x) for x in (kinds, sizes, places)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id").slice(low, 512), batch.column("doc_id").slice(low, 512), pa.array(n_words, pa.int64()), *lists],
                    names=["row_id", "doc_id", "n_words", "terms", "sizes", "positions"],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(numbered.mapInArrow(run, _INDEX))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of every term over all documents; one row per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            term, size = (batch.column(c).flatten().to_numpy() for c in ("terms", "sizes"))
            total += np.bincount(term, weights=size, minlength=n_terms).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "n"])

    found = index.select("terms", "sizes").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_terms, dtype=np.int64)
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return counts


def _contains(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if len(sorted_values) == 0:
        return np.zeros(len(wanted), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)] == wanted


def _match_block(part: pa.RecordBatch, phrases: TestPhrases, order: np.ndarray, slop: int) -> pa.RecordBatch:
    """Answer all phrases on one block of the index."""
    n_words = part.column("n_words").to_numpy()
    gap = phrases.grid.shape[1] + slop + 1
    base = np.concatenate([[0], np.cumsum(n_words + gap)])
    sizes = part.column("sizes").flatten().to_numpy()
    term = np.repeat(part.column("terms").flatten().to_numpy(), sizes)
    lists = part.column("positions")
    place = lists.flatten().to_numpy().astype(np.int64) + np.repeat(base[:-1], lists.value_lengths().to_numpy())
    # Rows are in document order and a term's positions rise, so a stable sort leaves them rising.
    by_term = np.argsort(term, kind="stable")
    place = place[by_term]
    bounds = np.searchsorted(term[by_term], np.arange(phrases.n_terms + 1))
    held = np.diff(bounds)

    complete = np.where(phrases.grid >= 0, held[phrases.grid], 1).min(axis=1) > 0 if len(phrases.grid) else np.empty(0, bool)
    starts, ends, items, near_at, near_items = [], [], [], [], []
    for p in np.flatnonzero(complete):
        length = phrases.lengths[p]
        at = None
        for nth, offset in enumerate(order[p, :length]):
            t = phrases.grid[p, offset]
            here = place[bounds[t] : bounds[t + 1]]
            if nth == 0:
                at = anchors = here - offset
                first_offset = offset
            else:
                at = at[_contains(here, at + offset)]
            if len(at) == 0:
                break
        starts.append(at)
        ends.append(at + length)
        items.append(np.full(len(at), phrases.items[p]))
        if slop:
            close = anchors + first_offset
            for offset in order[p, 1:length]:
                t = phrases.grid[p, offset]
                here = place[bounds[t] : bounds[t + 1]]
                nearest = np.searchsorted(here, close - (length + slop - 1))
                close = close[(nearest < len(here)) & (here[np.minimum(nearest, len(here) - 1)] <= close + length + slop - 1)]
                if len(close) == 0:
                    break
            near_at.append(close)
            near_items.append(np.full(len(close), phrases.items[p]))

    n = part.num_rows
    joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    start, end, item = joined(starts), joined(ends), joined(items)
    edge = np.zeros(base[-1] + 1, dtype=np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    hit = np.cumsum(edge) > 0
    covered = np.concatenate([[0], np.cumsum(hit)])
    n_hit = covered[base[:-1] + n_words] - covered[base[:-1]]
    turns = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # A gap follows every document, so a run of hit words starts and ends in the same one.
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    owner = np.searchsorted(base, starts, side="right") - 1
    runs = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    places = [pa.ListArray.from_arrays(pa.array(runs), pa.array((at - base[owner]).astype(np.int32))) for at in (starts, ends)]
    return pa.RecordBatch.from_arrays(
        [part.column("row_id"), part.column("doc_id"), part.column("n_words"), pa.array(n_hit.astype(np.int64)), *places,
         _items_of(start, item, base, n), _items_of(joined(near_at), joined(near_items), base, n)],
        names=["row_id", "doc_id", "n_words", "n_hit", "starts", "ends", "items", "near_items"],
    )


def _items_of(at: np.ndarray, item: np.ndarray, base: np.ndarray, n: int) -> pa.Array:
    """Distinct items per document of a block."""
    pairs = np.unique(np.stack([np.searchsorted(base, at, side="right") - 1, item], axis=1), axis=0) if len(at) else np.empty((0, 2), np.int64)
    offsets = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs[:, 1].astype(np.int64)))


def match_phrases(index: DataFrame, phrases: TestPhrases, counts: np.ndarray, slop: int = 0) -> DataFrame:
    """``row_id, doc_id, n_words, n_hit, starts, ends, items, near_items`` per row of the index.

    ``counts`` are the index's ``term_counts``. ``n_hit`` counts the words inside any exact
    occurrence of a phrase, ``starts`` and ``ends`` bound the runs of such words and ``items``
    lists the items that occur. With a ``slop``, ``near_items`` lists the items one of whose phrases has
    all its terms, in any order, within its length plus ``slop`` words of its rarest term.
    """
    shared = index.sparkSession.sparkContext.broadcast((phrases, phrases.rarest_first(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, order = shared.value
        for batch in batches:
            cut = np.cumsum(batch.column("n_words").to_numpy()) // MATCH_WORDS
            limits = [0, *(np.flatnonzero(np.diff(cut)) + 1), batch.num_rows]
            for low, high in zip(limits, limits[1:]):
                if high > low:
                    yield _match_block(batch.slice(low, high - low), phrases, order, slop)

    return index.mapInArrow(run, _MATCHES)


def _blocks(rows: Iterator) -> Iterator[list[tuple[int, list[str]]]]:
    """Test items in blocks of bounded size, in the order they come."""
    block, held = [], 0
    for row in rows:
        block.append((row["item_id"], row["ws"]))
        held += len(row["ws"])
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``doc_id, n_words, n_hit, items, near_items`` of every document.

    An item of fewer words than ``window`` is one phrase; one without words matches nothing. A
    null text has no words. Repeated rows are answered row by row; rows with a null ``doc_id``
    too. Empty tables give no rows or no hits. Further columns are not read. Tests beyond
    ``BLOCK_WORDS`` words are answered block by block from one index: items are streamed to the
    driver, one block at a time, and the hit words of a row are united over the blocks. Only the
    distinct words of all tests are held at once.
    """
    tests = cut_lineage(test_words(benchmark))
    terms = vocabulary_of(tests)
    index = build_index(docs, terms)
    counts = term_counts(index, len(terms))
    blocks = _blocks(tests.toLocalIterator())
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return match_phrases(index, TestPhrases.of(block, terms, window), counts, slop).select(*_FOUND)
    merged = None
    for block in itertools.chain([block, following], blocks):
        found = match_phrases(index, TestPhrases.of(block, terms, window), counts, slop)
        part = cut_lineage(found.where("n_hit > 0 or size(near_items) > 0").drop("doc_id", "n_words", "n_hit"))
        merged = part if merged is None else merged.union(part)
    return index.select("row_id", "doc_id", "n_words").join(_united(merged), "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("items", "near_items")],
    )


def _united(parts: DataFrame) -> DataFrame:
    """``row_id, n_hit, items, near_items`` over the blocks of tests: each hit word counts once."""
    runs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    n_hit = F.aggregate(
        runs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda done, run: F.struct(
            (done.n + F.greatest(run.ends - F.greatest(run.starts, done.reach), F.lit(0))).alias("n"),
            F.greatest(done.reach, run.ends).alias("reach"),
        ),
        lambda done: done.n.cast("long"),
    )
    distinct = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
    return parts.groupBy("row_id").agg(n_hit.alias("n_hit"), *distinct)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no phrase of the benchmark, with the columns they came with."""
    leaked = cut_lineage(find_leaks(docs, benchmark).where("n_hit > 0 and doc_id is not null").select("doc_id").distinct())
    return without_ids(docs, leaked).select(docs.columns)


_ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), k AS (SELECT DISTINCT k FROM p),
g AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) CROSS JOIN k WHERE i + k - 1 <= len(ws)
), m AS (SELECT doc_id, i, k, item_id FROM g JOIN p USING (k, phrase)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op9_benchmark_decontamination", _ORACLE)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
