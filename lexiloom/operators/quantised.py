"""Approximate nearest neighbours over quantised codes, with exact re-ranking.

A unit vector is cut into parts of equal width; a part is written as the number of the nearest
among a few codewords, so a vector of 64 floats becomes 32 bytes. Codes are scanned instead of
vectors: every query keeps its ``depth`` best by approximate distance, and only those
candidates' vectors are fetched, compared exactly and ranked. What moves through the cluster
per corpus row is the code; vectors move for candidates alone.

Codewords are the parts of a bounded set of corpus vectors, drawn by the md5 of their ids, so
the same index can be computed anywhere, in SQL too. Nothing is pruned: unlike cells around
pivots, the recall does not hang on the vectors being clustered, and it grows with ``depth``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lexiloom.dimensions import TOP_K
from lexiloom.operators.knn import (
    MAX_BROADCAST_QUERIES, QUERY_BLOCK, TILE_VALUES, _arrow_schema, _cut, _ids, _matrix, _pair_distances, _ranked,
    _result_type, _Running, _unit, every_pair, nearest_places,
)
from lexiloom.session import cut_lineage

#: Parts of a vector and codewords of a part; at most 256, so that a part is one byte.
PARTS = 32
CODEWORDS = 64
#: Candidates per query that are compared exactly.
DEPTH = 100
#: Codes of a tile, some 16 MB, where there are too many queries to broadcast.
TILE_CODES = 500_000
_STEP = 4096
_CANDIDATE_BYTES = 48  # of a candidate on its way to the ranking, about


def _parted(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Unit vectors as (row, part, value); the last parts are filled up with zeros."""
    width = -(-vectors.shape[1] // parts)
    wide = np.zeros((len(vectors), parts * width))
    wide[:, : vectors.shape[1]] = _unit(vectors)
    return wide.reshape(len(vectors), parts, width)


def draw_codebook(corpus: DataFrame, item_id: str, vector: str, parts: int = PARTS, codewords: int = CODEWORDS) -> np.ndarray:
    """Codewords as (part, word, value): the parts of ``codewords`` corpus vectors."""
    order = [F.md5(F.col(item_id).cast("string")), F.col(item_id)]
    chosen = corpus.where(F.col(vector).isNotNull()).select(vector).orderBy(*order).limit(min(codewords, 256)).collect()
    if not chosen:
        return np.zeros((parts, 0, 1))
    return _parted(np.array([r[0] for r in chosen], dtype=np.float64), parts).transpose(1, 0, 2)


def _nearest_words(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of the nearest codeword of every part; of equally near ones the first."""
    parted = _parted(vectors, len(book))
    codes = np.empty(parted.shape[:2], dtype=np.uint8)
    for part, words in enumerate(book):
        codes[:, part] = ((parted[:, part, None, :] - words[None]) ** 2).sum(axis=2).argmin(axis=1)
    return codes


def encode(corpus: DataFrame, item_id: str, vector: str, book: np.ndarray) -> DataFrame:
    """``item_id, code``: the code of every row that has a vector."""
    shared = corpus.sparkSession.sparkContext.broadcast(book)
    out = T.StructType([T.StructField("item_id", corpus.schema[item_id].dataType), T.StructField("code", T.BinaryType())])
    schema = _arrow_schema(out)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _STEP):
                part = batch.slice(low, _STEP)
                codes = _nearest_words(_matrix(part.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], schema=schema)

    return corpus.where(F.col(vector).isNotNull()).select(item_id, vector).mapInArrow(assign, out)


def _numbers(codes: pa.Array | pa.ChunkedArray, parts: int) -> np.ndarray:
    """Codes as (row, part)."""
    return np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(codes), parts)


def _spelled(numbers: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The vectors that numbers of codewords stand for."""
    return book[np.arange(len(book))[None, :], numbers].reshape(len(numbers), -1)


def _decoded(codes: pa.Array | pa.ChunkedArray, book: np.ndarray) -> np.ndarray:
    """The vectors that the codes stand for."""
    return _spelled(_numbers(codes, len(book)), book)


def _as_single(vectors: np.ndarray) -> np.ndarray:
    return vectors.astype(np.float32)


def _code_distances(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Distance of every unit query to the decoded vector of its row, to as many places as exact ones."""
    return np.floor((1.0 - np.einsum("ij,ij->i", queries, corpus)) * 1e12 + 0.5) / 1e12


def _longest(book: np.ndarray) -> float:
    """A decoded vector is no longer than the longest words of all parts together."""
    return float(np.sqrt((book**2).sum(axis=2).max(axis=1, initial=0.0).sum()))


def _best_codes(points: np.ndarray, book: np.ndarray, depth: int) -> _Running:
    """Best codes of unit queries."""
    return _Running(depth, points, _as_single, _code_distances, _longest(book))


def _looked_up(best: _Running, ids: np.ndarray, codes: pa.Array | pa.ChunkedArray, book: np.ndarray) -> None:
    for low in range(0, len(ids), _STEP):
        best.add(ids[low : low + _STEP], _decoded(codes.slice(low, _STEP), book))


def _points(vectors: np.ndarray, parts: int) -> np.ndarray:
    return _parted(vectors, parts).reshape(len(vectors), -1)


def _scanned(rows: list, codes: DataFrame, out: T.StructType, book: Broadcast, depth: int) -> DataFrame:
    """One scan of the codes against a broadcast query matrix of checked size."""
    schema, query_ids = _arrow_schema(out), [r[0] for r in rows]
    shared = codes.sparkSession.sparkContext.broadcast(_points(np.array([r[1] for r in rows], dtype=np.float64), len(book.value)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _best_codes(shared.value, book.value, depth)
        for batch in batches:
            _looked_up(best, _ids(batch.column(0)), batch.column(1), book.value)
        found = best.result()
        if found is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array([query_ids[r] for r in found[0]], type=schema.field(0).type),
                pa.array(found[1], type=schema.field(1).type), pa.array(found[2], type=pa.float64()),
            ], schema=schema)

    return codes.mapInArrow(scan, out)


def _tiled(queries: DataFrame, codes: DataFrame, out: T.StructType, book: Broadcast, depth: int, tile: int, block: int) -> DataFrame:
    """Tiles of codes against blocks of queries; each pair yields at most ``depth`` rows a query."""
    schema = _arrow_schema(out)
    n_queries, n_codes = queries.count(), codes.count()
    wide = book.value.shape[0] * book.value.shape[2]
    blocks, tiles = _cut(
        n_queries, n_codes, wide * 4 + depth * _CANDIDATE_BYTES, book.value.shape[0] + 16,
        codes.sparkSession.sparkContext.defaultParallelism, min(block, max(TILE_VALUES // max(wide, 1, 4 * depth), 1)), tile,
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        # Positions stand for ids; they are in the same order.
        right = right.take(pc.sort_indices(right.column(0), null_placement="at_start"))
        numbers = _numbers(right.column(1), len(book.value))
        rows, found, distances = nearest_places(
            depth, _points(_matrix(left.column(1)), len(book.value)), len(numbers), lambda at: _spelled(numbers[at], book.value),
            _as_single, _code_distances, _longest(book.value),
        )
        return pa.Table.from_arrays(
            [left.column(0).take(pa.array(rows)), right.column(0).take(pa.array(found)), pa.array(distances, pa.float64())],
            names=schema.names,
        )

    return every_pair(queries, codes, blocks, tiles, out, compare)


def _exact(pairs: DataFrame, out: T.StructType) -> DataFrame:
    """Distances of ``query_id, item_id, a, b``."""
    schema = _arrow_schema(out)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _STEP):
                part = batch.slice(low, _STEP)
                a, b = (_matrix(part.column(i)) for i in (2, 3))
                far = pa.array(_pair_distances(a, b), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), far], schema=schema)

    return pairs.mapInArrow(measure, out)


def quantised_knn(
    queries: DataFrame, corpus: DataFrame, k: int = TOP_K, query_id: str = "query_id", item_id: str = "chunk_id",
    vector: str = "embedding", depth: int = DEPTH, codes: DataFrame | None = None, book: np.ndarray | None = None,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES, tile_codes: int = TILE_CODES, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Nearest ``k`` corpus rows of every query, approximate: ``query_id, rank, <item_id>, distance``.

    Distances and ranks among the candidates are exact; a neighbour is missed if its code is
    not among the query's ``depth`` best. ``codes`` and ``book`` are a stored index of the
    corpus (:func:`encode`); without them it is made first. Rows without a vector have no
    neighbours and are none; equal distances are ranked by id, on codes and vectors alike. Ids
    are taken to be unique.
    """
    if book is None or codes is None:
        book = draw_codebook(corpus, item_id, vector)
        codes = cut_lineage(encode(corpus, item_id, vector, book))
    plain = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
    out = _result_type(queries, query_id, corpus, item_id)
    shared = corpus.sparkSession.sparkContext.broadcast(book)
    rows = plain.limit(max_broadcast_queries + 1).collect()
    if not rows:
        found = corpus.sparkSession.createDataFrame([], out)
    elif len(rows) <= max_broadcast_queries:
        found = _scanned(rows, codes, out, shared, depth)
    else:
        found = _tiled(plain, codes, out, shared, depth, tile_codes, query_block)
    order = Window.partitionBy("query_id").orderBy("distance", "item_id")
    candidates = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= depth).select("query_id", "item_id")
    vectors = corpus.select(F.col(item_id).alias("item_id"), F.col(vector).alias("b"))
    pairs = candidates.join(vectors, "item_id").join(plain.withColumnRenamed("vector", "a"), "query_id")
    ranked = _ranked(_exact(pairs.select("query_id", "item_id", "a", "b"), out), k)
    return ranked.withColumnRenamed("item_id", item_id) if item_id != "item_id" else ranked
