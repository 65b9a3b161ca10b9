"""Reading tables, the learning split and other helpers every operator here shares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Ids that a broadcast may hold: some 16 MB as longs. Above it, joins shuffle.
MAX_BROADCAST_IDS = 1_000_000


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this package, with SQL for the same rows where there is one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, bit by bit (DuckDB has no such function)."""
    bits = f"list_transform(range(8 * strlen({text})), lambda i: (ascii({text}[(i // 8 + 1)::INT]) >> (i % 8)::INT) & 1)"
    step = "lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {bits}), {step}))"


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the rows that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fresh(rows: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, such that ``rows`` has no such column in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(rows: DataFrame, most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``rows`` marked for broadcast if they are counted to be at most ``most``; else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def hash_draw(rows: DataFrame, keys: list[str], size: int, per: str | None = None) -> DataFrame:
    """The first ``size`` rows (of every value of ``per``) in the order of their keys' hash.

    For bounded training samples. The rows are counted first; only those whose hash lies within
    twice the share needed are ranked, so no task ranks all rows of a large group. Where ``per``
    is null, no row is drawn. Columns of any other name pass through.
    """
    place = F.xxhash64(*keys) / F.lit(2.0**64) + 0.5
    order = [F.xxhash64(*keys), *keys]
    if per is None:
        return rows.where(place <= 2.0 * size / max(rows.count(), 1)).orderBy(*order).limit(size)
    held, nth = fresh(rows, "held"), fresh(rows, "nth")
    counts = rows.groupBy(per).agg(F.count("*").alias(held))
    near = rows.join(small(counts), per).where(place <= F.lit(2.0 * size) / F.col(held)).drop(held)
    ranked = near.withColumn(nth, F.row_number().over(Window.partitionBy(per).orderBy(*order)))
    return ranked.where(F.col(nth) <= size).drop(nth)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is not in ``ids``; rows with a null id stay.

    The ids are broadcast only when counted and few, so that the texts need not be shuffled.
    """
    return docs.join(small(ids), "doc_id", "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in ``ids``."""
    return docs.join(small(ids), "doc_id", "left_semi")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and its row offsets (a null row is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return content[bounds[0] : bounds[-1]], bounds - bounds[0]
