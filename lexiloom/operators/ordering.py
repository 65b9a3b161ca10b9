"""Ordered computations that stay spread out when one key holds most of the rows.

A window over ``PARTITION BY key`` puts each key in one task. That is the cheapest plan as
long as every key is small, so the largest group is measured first. Beyond a bound the
rows are cut into *slices* by a range partitioning on ``(keys, order)``, which splits a
hot key like any other range. The window runs inside slices; what a slice needs from the
slices before it (a row count, a sum, a last value) concerns only the key it starts with,
so there is at most one such carry per slice and the carries are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from lexiloom.session import cut_lineage

MAX_GROUP_ROWS = 1_000_000
_SLICE = "__slice"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the most frequent key, by partial aggregates."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _spreads(df: DataFrame, keys: list[str], max_group: int, largest: int | None) -> bool:
    """Whether rows have to be sliced; ``largest`` is a known upper bound of the groups, which saves measuring them."""
    return (largest_group(df, keys) if largest is None else largest) > max_group


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with a slice number that grows with ``(keys, order)``.

    Range boundaries come from a sample of the data, so the numbered rows are written
    once and every later pass reads that copy.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in keys + order])
    return cut_lineage(ranged.withColumn(_SLICE, F.spark_partition_id()))


def _carries(rows: DataFrame, keys: list[str], part: Column, whole) -> DataFrame:
    """What each slice takes over for the key it starts with: at most one row per slice.

    ``part`` summarises one key within one slice, ``whole`` combines the earlier parts.
    """
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    parts = rows.groupBy(*keys, _SLICE).agg(part.alias("__part"))
    taken = parts.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col(_SLICE).alias("__at"),
        whole(F.col("__part"), across).alias("__carry"), F.lag(_SLICE).over(across).alias("__earlier"),
    )
    return taken.where(F.col("__earlier").isNotNull()).drop("__earlier")


def _with_carry(rows: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
    test = F.col(_SLICE) == F.col("__at")
    for key in keys:
        test = test & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return rows.join(F.broadcast(carries), test, "left")


def _earlier(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str = "row_number", max_group: int = MAX_GROUP_ROWS
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``order`` must be unique per key."""
    if largest_group(df, keys) <= max_group:
        plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, plain.cast("long"))
    rows = sliced(df, keys, order)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    carries = _carries(rows, keys, F.count(F.lit(1)), lambda n, across: F.sum(n).over(_earlier(across)))
    joined = _with_carry(rows.withColumn("__inside", F.row_number().over(inside)), carries, keys)
    number = F.col("__inside") + F.coalesce("__carry", F.lit(0))
    return joined.select(*df.columns, number.cast("long").alias(name))


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, inclusive: bool = True,
    max_group: int = MAX_GROUP_ROWS, largest: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` per key; exclusive of the current row if asked."""
    end = 0 if inclusive else -1

    def up_to_here(keys_: list[str]) -> Column:
        window = Window.partitionBy(*keys_).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    if not _spreads(df, keys, max_group, largest):
        return df.withColumn(name, up_to_here(keys))
    rows = sliced(df, keys, order)
    carries = _carries(rows, keys, F.sum(value), lambda s, across: F.sum(s).over(_earlier(across)))
    joined = _with_carry(rows.withColumn("__inside", up_to_here([*keys, _SLICE])), carries, keys)
    return joined.select(*df.columns, (F.col("__inside") + F.coalesce("__carry", F.lit(0))).alias(name))


def previous_values(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "previous", max_group: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)``; ``order`` must be unique per key."""
    if not _spreads(df, keys, max_group, largest):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = sliced(df, keys, order)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    carries = _carries(rows, keys, last, lambda v, across: F.lag(v).over(across))
    lagged = rows.withColumn("__first", F.row_number().over(inside) == 1).withColumn("__lag", F.lag(value).over(inside))
    joined = _with_carry(lagged, carries, keys)
    return joined.select(
        *df.columns, F.when(F.col("__first"), F.col("__carry.v")).otherwise(F.col("__lag")).alias(name)
    )


def latest_values(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, max_group: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """The last non-null ``value`` of the earlier rows of a key; ``order`` must be unique per key."""

    def latest(window: WindowSpec) -> Column:
        return F.last(value, ignorenulls=True).over(_earlier(window))

    if not _spreads(df, keys, max_group, largest):
        return df.withColumn(name, latest(Window.partitionBy(*keys).orderBy(*order)))
    rows = sliced(df, keys, order)
    part = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    carries = _carries(rows, keys, part, lambda v, across: F.last(v, ignorenulls=True).over(_earlier(across)))
    joined = _with_carry(rows.withColumn("__latest", latest(Window.partitionBy(*keys, _SLICE).orderBy(*order))), carries, keys)
    return joined.select(*df.columns, F.coalesce("__latest", "__carry").alias(name))
