"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are never split, and each is an item of the packing, whatever the input.
Groups of one size are alike to the packing, so what it reads is a count per size (an
aggregate on Spark): distinct sizes add up to at most the input's bytes, so there are at most
``sqrt(2 * bytes)`` of them. Sizes go in descending order; the groups of a size fill the bin
with the tightest remaining capacity that holds one, then the next such bin, found in a
balanced tree. The result is a run of ranks per size and bin; groups are ranked within their
size on Spark and look their run up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiloom.llm.tables import query, small, table
from lexiloom.operators.ordering import row_numbers
from lexiloom.session import cut_lineage

#: Sub-ranges of a shard that rows are numbered in; a hot shard is that many tasks.
RANGES = 256
#: A text held by more than this share of the rows finds its shard by a broadcast of such texts.
HOT_SHARE = 1 / 1024

#: A bin: remaining capacity and number.
Bin = tuple[int, int]


@dataclass
class _Node:
    key: Bin
    level: int = 1
    left: _Node | None = None
    right: _Node | None = None


def _level(node: _Node | None) -> int:
    return node.level if node else 0


def _skew(node: _Node | None) -> _Node | None:
    """Turn a left child of the same level into the parent."""
    if node is None or node.left is None or node.left.level != node.level:
        return node
    up = node.left
    node.left, up.right = up.right, node
    return up


def _split(node: _Node | None) -> _Node | None:
    """Lift the middle of three nodes of the same level."""
    if node is None or node.right is None or _level(node.right.right) != node.level:
        return node
    up = node.right
    node.right, up.left = up.left, node
    up.level += 1
    return up


def _inserted(node: _Node | None, key: Bin) -> _Node:
    if node is None:
        return _Node(key)
    if key < node.key:
        node.left = _inserted(node.left, key)
    else:
        node.right = _inserted(node.right, key)
    return _split(_skew(node))


def _removed(node: _Node, key: Bin) -> _Node | None:
    if key < node.key:
        node.left = _removed(node.left, key)
    elif key > node.key:
        node.right = _removed(node.right, key)
    elif node.left is None:
        # A node without a left child is on the lowest level: at most a leaf hangs on it.
        return node.right
    else:
        below = node.left
        while below.right:
            below = below.right
        node.key = below.key
        node.left = _removed(node.left, below.key)
    wanted = min(_level(node.left), _level(node.right)) + 1
    if wanted < node.level:
        node.level = wanted
        if node.right and node.right.level > wanted:
            node.right.level = wanted
    node = _skew(node)
    node.right = _skew(node.right)
    if node.right:
        node.right.right = _skew(node.right.right)
    node = _split(node)
    node.right = _split(node.right)
    return node


class OpenBins:
    """Bins ordered by remaining capacity, then number, in a balanced (AA) tree."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    def add(self, key: Bin) -> None:
        self._root = _inserted(self._root, key)

    def take_tightest(self, size: int) -> Bin | None:
        """Remove and return the bin with the least room of at least ``size`` (ties: the older)."""
        node, best = self._root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        if best is not None:
            self._root = _removed(self._root, best)
        return best


def best_fit_decreasing(
    classes: list[tuple[int, int]], capacity: int, most_bins: int | None = None
) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Runs ``(size, bin, first, count)`` for ``(size, count)`` classes, and the number of bins.

    Sizes are positive and distinct. The bins are those of packing item by item: after an item
    its bin is the tightest that may hold the next of the same size. An item above the capacity
    gets a bin alone. None as soon as more than ``most_bins`` would be opened.
    """
    runs: list[tuple[int, int, int, int]] = []
    bins, opened = OpenBins(), 0
    for size, count in sorted(classes, reverse=True):
        first = 0
        while first < count:
            room, at = bins.take_tightest(size) or (0, -1)
            if at < 0:
                if opened == most_bins:
                    return None
                room, at, opened = max(capacity, size), opened, opened + 1
            taken = min(count - first, room // size)
            runs.append((size, at, first, taken))
            first += taken
            if room > taken * size:
                bins.add((room - taken * size, at))
    return runs, opened


def pack_into(classes: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs in at most ``shards`` bins, and the capacity they were packed with.

    The capacity grows from the least possible one in doubled steps until the bins suffice, then
    the last step is bisected. Best fit is not monotone in the capacity, so one below the found
    may happen to suffice as well.
    """
    if not classes:
        return [], 0
    low = max(max(classes)[0], -(-sum(size * count for size, count in classes) // shards))
    high, step = low, 1
    found = best_fit_decreasing(classes, high, shards)
    while found is None:
        low, high, step = high + 1, high + step, 2 * step
        found = best_fit_decreasing(classes, high, shards)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(classes, middle, shards)
        if tried is None:
            low = middle + 1
        else:
            found, high = tried, middle
    return found[0], high


def text_size() -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """``grp, copies, shard`` from ``grp, size, copies``, one row per group."""
    classes = [(r["size"], r["count"]) for r in groups.groupBy("size").count().toArrow().to_pylist()]
    runs, _ = pack_into(classes, shards)
    plan = small(groups.sparkSession.createDataFrame(
        [(size, first, first + count, at) for size, at, first, count in runs], "of_size long, low long, high long, shard int"
    ))
    ranked = row_numbers(groups, ["size"], ["grp"], "nth")
    inside = (F.col("size") == F.col("of_size")) & (F.col("nth") > F.col("low")) & (F.col("nth") <= F.col("high"))
    return cut_lineage(ranked.join(plan, inside).select("grp", "copies", "shard"))


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; equal texts share a shard.

    Null texts are one group with size 1 a row; empty texts are another. Repeated rows are
    rows of their own with their own slots. Slots run from 0 without a gap in every shard; an
    empty table gives no rows. Further columns of ``docs`` are not read. Texts are known by
    64-bit hashes: two that collide share a shard, which splits no group.
    """
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("grp"),
    ))
    groups = cut_lineage(rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("copies")))
    placed = group_shards(groups, shards)
    hot = F.col("copies") > rows.count() * HOT_SHARE
    # Fewer than 1 / HOT_SHARE texts are hot; their rows stay where they are.
    told = rows.join(F.broadcast(placed.where(hot).select("grp", F.col("shard").alias("own"))), "grp", "left")
    columns = ("doc_id", "size", "text_crc32", "shard")
    each = told.where("own is not null").withColumnRenamed("own", "shard").select(*columns).union(
        told.where("own is null").join(placed.where(~hot).select("grp", "shard"), "grp").select(*columns)
    )
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(RANGES)).cast("int")
    return numbered(cut_lineage(each.withColumn("part", part)))


def numbered(placed: DataFrame) -> DataFrame:
    """Gapless slots per shard: counts of the sub-ranges give offsets, rows are numbered inside them."""
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
    )


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
