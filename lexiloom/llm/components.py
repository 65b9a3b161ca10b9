"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiloom.session import cut_lineage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link neighbours of every node to the least node around it.

    The large star moves a node's larger neighbours, the small star its smaller ones and the
    node itself. The least neighbour is an aggregate with a map-side part, so a hub with any
    number of links is never gathered.
    """
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        moved = around.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        .where("a <> b").distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is its least node.

    Edges with a null end or equal ends are ignored; direction and repeats do not matter.
    Alternates large and small stars until nothing moves (some log n rounds); every round is
    written to the shared checkpoint folder, so that a lost executor costs one round.
    """
    current = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        # A node with one smaller neighbour that is nobody's larger one: all stars, nothing to do.
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        current = cut_lineage(_star(_star(current, small=False), small=True))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct()
    )
