"""A Merkle manifest of a document table, with a membership proof for every row.

The leaves of a source, in the order of their ids, are hashed in runs of 16 until one node is
left; the subroots of all sources, in the order of the sources, are reduced likewise.

A *superblock* is three levels of a source's tree, up to 4,096 leaves. Only superblock roots
leave a superblock: the levels above them are reduced as tables, and every node hands its
siblings down to its children, 16 to a parent, so no key is hot however large a source is.
Leaves and the outer nodes their superblock needs are then cogrouped by superblock; one call
finishes the local levels, joins the proofs and folds them to the root.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.llm.tables import query, sql_crc32, table
from lexiloom.operators.ordering import row_numbers
from lexiloom.session import cut_lineage

#: Nodes of a run.
RUN = 16
#: Levels inside a superblock.
LOCAL_LEVELS = 3
SUPERBLOCK = RUN**LOCAL_LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(text: Column) -> Column:
    """Hash of a row: every field as its byte count, a colon and its value, ``-`` where null."""
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    framed = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """``key, doc_id, leaf, changed, pos``: leaves numbered from 0 in every source.

    ``key`` is the source with a mark before it and empty for a null one, so that keys are never
    null and sort as the sources do. ``changed`` is the leaf of the tampered text, null where
    the row is left alone. Equal ids are ordered by their leaf.
    """
    altered = F.translate("text", UPPER, LOWER)
    rows = cut_lineage(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(F.col("text")).alias("leaf"), F.when(tampered, leaf_hash(altered)).alias("changed"),
    ))
    numbered = row_numbers(rows, ["key"], ["doc_id", "leaf"], "nth", max_group=0)
    return numbered.withColumn("pos", F.col("nth") - 1).drop("nth")


def _joined_hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, "").cast("binary"), 256)


def _runs_hashed(nodes: Column) -> Column:
    """The next level of an array of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda i: _joined_hash(F.slice(nodes, i * RUN + 1, RUN)))


def _in_order(value: str, by: str = "pos") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value])


def superblock_roots(leaves: DataFrame) -> DataFrame:
    """``key, pos, node``: the root of every superblock, ``pos`` its number in the source.

    A source's only superblock stops when one node is left; others take all their levels, as
    they have neighbours to be reduced with.
    """
    blocks = leaves.groupBy("key", F.floor(F.col("pos") / SUPERBLOCK).alias("block")).agg(_in_order("leaf").alias("nodes"))
    for _ in range(LOCAL_LEVELS):
        unfinished = (F.size("nodes") > 1) | (F.col("block") > 0)
        blocks = blocks.withColumn("nodes", F.when(unfinished, _runs_hashed(F.col("nodes"))).otherwise(F.col("nodes")))
    return blocks.select("key", F.col("block").alias("pos"), F.col("nodes")[0].alias("node"))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level above ``key, pos, node`` and the one node left of each key.

    A run that is a key's first and holds one node is that key's top and is not hashed again.
    The number of levels follows from the highest position.
    """
    top = nodes.agg(F.max("pos")).first()[0] or 0
    levels: list[DataFrame] = []
    while top > 0:
        runs = cut_lineage(
            nodes.groupBy("key", F.floor(F.col("pos") / RUN).alias("run")).agg(_in_order("node").alias("nodes"))
        )
        levels.append(runs)
        alone = (F.col("run") == 0) & (F.size("nodes") == 1)
        nodes = runs.select(
            "key", F.col("run").alias("pos"), F.when(alone, F.col("nodes")[0]).otherwise(_joined_hash(F.col("nodes"))).alias("node")
        )
        top //= RUN
    return levels, nodes.select("key", "node")


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``key, pos, path`` of the lowest nodes: the runs on their way up, the lowest first.

    ``above`` has ``key, path``: the way from a key's last node on. A step of a path is the
    node's place in its run and the run.
    """
    paths = above.select("key", F.lit(0).cast("long").alias("pos"), "path")
    for runs in reversed(levels):
        parents = runs.join(paths.withColumnRenamed("pos", "run"), ["key", "run"])
        steps = parents.select("key", "run", "path", "nodes", F.posexplode("nodes").alias("place", "node"))
        alone = (F.col("run") == 0) & (F.size("nodes") == 1)
        step = F.array(F.struct(F.col("place").alias("place"), F.col("nodes").alias("nodes")))
        paths = steps.select(
            "key", (F.col("run") * RUN + F.col("place")).alias("pos"),
            F.when(alone, F.col("path")).otherwise(F.concat(step, "path")).alias("path"),
        )
    return paths


def outer_nodes(roots: DataFrame) -> DataFrame:
    """``key, block, level, nth, node, own, subroot, root``: what a superblock needs from outside.

    One row for every node of the runs between a superblock and the root, its own nodes marked.
    A table of one superblock needs nothing and has one row with a null ``level``.
    """
    levels, subroots = climb(roots)
    subroots = cut_lineage(row_numbers(subroots, [], ["key"], "nth").select("key", (F.col("nth") - 1).alias("pos"), "node"))
    upper, top = climb(subroots.select(F.lit("").alias("key"), "pos", "node"))
    start = top.select("key", F.array().cast("array<struct<place:int,nodes:array<string>>>").alias("path"))
    ways = descend(upper, start).select("pos", "path")
    last = top.first()
    root = F.lit(last["node"] if last else None).cast("string").alias("root")
    sources = cut_lineage(subroots.join(ways, "pos").select("key", "path", F.col("node").alias("subroot"), root))
    paths = descend(levels, sources.select("key", "path")).join(sources.select("key", "subroot", "root"), "key")
    steps = paths.select("key", F.col("pos").alias("block"), "subroot", "root", F.posexplode_outer("path").alias("level", "step"))
    return steps.select(
        "key", "block", "subroot", "root", "level", F.col("step.place").alias("place"),
        F.posexplode_outer("step.nodes").alias("nth", "node"),
    ).select("key", "block", "level", "nth", "node", (F.col("nth") == F.col("place")).alias("own"), "subroot", "root")


def _hex(content: bytes) -> bytes:
    return sha256(content).hexdigest().encode()


def _around(nodes: list[bytes]) -> list[tuple[bytes, bytes]]:
    """What stands before and after every node in its run."""
    made: list[tuple[bytes, bytes]] = []
    for low in range(0, len(nodes), RUN):
        run = nodes[low : low + RUN]
        made += [(b"".join(run[:i]), b"".join(run[i + 1 :])) for i in range(len(run))]
    return made


def finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Local reduction, proofs and folding of one superblock's leaves."""
    leaves = leaves.sort_values("pos", kind="stable")
    nodes = [x.encode() for x in leaves["leaf"]]
    block = int(leaves["pos"].iloc[0]) // SUPERBLOCK
    local: list[list[tuple[bytes, bytes]]] = []
    for _ in range(LOCAL_LEVELS):
        if len(nodes) == 1 and block == 0:
            break
        local.append(_around(nodes))
        nodes = [_hex(b"".join(nodes[low : low + RUN])) for low in range(0, len(nodes), RUN)]
    beyond: list[tuple[bytes, bytes]] = []
    steps = outer[outer["level"].notna()].sort_values(["level", "nth"], kind="stable")
    for _, run in steps.groupby("level", sort=True):
        held, own = [x.encode() for x in run["node"]], run["own"].tolist().index(True)
        beyond.append((b"".join(held[:own]), b"".join(held[own + 1 :])))
    tail = b"".join(before + after for before, after in beyond)
    subroot, root = outer["subroot"].iloc[0], outer["root"].iloc[0]
    proofs: list[str] = []
    folded: list[str] = []
    for i, (leaf, changed) in enumerate(zip(leaves["leaf"], leaves["changed"])):
        node = (changed if isinstance(changed, str) else leaf).encode()
        proof = sha256()
        for depth, level in enumerate(local):
            before, after = level[i // RUN**depth]
            proof.update(before + after)
            node = _hex(before + node + after)
        proof.update(tail)
        for before, after in beyond:
            node = _hex(before + node + after)
        proofs.append(proof.hexdigest())
        folded.append(node.decode())
    return pd.DataFrame({
        "doc_id": leaves["doc_id"], "leaf": leaves["leaf"], "subroot": subroot, "root": root, "proof_sha256": proofs,
        "folded_root": folded, "verified": [x == root for x in folded],
    })


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``tampered`` marks rows whose text is put into lower case (A-Z) before the proof is folded;
    ``verified`` tells whether the folded root is still the root. Null fields are marked in the
    leaf, a null source is a source of its own and comes first, rows without a ``doc_id`` come
    first in their source and are never tampered with, repeated rows are leaves of their own, a
    lone leaf is its subroot and an only subroot the root. Further columns are not read.
    """
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = cut_lineage(leaves_of(docs, F.coalesce(fifth if tampered is None else tampered, F.lit(False))))
    outer = outer_nodes(cut_lineage(superblock_roots(leaves)))
    inner = leaves.withColumn("block", F.floor(F.col("pos") / SUPERBLOCK))
    return inner.groupBy("key", "block").cogroup(outer.groupBy("key", "block")).applyInPandas(finish, _PROOFS)


def _sql_levels(name: str, count: int) -> str:
    """Runs, next nodes and folded proofs of ``count`` levels over ``{name}0 (k, pos, h)`` and ``{name}p0``."""
    parts = []
    for i in range(count):
        parts.append(f"""
{name}r{i} AS (SELECT k, pos // {RUN} AS run, list(h ORDER BY pos) AS hs FROM {name}{i} GROUP BY k, pos // {RUN}),
{name}{i + 1} AS (SELECT k, run AS pos, CASE WHEN run = 0 AND len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{i}),
{name}p{i + 1} AS (
  SELECT id, p.k, p.pos // {RUN} AS pos,
    proof || array_to_string(hs[1:p.pos % {RUN}], '') || array_to_string(hs[p.pos % {RUN} + 2:], '') AS proof,
    CASE WHEN run = 0 AND len(hs) = 1 THEN fold
      ELSE sha256(array_to_string(hs[1:p.pos % {RUN}], '') || fold || array_to_string(hs[p.pos % {RUN} + 2:], '')) END AS fold
  FROM {name}p{i} p JOIN {name}r{i} r ON r.k = p.k AND r.run = p.pos // {RUN})""")
    return ",".join(parts)


def _sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


#: Levels written out in the SQL: up to 16^6 rows of a source and 16^4 sources.
_ORACLE = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_sql_leaf("text")} AS leaf,
    CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM leaves
), a0 AS (SELECT k, pos, leaf AS h FROM numbered),
ap0 AS (SELECT id, k, pos, '' AS proof, coalesce(changed, leaf) AS fold FROM numbered),{_sql_levels("a", 6)},
b0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS pos, h, k AS of FROM a6),
bp0 AS (SELECT id, '' AS k, b0.pos, proof, fold FROM ap6 JOIN b0 ON b0.of = ap6.k),{_sql_levels("b", 4)}
SELECT doc_id, leaf, b0.h AS subroot, b4.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b4.h AS verified
FROM numbered JOIN bp4 USING (id) JOIN b0 ON b0.of = numbered.k CROSS JOIN b4
"""


@query("op13_merkle_manifest", _ORACLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
