"""The persistent chunk table, the cache-mapping table and their incremental upkeep.

The chunk table is versioned and merged when it is read. A batch writes its own rows as a new
version and a log of the documents (or chunks) it replaces; no stored file is read or
rewritten, however many buckets the batch falls into. Three folders make the table::

    data/version=N/prefix_bucket=xx   the rows of a batch
    log/version=N                     what it replaces: documents, single chunks, or whole buckets
    commits/version=N                 one row in one file, written last: the version counts from then on
    properties                        name and length of the embedding, written with the first version

A reader leaves out rows that a later version replaces. Compaction writes the living rows of
the buckets that hold too many dead ones as a version of its own and logs these buckets as
replaced; their older files are then no longer read, and :func:`vacuum` removes them. Chunks are
spread by ``prefix_bucket``, the leading hex digits of the chunk prefix: two digits (256
buckets) suit a table of some terabytes; the number is chosen when the table is first written
and kept from then on. There may be any number of readers and one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexiloom.functions.vectors import TERM_COUNTS, Embedding, checked_dim, complete_vectors
from lexiloom.schemas import CACHE_MAP, CHUNK
from lexiloom.session import cut_lineage, remove_folder

BUCKET = "prefix_bucket"
BUCKET_DIGITS = 2
VERSION = "version"
#: Replaced documents or chunks that a reader broadcasts; with more, the merge is a shuffled join.
MAX_BROADCAST_CHANGES = 1_000_000
#: Share of dead rows from which a bucket is worth compacting.
DEAD_SHARE = 0.25
#: Buckets whose files are smaller on average are merged by a shuffle when they are compacted; Spark's cost of opening a file.
SMALL_FILE = 4 << 20
_STORED = T.StructType(CHUNK.fields + [T.StructField(BUCKET, T.StringType())])
_DATA = T.StructType(_STORED.fields + [T.StructField(VERSION, T.LongType())])
_LOG = T.StructType().add("kind", T.StringType()).add(BUCKET, T.StringType()).add("doc_key", T.StringType()).add(
    "ordinal", T.IntegerType()).add(VERSION, T.LongType())
_PROPERTIES = T.StructType().add("embedding", T.StringType()).add("dim", T.IntegerType())
_COMMITS = T.StructType().add("mode", T.StringType()).add(VERSION, T.LongType())


def bucket_of(prefix: Column, digits: int = BUCKET_DIGITS) -> Column:
    return F.substring(prefix, 1, digits)


def _open(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as failure:
        if "PATH_NOT_FOUND" not in str(failure):
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str) -> int:
    """The last version that counts; 0 where there is none."""
    return _open(spark, f"{path}/commits", _COMMITS).agg(F.max(VERSION)).first()[0] or 0


def _replaced_buckets(log: DataFrame) -> dict[str, int]:
    """Version that a bucket starts from, for compacted buckets: at most ``16 ** digits`` of them."""
    found = log.where("kind = 'bucket'").groupBy(BUCKET).agg(F.max(VERSION).alias(VERSION)).collect()
    return {r[0]: r[1] for r in found}


def _without_replaced(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of no lower version than the last change of their key."""
    last = changes.groupBy(*key).agg(F.max(VERSION).alias("__changed"))
    if last.limit(MAX_BROADCAST_CHANGES + 1).count() <= MAX_BROADCAST_CHANGES:
        last = F.broadcast(last)
    kept = rows.join(last, key, "left").where(F.col("__changed").isNull() | (F.col(VERSION) >= F.col("__changed")))
    return kept.drop("__changed")


def stored_rows(spark: SparkSession, path: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that still count at a version, living or dead, and the log up to it."""
    data = _open(spark, f"{path}/data", _DATA).where(F.col(VERSION) <= version)
    log = _open(spark, f"{path}/log", _LOG).where(F.col(VERSION) <= version)
    for bucket, first in _replaced_buckets(log).items():
        # Both are folders, so the files of a compacted bucket's past are not even listed for reading.
        data = data.where(~((F.col(BUCKET) == bucket) & (F.col(VERSION) < first)))
    return data, log


def open_versions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunk table with each row's version, as of a version (default: the last).

    A table that does not exist yet is empty. Versions before a :func:`vacuum` are gone.
    """
    last = committed(spark, path)
    version = last if version is None else min(version, last)
    rows, log = stored_rows(spark, path, version)
    # A change concerns rows of lower versions; where all of them have been compacted away, there is nothing to merge.
    log = log.where(F.col(VERSION) > (rows.agg(F.min(VERSION)).first()[0] or 0))
    kinds = {r[0] for r in log.select("kind").distinct().collect()}
    if "document" in kinds:
        rows = _without_replaced(rows, log.where("kind = 'document'"), ["doc_key"])
    if "chunk" in kinds:
        rows = _without_replaced(rows, log.where("kind = 'chunk'"), ["doc_key", "ordinal"])
    return rows.select(*_DATA.names)


def open_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunk table as of a version (default: the last); one that does not exist yet is empty."""
    return open_versions(spark, path, version).select(*_STORED.names)


def _commit(spark: SparkSession, path: str, version: int, mode: str, changes: DataFrame | None) -> None:
    if changes is not None:
        changes.write.mode("overwrite").parquet(f"{path}/log/{VERSION}={version}")
    done = spark.createDataFrame([(mode,)], "mode string").coalesce(1)
    done.write.mode("overwrite").parquet(f"{path}/commits/{VERSION}={version}")


def table_embedding(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """Name and vector length of the embedding a table was made with, None where there is no table."""
    row = _open(spark, f"{path}/properties", _PROPERTIES).first()
    return None if row is None else (row["embedding"], row["dim"])


def save_chunks(
    spark: SparkSession, path: str, new: DataFrame, mode: str = "replace", digits: int = BUCKET_DIGITS,
    embedding: Embedding = TERM_COUNTS,
) -> None:
    """Write a batch of chunks as the table's next version; no stored file is read.

    Vectors that are missing are computed by ``embedding``, which has to be the table's own;
    the job fails on a vector of another length.

    ``replace`` drops every older chunk of the documents in the batch, so a document that
    got shorter leaves nothing behind; ``upsert`` replaces chunk by chunk; ``append`` is for
    documents known to be new. Documents are told apart by their full key; the short prefix of
    the chunk id is shared by some. An empty batch makes no version. A batch that failed before
    its commit is invisible, and the next one overwrites what it left.
    """
    kept = {"replace": ["doc_key"], "upsert": ["doc_key", "ordinal"], "append": None}[mode]
    known = table_embedding(spark, path)
    if known is None:
        made = spark.createDataFrame([(embedding.name, embedding.dim)], _PROPERTIES)
        made.coalesce(1).write.mode("overwrite").parquet(f"{path}/properties")
    elif known != (embedding.name, embedding.dim):
        raise ValueError(f"the table at {path} holds vectors of {known}, not of {(embedding.name, embedding.dim)}")
    # Rows are dealt to their buckets first: vectors that are computed here do not move.
    given = [f for f in CHUNK.fields if f.name in new.columns or f.name != "embedding"]
    dealt = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in given]).withColumn(
        BUCKET, bucket_of(F.col("chunk_prefix"), digits)
    )
    typed = complete_vectors(dealt.hint("rebalance", BUCKET), embedding).withColumn(
        "embedding", checked_dim(F.col("embedding"), embedding.dim)
    ).select(*_STORED.names)
    version = committed(spark, path) + 1
    folder = f"{path}/data/{VERSION}={version}"
    typed.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    written = spark.read.schema(_STORED).parquet(folder)
    if written.isEmpty():
        return
    changes = None
    if kept is not None and version > 1:
        # A chunk's ordinal is null in the log of whole documents.
        ordinal = F.col("ordinal") if mode == "upsert" else F.lit(None).cast("int")
        kind = F.lit("chunk" if mode == "upsert" else "document")
        changes = written.select(kind.alias("kind"), BUCKET, "doc_key", ordinal.alias("ordinal")).distinct()
    _commit(spark, path, version, mode, changes)


def compact(spark: SparkSession, path: str, dead_share: float = DEAD_SHARE) -> list[str]:
    """Write the living rows of buckets with many dead ones anew; the buckets that were compacted.

    Rows are counted by their narrow columns first; buckets below the share are not read any
    further. Files lie in buckets already, so rows are filtered where they are read; only buckets
    of small files are shuffled, to merge those. The content of the table stays the same.
    """
    last = committed(spark, path)
    if not last:
        return []
    stored, _ = stored_rows(spark, path, last)
    living = open_versions(spark, path)
    n = F.count(F.lit(1))
    file = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    files = stored.select(BUCKET, *file).groupBy(BUCKET, "file", "size").agg(n.alias("rows"))
    sizes = files.groupBy(BUCKET).agg(F.sum("rows").alias("stored"), F.avg("size").alias("size"))
    counts = sizes.join(living.groupBy(BUCKET).agg(n.alias("living")), BUCKET, "left")
    dead = F.col("stored") - F.coalesce("living", F.lit(0))
    found = counts.where((dead > 0) & (dead >= F.col("stored") * dead_share)).select(BUCKET, "size").collect()
    chosen = sorted(r[0] for r in found)
    if not chosen:
        return []
    rows, small = living.select(*_STORED.names), sorted(r[0] for r in found if r[1] < SMALL_FILE)
    kept = rows.where(F.col(BUCKET).isin([b for b in chosen if b not in small]))
    merged = rows.where(F.col(BUCKET).isin(small)).hint("rebalance", BUCKET)
    written = merged if len(small) == len(chosen) else kept.union(merged) if small else kept
    written.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/{VERSION}={last + 1}")
    entries = spark.createDataFrame([("bucket", b, None, None) for b in chosen], T.StructType(_LOG.fields[:-1]))
    _commit(spark, path, last + 1, "compact", entries.coalesce(1))
    return chosen


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the folders of compacted buckets that no reader of the last version needs; their number.

    Older versions can no longer be opened afterwards.
    """
    log = _open(spark, f"{path}/log", _LOG).where(F.col(VERSION) <= committed(spark, path))
    removed = 0
    for bucket, first in _replaced_buckets(log).items():
        for version in range(1, first):
            removed += remove_folder(spark, f"{path}/data/{VERSION}={version}/{BUCKET}={bucket}")
    return removed


def get_chunks(table: DataFrame, ids: list[str], include: list[str], digits: int = BUCKET_DIGITS) -> DataFrame:
    """Chunks by id with the asked columns; only the ids' buckets and those columns are read."""
    wanted = table.where(F.col("chunk_id").isin(ids))
    if BUCKET in table.columns:
        wanted = wanted.where(F.col(BUCKET).isin(sorted({i[:digits] for i in ids})))
    return wanted.select("chunk_id", *include)


def get_chunks_of(table: DataFrame, ids: DataFrame, include: list[str], digits: int | None = None) -> DataFrame:
    """Chunks whose ids are in a table of ids, with the asked columns.

    With the number of ``digits`` of the table's buckets, the join is on the bucket too, so that
    the buckets of a short list are found at run time and no others are read.
    """
    wanted = ids.select("chunk_id").distinct()
    if digits is None or BUCKET not in table.columns:
        return table.join(wanted, "chunk_id", "left_semi").select("chunk_id", *include)
    keyed = wanted.withColumn(BUCKET, bucket_of(F.col("chunk_id"), digits))
    return table.join(keyed, [BUCKET, "chunk_id"], "left_semi").select("chunk_id", *include)


def count_chunks(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_key").alias("documents"))


def load_mapping(spark: SparkSession, path: str, cache_enabled: bool = True) -> DataFrame:
    """The document-to-cache mapping; empty while the cache is off or if it cannot be read."""
    if not cache_enabled:
        return spark.createDataFrame([], CACHE_MAP)
    return _open(spark, path, CACHE_MAP)


def save_mapping(mapping: DataFrame, path: str, cache_enabled: bool = True) -> None:
    """Overwrite the mapping table; the new content may derive from the old."""
    if cache_enabled:
        cut_lineage(mapping.select(*CACHE_MAP.names)).write.mode("overwrite").parquet(path)
