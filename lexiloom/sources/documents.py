"""Document sources: a Markdown directory, one file, a directory of cacheable files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from lexiloom.functions.urls import chunk_id, chunk_prefix, doc_basename, document_key
from lexiloom.operators.cache import get_or_create
from lexiloom.operators.chunking import semantic_chunks
from lexiloom.operators.ordering import row_numbers
from lexiloom.session import cut_lineage, store_of

#: Bytes, and files, that a task reads about.
READ_BYTES = 64 << 20
READ_FILES = 20_000
_LISTED_AT_ONCE = 10_000
_SENT_BYTES = 8 << 20
#: Characters of a file's name that its address holds in escaped form.
_ESCAPED = re.compile(r"[^\w\-!.~'()*:@&=+$,;/\u0080-\U0010ffff]|[\u0080-\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", re.ASCII)
_LISTED = "url string, path string, size long"  # a folder has no size
_READ = "url string, content binary"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Every ``.md`` file below a directory (or one file) as ``url, text, metadata``.

    Folders are listed by tasks into a table, level by level, so the driver holds no name of a file.
    A pattern of paths, and a store that only Spark can open, are listed by Spark on the driver.
    """
    place = None if _is_file_or_pattern(spark, path) else _arrow_store(spark, path)
    if place is None:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
        url, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    else:
        files = _contents(_files_below(spark, *place).where(F.col("path").endswith(".md")), place[0])
        url, name = F.col("url"), F.substring_index("url", "/", -1)
    return files.select(url.alias("url"), F.col("value").alias("text"), F.create_map(F.lit("file_name"), name).alias("metadata"))


def _is_file_or_pattern(spark: SparkSession, path: str) -> bool:
    """Also where there is nothing, which Spark's reader reports."""
    store, place = store_of(spark, path)
    return not store.exists(place) or not store.getFileStatus(place).isDirectory()


def _arrow_store(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str, str] | None:
    """The store of a folder as Arrow opens it in tasks, its path there and its address in Spark; None where Arrow cannot."""
    store, place = store_of(spark, path)
    whole = store.makeQualified(place)
    if whole.toUri().getScheme() == "file":
        return fs.LocalFileSystem(), whole.toUri().getPath(), "file:" + _escaped(whole.toUri().getPath())
    try:
        return *fs.FileSystem.from_uri(whole.toUri().toString()), whole.toUri().toString()
    except (OSError, ValueError, NotImplementedError):
        return None


def _is_hidden(name: str, is_folder: bool) -> bool:
    """Names that Spark's readers leave out of a folder, too."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _escaped(name: str) -> str:
    return _ESCAPED.sub(lambda c: quote(c[0], safe=""), name)


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with the size of files; a local folder is read name by name."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.name, None
                elif entry.is_file():  # not a link to nothing
                    yield entry.name, entry.stat().st_size
    else:
        for info in store.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, None if info.type == fs.FileType.Directory else info.size


def _files_below(spark: SparkSession, store: fs.FileSystem, path: str, url: str) -> DataFrame:
    """Files of some content below a folder: ``url, path, size``. A folder is listed in one task, which sends on its names as they come."""
    names = pa.schema([("url", pa.string()), ("path", pa.string()), ("size", pa.int64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, folder in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                found = (entry for entry in _entries(store, folder) if not _is_hidden(entry[0], entry[1] is None) and entry[1] != 0)
                while some := list(islice(found, _LISTED_AT_ONCE)):
                    rows = [(f"{at.rstrip('/')}/{_escaped(name)}", f"{folder.rstrip('/')}/{name}", size) for name, size in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.types)], schema=names)

    folders, files = spark.createDataFrame([(url, path)], "url string, path string"), None
    while not folders.isEmpty():
        found = cut_lineage(folders.mapInArrow(listed, _LISTED))
        below = found.where(F.col("size").isNotNull())
        files = below if files is None else files.unionByName(below)
        folders = found.where(F.col("size").isNull()).select("url", "path").repartition(spark.sparkContext.defaultParallelism, "url")
    return files


def _contents(files: DataFrame, store: fs.FileSystem) -> DataFrame:
    """``url, value`` of listed files, read by as many tasks as their number and size ask for."""
    count, size = files.agg(F.count(F.lit(1)), F.sum("size")).first()
    tasks = max(min(count, files.sparkSession.sparkContext.defaultParallelism), -(-count // READ_FILES), -(-(size or 0) // READ_BYTES), 1)
    schema = pa.schema([("url", pa.string()), ("content", pa.binary())])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for batch in batches:
            for url, path in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                with store.open_input_stream(path, compression=None) as source:
                    held.append((url, source.read()))
                bytes_held += len(held[-1][1])
                if bytes_held >= _SENT_BYTES or len(held) >= _LISTED_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held, bytes_held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    read = files.select("url", "path").repartition(tasks, "url").mapInArrow(contents, _READ)
    return read.select("url", F.col("content").cast("string").alias("value"))


def read_sections(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Lines of the files below a directory as ``url, part, text, metadata``, for files larger than a row.

    Large files are read by several tasks. ``part`` orders the lines of a file: the start of
    the split and the line's place in it. Every line ends with a line feed, the last one too.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    )
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(
        F.col("_metadata.file_path").alias("url"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), place.alias("line")).alias("part"),
        F.concat("value", F.lit("\n")).alias("text"),
        F.create_map(F.lit("file_name"), F.col("_metadata.file_name")).alias("metadata"),
    )


def write_files(texts: DataFrame, directory: str, name: str = "file_name", text: str = "text") -> None:
    """Write one file per row into a shared directory; a repeated task writes the same files."""

    def write(rows: Iterator[Row]) -> None:
        target, base = fs.FileSystem.from_uri(directory)
        target.create_dir(base, recursive=True)
        for file_name, content in rows:
            with target.open_output_stream(f"{base}/{file_name}") as out:
                out.write(content.encode("utf-8"))

    texts.select(name, text).foreachPartition(write)


def directory_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks of a whole directory under one prefix, numbered across its files.

    Files are numbered in path order. The running number comes from slice counts, so a
    directory is never sorted in one task.
    """
    chunks = cut_lineage(semantic_chunks(read_markdown(spark, directory)))
    numbered = row_numbers(chunks, [], ["url", "ordinal"], "position")
    prefix = chunk_prefix(F.lit(directory))
    ordinal = (F.col("position") - 1).cast("int")
    return numbered.select(
        chunk_id(prefix, ordinal).alias("chunk_id"), prefix.alias("chunk_prefix"), document_key(F.lit(directory)).alias("doc_key"), ordinal.alias("ordinal"),
        "text", "embedding", "metadata", "url",
    )


def directory_cache_map(spark: SparkSession, directory: str, mapping: DataFrame) -> DataFrame:
    """File name to cache name for the regular files of one directory level; failures drop out."""
    files = spark.read.format("binaryFile").load(directory).select(F.col("path").alias("url"))
    named, _ = get_or_create(files, mapping)
    return named.where(F.col("cache_name").isNotNull()).select(doc_basename(F.col("url")).alias("file_name"), "cache_name")
