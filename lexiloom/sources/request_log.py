"""Request log: import of daily JSON arrays, and the date-partitioned Parquet log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexiloom.functions.scalars import or_today
from lexiloom.operators.ordering import running_sum
from lexiloom.schemas import REQUEST_LOG
from lexiloom.session import cut_lineage


def read_json_days(spark: SparkSession, directory: str) -> DataFrame:
    """Daily files ``requests_<yyyy-MM-dd>.json`` as log records with ``log_date``.

    A file that is no JSON array, or is damaged, contributes no rows.
    """
    files = spark.read.option("pathGlobFilter", "requests_*.json").text(directory, wholetext=True)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"requests_(\d{4}-\d{2}-\d{2})\.json", 1)
    arrays = files.where(F.ltrim("value").startswith("[")).select(
        F.try_to_date(day, "yyyy-MM-dd").alias("log_date"),
        F.explode(F.from_json("value", T.ArrayType(REQUEST_LOG))).alias("r"),
    )
    return arrays.select("log_date", "r.*").where(F.col("request_id").isNotNull())


_PIECES = "file string, split long, nth long, edge boolean, lines string"


def _gather(indent: int):
    """Lines of a split put together to the elements, or parts of elements, that lie in it.

    ``nth`` counts the elements that a split opens; piece 0 goes on with what the split before
    left open. That one and a split's last are ``edge``: they may be parts. Every split has a row.
    """
    opening = " " * indent + "{"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, nth, held = None, 0, []
        made: list[tuple] = []

        def close(last: bool) -> None:
            if where is not None and (held or last):
                made.append((*where, nth, last or nth == 0, "\n".join(held) if held else None))
            held.clear()

        def told() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            rows = pa.RecordBatch.from_arrays(
                [pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names=["file", "split", "nth", "edge", "lines"]
            )
            made.clear()
            return rows

        for batch in batches:
            for file, split, line in zip(*(column.to_pylist() for column in batch.columns)):
                if (file, split) != where:
                    close(last=True)
                    where, nth = (file, split), 0
                line = line.rstrip(" ")
                if line.startswith(opening):
                    close(last=False)
                    nth += 1
                if line not in ("[", "]"):
                    held.append(line)
            yield told()
        close(last=True)
        yield told()

    return run


def split_json_days(spark: SparkSession, directory: str, indent: int = 2) -> DataFrame:
    """Elements of daily files, one a row: ``log_date, element, body, record``.

    For arrays larger than a cell. The files are read line by line, by as many tasks as they have
    splits; only elements that lie across splits are shuffled. Their arrays are written one element
    below the other, ``indent`` deep: the line that opens an element has that many blanks and a
    brace, and no line inside one has. ``record`` is null where an element cannot be read: a
    damaged element costs no other.
    """
    lines = spark.read.option("pathGlobFilter", "requests_*.json").text(directory)
    # The lines of a split come in order; splits are known by their start.
    placed = lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    pieces = cut_lineage(placed.mapInArrow(_gather(indent), _PIECES))
    opened = pieces.groupBy("file", "split").agg(F.max("nth").alias("opened"))
    opened = running_sum(opened, ["file"], ["split"], "opened", "before", inclusive=False)
    numbered = pieces.join(opened, ["file", "split"]).withColumn("element", F.col("nth") + F.col("before")).where("element > 0")
    # Only what lies at the ends of a split may be part of an element that another one holds too.
    whole = numbered.where(~F.col("edge")).select("file", "element", "lines")
    held = F.transform(F.array_sort(F.collect_list(F.struct("split", "lines"))), lambda x: x["lines"])
    joined = numbered.where("edge").groupBy("file", "element").agg(F.array_join(held, "\n").alias("lines"))
    bodies = whole.union(joined).select("file", "element", F.regexp_replace("lines", r"[,\s]+\z", "").alias("body"))
    day = F.try_to_date(F.regexp_extract("file", r"requests_(\d{4}-\d{2}-\d{2})\.json", 1), "yyyy-MM-dd")
    read = F.from_json("body", REQUEST_LOG)
    return bodies.select(day.alias("log_date"), "element", "body", F.when(read["request_id"].isNotNull(), read).alias("record"))


def json_records(elements: DataFrame) -> DataFrame:
    """Log records of the elements that could be read."""
    return elements.where("record is not null").select("log_date", "record.*")


def damaged_elements(elements: DataFrame) -> DataFrame:
    """Elements that could not be read, with their text."""
    return elements.where("record is null").select("log_date", "element", "body")


def append_log(records: DataFrame, path: str) -> None:
    """Append records to the log, one folder per day; no existing file is read."""
    dated = records if "log_date" in records.columns else records.withColumn("log_date", F.to_date("timestamp"))
    dated.hint("rebalance", "log_date").write.partitionBy("log_date").mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType, day: str | None = None) -> DataFrame:
    """The log, or one day of it; the day is pruned to its folder. A missing log is empty."""
    try:
        log = spark.read.schema(schema).parquet(path)
    except Exception as failure:
        if "PATH_NOT_FOUND" not in str(failure):
            raise
        log = spark.createDataFrame([], schema)
    return log if day is None else log.where(F.col("log_date") == F.lit(day).cast("date"))


def records_of_day(log: DataFrame, day: str | None = None) -> DataFrame:
    """Records of a day, today if none is given."""
    return log.where(F.col("log_date") == or_today(F.lit(day).cast("string")).cast("date"))
