"""File metadata without reading file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.dimensions import LARGE_FILE_BYTES
from lexiloom.functions.scalars import round2
from lexiloom.functions.urls import file_extension


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Path, extension, size and size class of every file below ``path``; contents are pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = file_extension(F.col("path"))
    return files.select(
        "path",
        ext.alias("extension"),
        F.col("length").alias("size_bytes"),
        round2(F.col("length") / (1024 * 1024)).alias("size_mb"),
        (ext == ".pdf").alias("is_pdf"),
        (F.col("length") > LARGE_FILE_BYTES).alias("is_large_file"),
    )


def metadata_for(paths: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of the asked paths; a missing file has NULLs."""
    return paths.join(metadata, "path", "left")
