"""Session factory and the lineage-cutting helper every multi-pass operator uses."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "lexiloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with the settings the library assumes.

    Shuffle partitions are left to AQE: a high initial number that is coalesced at run
    time, so that one setting holds from a laptop to a large cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests,
    single-machine trials) a temporary folder is used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-ckpt-"))
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written table.

    The copy is columnar: passes that need a few columns read only those, and a lost
    executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, under the shared checkpoint folder."""
    unique = f"{name}-{os.urandom(6).hex()}"
    return f"{checkpoint_root(spark).rstrip('/')}/{unique}"


def store_of(spark: SparkSession, path: str):
    """The store a path lies in, and the path in its terms."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folders_in(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names of the folders in a folder of any store; only those a writer has finished, if asked."""
    files, place = store_of(spark, path)
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place) if s.isDirectory()]
    done = [f for f in found if not finished or files.exists(store_of(spark, f"{f}/_SUCCESS")[1])]
    return sorted(f.getName() for f in done)


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder of any store with all it holds; whether there was one."""
    files, place = store_of(spark, path)
    return bool(files.delete(place, True))
