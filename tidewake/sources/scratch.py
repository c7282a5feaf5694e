"""Written intermediates in the folder that all executors share.

The cluster names the folder in ``spark.checkpoint.dir``. Only a local master, whose executors are
threads of the driver, may do without: a temporary folder is then made. What is written is deleted by
``discard`` as soon as nothing reads it, and by Hadoop's file systems when the session's JVM ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def needs_shared_folder(master: str) -> bool:
    """Whether executors run outside the driver, so that no folder of the driver's machine will do."""
    return master != "local" and not master.startswith("local[")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one on a local master where none is set, and an error on any other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        if needs_shared_folder(master := spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewake-")
        spark.sparkContext.setCheckpointDir(found)
        fs, at = file_system(spark, found)
        fs.deleteOnExit(at)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, deleted when the JVM ends."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str, **measures: Column) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors.

    The rows, and further aggregates, are measured while they are written; ``measured`` has them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()]).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path, out._scratch_measures = path, seen.get
    return out


def measured(df: DataFrame) -> dict | None:
    """``rows`` and further aggregates of what ``written`` returned; None for any other frame."""
    return getattr(df, "_scratch_measures", None) if isinstance(getattr(df, "_scratch_path", None), str) else None


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` has written for these frames; nothing may read them any more."""
    for df in frames:
        fs, at = file_system(df.sparkSession, df._scratch_path)
        fs.delete(at, True)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and plans of finished jobs: its cleaner learns from the driver's
    garbage collection that nothing holds them any more. For loops of many jobs."""
    gc.collect()
    spark._jvm.System.gc()
