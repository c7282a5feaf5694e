"""Acquiring a bounded number of rows from a folder of unbounded size, as a stream that stops early."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import file_system


def acquire(spark: SparkSession, folder: str, schema: str, n: int, keep: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1) -> int:
    """Write to ``out`` the first n rows that ``keep`` makes of a folder's parquet files, reading files only until they are found.

    Each batch of files writes its own folder, so a batch that is repeated after a failure replaces what
    it wrote, and a call that continues an earlier one takes only what is still missing. Returns the
    number of rows in ``out``: fewer than n if the folder has no more.
    """
    fs, root = file_system(spark, out)
    have = {}

    def count(batch: str) -> int:
        return spark.read.parquet(f"{out}/{batch}").count()

    if fs.exists(root):
        have = {x.getPath().getName(): count(x.getPath().getName()) for x in fs.listStatus(root) if x.getPath().getName().startswith("batch-")}

    def take(rows: DataFrame, number: int) -> None:
        name = f"batch-{number:08d}"
        left = n - sum(v for k, v in have.items() if k != name)
        if left > 0:
            keep(rows).limit(min(left, (1 << 31) - 1)).write.mode("overwrite").parquet(f"{out}/{name}")
            have[name] = count(name)

    if sum(have.values()) < n:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        while query.isActive and sum(have.values()) < n:
            time.sleep(0.1)
        if query.isActive:
            query.stop()
        query.awaitTermination()
    return sum(have.values())
