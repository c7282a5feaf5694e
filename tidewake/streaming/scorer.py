"""Scoring documents as they arrive: a file stream through a fitted attack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, source: str, schema: str, score, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append score(batch) of each micro-batch of new parquet files to ``sink``.

    Batches are written under their number, so a batch that is run again after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
