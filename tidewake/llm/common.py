"""Shared plumbing: size-checked broadcasts, Arrow text batches, repeated rows; intermediates are written by ``sources.scratch``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, measured, scratch_path, scratch_root, settle, written

checkpoint_dir, materialize = scratch_root, written
__all__ = ["ascii_lower", "broadcast_if_small", "checkpoint_dir", "discard", "fresh", "groups_by_size", "materialize", "measured", "repeated", "scratch_path", "settle", "small_batches", "utf8"]

#: Rows up to which a table of a few fixed-width columns is broadcast (under 32 MB as a hash table).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Bytes of rows that go to a Python worker, and come back, together; a longer row goes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting (tables that were just written have been); larger tables keep the shuffled join.

    Where a table with rows of any length was written with the measure ``bytes``, these are bounded too.
    """
    known = measured(df)
    if known and (known.get("bytes") or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if (known["rows"] if known else df.limit(limit + 1).count()) <= limit else df


def repeated(df: DataFrame, copies: str, part: int = 1024) -> DataFrame:
    """Each row ``copies`` times, numbered from 0 in the column ``copy``. Copies are made in parts,
    so that no array is longer than ``part`` or the number of parts."""
    n = F.col(copies).cast("bigint")
    (at,) = fresh(df, "copy_part")
    parts = df.withColumn(at, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / part))))
    inner = F.sequence(F.col(at) * part, F.least(F.col(at) * part + part - 1, n - 1))
    return parts.withColumn("copy", F.explode(inner)).drop(at)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about ``BATCH_BYTES``, unless it has a limit of its own.

    Spark's own limit is 10,000 rows, tens of MB of texts, which an executor holds for every task at once: in
    buffers that its JVM doubles and copies outside the heap, and several times over in the Python worker.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null reads as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def groups_by_size(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most limit bytes, or a single larger text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's, ignoring case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
