"""Exact dedup against a history of distinct digests held in minimal perfect hashes.

The history is cut into shards by digest. A shard's keys are hashed into a bit array; keys alone in
their bit are placed there, the others go to a next, smaller array, until none are left. The rank of a
key's bit among all set bits is its slot: n keys have the slots 0 to n - 1. A slot holds the full
SHA-256, the locator of the winner (its id) and the number of rows so far. Shards are rows of an ordinary table
(``build``), which a later batch is looked up in and merged with (``merge``).

A digest looked up reaches some slot whether it is a member or not; all its 32 bytes are compared
with the slot's. Members are repeats of the history, nonmembers are grouped by digest on their own. Rows are
counted by id and digest before they are dealt, so a group of copies reaches a shard as one row, and
a shard has about ``SHARD`` digests at any size of the tables.

Texts are equal when identical after each run of blanks is replaced by one space; the SHA-256 of the
UTF-8 stands for the text. Of equal texts the row with the smallest id stays. Defined cases: null is the
empty text; rows of equal texts and equal ids are repeats of each other, and one of them stays; null
ids come last, so a row without an id stays only where no equal text has one. An empty table, or
an empty history, gives what the other part gives. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, measured, repeated

#: Digests of a shard, on average.
SHARD = 1 << 15
#: Bits of an array for each key that goes into it.
ROOM = 2
_STEP = 0x9E3779B97F4A7C15


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, copies): rows counted by id and digest."""
    rows = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))


class PerfectHash:
    """A minimal perfect hash of distinct digests, given as rows of four 64-bit words."""

    def __init__(self, sizes: list[int], bits: bytes) -> None:
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - self.bits
        self.starts = np.cumsum([0, *sizes])

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        h = (words[:, level % 4] + np.uint64((level + 1) * _STEP % 2**64)) ^ (words[:, (level + 1) % 4] >> np.uint64(1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        sizes, arrays, left, level = [], [], words, 0
        while len(left):
            size = max(8, ROOM * len(left))
            at = cls._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(alone)
            left, level = left[~alone[at]], level + 1
        return cls(sizes, np.packbits(np.concatenate(arrays)).tobytes() if arrays else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each member, and of each nonmember some slot or -1."""
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, size in enumerate(self.sizes):
            at = self._place(words[open_], level, size) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def _as_words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests of 32 bytes as rows of four words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, digest, winner, n) of each distinct digest."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.sum("copies").alias("n"))
    return groups.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "winner", "n")


def _index_schema(key: T.DataType) -> T.StructType:
    kinds = {"shard": T.IntegerType(), "sizes": T.ArrayType(T.IntegerType()), "bits": T.BinaryType(), "digests": T.BinaryType(), "winners": T.ArrayType(key), "counts": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(c, k) for c, k in kinds.items()])


def build(rows: DataFrame, shards: int, tag: str = "exact-history") -> DataFrame:
    """The history of what ``digests`` returned, one written row per shard."""
    schema = _index_schema(rows.schema["doc_id"].dataType)

    def shard(table: pa.Table) -> pa.Table:
        words = _as_words(table.column("digest"))
        perfect = PerfectHash.of(words)
        order = np.argsort(perfect.slots(words))
        winners, counts = table.column("winner").combine_chunks().take(order), table.column("n").combine_chunks().take(order)
        one = lambda values: pa.array([values.to_pylist()], pa.list_(values.type))
        row = {
            "shard": table.column("shard").slice(0, 1), "sizes": pa.array([perfect.sizes], pa.list_(pa.int32())), "bits": pa.array([perfect.packed()], pa.binary()),
            "digests": pa.array([words[order].tobytes()], pa.binary()), "winners": one(winners), "counts": one(counts),
        }
        return pa.table(row)

    return materialize(_grouped(rows, shards).groupBy("shard").applyInArrow(shard, schema), tag)


def merge(history: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, n, known) of each distinct digest of the history and of a new batch's rows; known: it is in the history."""
    key = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("winner", key), T.StructField("n", T.LongType()), T.StructField("known", T.BooleanType())])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        digest, winner, n = (right.column(c).combine_chunks() for c in ("digest", "winner", "n"))
        if not len(left):
            return pa.table({"digest": digest, "winner": winner, "n": n, "known": pa.array([False] * len(digest), pa.bool_())})
        held = left.to_pylist()[0]
        old, new = np.frombuffer(held["digests"], np.uint64).reshape(-1, 4), _as_words(digest)
        slot = PerfectHash(held["sizes"], held["bits"]).slots(new)
        member = slot >= 0
        member[member] = (old[slot[member]] == new[member]).all(axis=1)
        winners, counts = held["winners"], held["counts"]
        for at, who, more in zip(slot[member].tolist(), winner.filter(pa.array(member)).to_pylist(), n.filter(pa.array(member)).to_pylist(), strict=True):
            counts[at] += more
            if who is not None and (winners[at] is None or who < winners[at]):
                winners[at] = who
        outside = pa.array(~member)
        return pa.table({
            "digest": pa.concat_arrays([pa.array((old[i].tobytes() for i in range(len(old))), pa.binary()), digest.filter(outside).cast(pa.binary())]),
            "winner": pa.concat_arrays([pa.array(winners, winner.type), winner.filter(outside)]),
            "n": pa.concat_arrays([pa.array(counts, pa.int64()), n.filter(outside)]),
            "known": pa.array([True] * len(old) + [False] * int((~member).sum()), pa.bool_()),
        })

    return history.groupBy("shard").cogroup(_grouped(rows, shards).groupBy("shard")).applyInArrow(look, schema)


def report(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Half of the ids, by hash, are the history; the other half comes as a new batch. The result does not
    depend on the cut.
    """
    rows = materialize(digests(docs), "exact-rows")
    shards = max(1, math.ceil(measured(rows)["rows"] / shard))
    past = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True))
    history = build(rows.filter(past), shards)
    winners = materialize(merge(history, rows.filter(~past), shards).filter("n > 1").drop("known"), "exact-winners")
    # Only digests of more than one row have a winner other than the row itself; both sides are plain scans, so a large group is split.
    met = rows.join(winners, "digest", "left")
    alone = F.col("n").isNull()
    met = met.select(
        "doc_id", "copies", F.when(alone, F.col("doc_id")).otherwise(F.col("winner")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("doc_id").eqNullSafe(F.when(alone, F.col("doc_id")).otherwise(F.col("winner"))).alias("wins"),
    )
    out = repeated(met, "copies").select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 0)).alias("kept"), "text_sha256")
    out = materialize(out, "exact-out")
    discard(rows, history, winners)
    return out


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
