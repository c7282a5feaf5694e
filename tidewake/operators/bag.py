"""The commonest terms of texts, and the texts as sparse rows over them, without a shuffle of texts or of their terms.

64-bit hashes stand for terms while they are counted. A first pass over the texts adds up the counts of buckets of hashes,
which bound those of their terms from above, and what each task knows of its commonest terms, which bounds them from
below: a term whose bucket holds less than the ``size``-th largest of the lower bounds is not among the ``size`` commonest.
A second pass counts the others, few more than ``size``, as they are written. Rows then are made where the texts are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, measured, written

#: Buckets at most, and characters of texts for each of fewer; terms counted at a time; slices of buckets and hashes that are added up each by itself.
BUCKETS, SPREAD, BLOCK, SLICES = 1 << 22, 16, 1 << 20, 32
#: Ids that are broadcast at most.
SMALL = 200_000


def by_id(docs: DataFrame, terms: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """blob_id, labels, terms: a row for each id, with the terms of all its texts; and what is written for it. Only texts whose id repeats are shuffled."""
    again = written(docs.groupBy("blob_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("blob_id").alias("_again")), "bag-again")
    docs = docs.select("blob_id", "label", "text")
    if not measured(again)["rows"]:
        return docs.select("blob_id", F.array("label").alias("labels"), terms(F.col("text")).alias("terms")), again
    sent = F.broadcast(again) if measured(again)["rows"] <= SMALL else again
    same = F.col("blob_id").eqNullSafe(F.col("_again"))
    once = docs.join(sent, same, "left_anti").select("blob_id", F.array("label").alias("labels"), terms(F.col("text")).alias("terms"))
    several = docs.join(sent, same, "left_semi").groupBy("blob_id").agg(F.collect_list("label").alias("labels"), F.collect_list("text").alias("texts"))
    return once.unionByName(several.select("blob_id", "labels", F.flatten(F.transform("texts", terms)).alias("terms"))), again


def hashed(terms: str | Column = "terms") -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and the row of each."""
    n = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


def commonest(rows: DataFrame, size: int, characters: int) -> DataFrame:
    """term, cf, df of the ``size`` terms of the highest number of occurrences in rows (terms) (ties: the smaller term)."""
    buckets = 1 << max(SLICES.bit_length(), min(BUCKETS.bit_length() - 1, (characters // SPREAD).bit_length()))
    kind = pa.schema([("slice", pa.int32()), ("h", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("sums", pa.binary())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, top = np.zeros(buckets, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def put(held: list[np.ndarray]) -> None:
            nonlocal sums, top
            found, n = np.unique(np.concatenate(held), return_counts=True)
            sums += np.bincount(found.view(np.uint64) % np.uint64(buckets), weights=n, minlength=buckets).astype(np.int64)
            keys, n = _summed(np.concatenate([top[0], found]), np.concatenate([top[1], n]))
            best = np.argsort(-n, kind="stable")[: 4 * size]  # what is left out only lowers a lower bound
            top = keys[best], n[best]

        held, n = [], 0
        for batch in batches:
            h, _ = _flat(batch.column("h"))
            for at in range(0, len(h), BLOCK):
                held.append(h[at : at + BLOCK])
                n += len(held[-1])
                if n >= BLOCK:
                    put(held)
                    held, n = [], 0
        if n:
            put(held)
        best = np.argsort(-top[1], kind="stable")[: 2 * size]
        keys, n = top[0][best], top[1][best]
        part = keys.view(np.uint64) % np.uint64(SLICES)
        for k, own in enumerate(np.split(sums, np.linspace(0, buckets, SLICES + 1).astype(int)[1:-1])):
            at = part == k
            data = pa.compress(own.tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([k], [keys[at]], [n[at]], [data]), kind, strict=True)], schema=kind)

    ends = np.linspace(0, buckets, SLICES + 1).astype(int)

    def add(table: pa.Table) -> pa.Table:
        k = table.column("slice")[0].as_py()
        keys, n = _summed(*(table.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "n")))
        best, width = np.argsort(-n, kind="stable")[:size], int(ends[k + 1] - ends[k])
        sums = sum((np.frombuffer(pa.decompress(x.as_buffer(), 8 * width, "zstd"), np.int64) for x in table.column("sums")), np.zeros(width, np.int64))
        return pa.table([pa.array(x, f.type) for x, f in zip(([k], [keys[best]], [n[best]], [sums.tobytes()]), kind, strict=True)], schema=kind)

    arrays = "slice int, h array<bigint>, n array<bigint>, sums binary"
    seen = rows.select(hashed().alias("h")).mapInArrow(first, arrays).groupBy("slice").applyInArrow(add, arrays)
    seen = written(seen, "bag-buckets")
    lower = np.sort(seen.select(F.explode("n").alias("n")).orderBy(F.desc("n")).limit(size).toArrow().column("n").to_numpy())
    least = int(lower[0]) if len(lower) == size else 1
    sums = [np.frombuffer(r["sums"], np.int64) for r in seen.select("slice", "sums").orderBy("slice").toLocalIterator()]  # at most BUCKETS numbers
    may = rows.sparkSession.sparkContext.broadcast(np.packbits(np.concatenate([s >= least for s in sums]) if sums else np.zeros(buckets, bool)))
    discard(seen)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(may.value).astype(bool)
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            """Of the terms held (hashes, rows, terms): each with its occurrences and its rows."""
            h = np.concatenate([x[0] for x in held])
            found, place, which = np.unique(h, return_index=True, return_inverse=True)
            row = np.concatenate([x[1] + (i << 32) for i, x in enumerate(held)])
            pairs = np.lexsort((row, which))
            new = np.append(True, (np.diff(which[pairs]) != 0) | (np.diff(row[pairs]) != 0)) if len(pairs) else np.zeros(0, bool)
            df = np.bincount(which[pairs][new], minlength=len(found))
            terms = pa.concat_arrays([x[2] for x in held]).take(pa.array(place))
            return pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(np.bincount(which, minlength=len(found)).astype(np.int64)), pa.array(df.astype(np.int64))], names=["term", "cf", "df"])

        for batch in batches:
            h, row = _flat(batch.column("h"))
            at = np.flatnonzero(bits[h.view(np.uint64) % np.uint64(buckets)])
            if len(at):
                held.append((h[at], row[at], batch.column("terms").flatten().take(pa.array(at))))
                n += len(at)
            if n >= BLOCK:
                yield counted()
                held, n = [], 0
        if n:
            yield counted()

    counts = rows.select("terms", hashed().alias("h")).mapInArrow(second, "term string, cf bigint, df bigint")
    return counts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).orderBy(F.desc("cf"), "term").limit(size)


class Bags:
    """Texts as sparse rows over a vocabulary (idx, h: the term's hash, df) of ``n`` texts: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per text."""

    def __init__(self, vocab: DataFrame, n: int) -> None:
        table = vocab.select("idx", F.xxhash64("term").alias("h"), "df").toArrow()  # as many as the terms
        h, idx, df = (table.column(c).to_numpy() for c in ("h", "idx", "df"))
        order = np.argsort(h)
        self.idf = np.zeros(len(h))
        self.idf[idx] = np.log((1.0 + n) / (1 + df)) + 1
        self.keys, self.idx = h[order], idx[order].astype(np.int64)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, idx, tf of lists of hashes, in the order of rows and of idx."""
        h, row = _flat(column)
        if not len(self.keys) or not len(h):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        both, tf = np.unique(row[known] * len(self.keys) + self.idx[at[known]], return_counts=True)
        return both // len(self.keys), both % len(self.keys), tf

    def weights(self, row: np.ndarray, idx: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        w = (1 + np.log(np.arange(1.0, int(tf.max(initial=0)) + 1)))[tf.astype(np.int64) - 1] * self.idf[idx]  # few different tf
        return w / np.sqrt(np.bincount(row, weights=w * w, minlength=n))[row]
