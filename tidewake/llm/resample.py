"""Quality selection by importance resampling.

Two hashed n-gram models (words and word pairs in ``BUCKETS`` buckets, add-one smoothing) are counted
over all documents: one of the target texts (documents labelled of good quality), one of the raw
corpus. A document's importance is the log ratio of its n-grams under the two; adding Gumbel noise
drawn from its id, its text and the number of its copy, and keeping the k largest sums samples rows
without replacement in proportion to importance. The k-th largest sum is found by narrowing histograms, not by a sort.

Defined cases: null and empty texts have no n-grams and importance zero; null labels and labels
without a document count for nothing; a document that several labels disagree on is a target;
repeated rows are counted and scored as they are, each with noise of its own; ids may be null, repeat and
be of any type; exact ties with the k-th sum stay, so more than k rows can; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import broadcast_if_small, groups_by_size, materialize, repeated, utf8

BUCKETS = 1 << 14
KEEP = 0.8
SEED = 11
_CHUNK = 1 << 20


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each word and each pair of words."""
    data = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
    _, starts, _, h = kernels.words(data)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(bounds, starts, side="right") - 1
    pairs = kernels.rolling(h, 2)
    same = doc[1:] == doc[:-1]
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([doc, doc[1:][same]]), np.concatenate([h & mask, pairs[same] & mask]).astype(np.int64)


def model(docs: DataFrame) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket; docs: text, target (boolean)."""

    def count(batches):
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            texts, target = utf8(batch.column("text")), batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in groups_by_size(texts, _CHUNK):
                doc, bucket = _grams(texts[lo:hi])
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                sums[1] += np.bincount(bucket[target[lo:hi][doc]], minlength=BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "raw", "good"])

    rows = docs.mapInArrow(count, "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    total = np.ones((2, BUCKETS))
    for r in rows:  # at most BUCKETS
        total[:, r["bucket"]] += (r["raw"], r["good"])
    return np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, text_hash, log_weight of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches):
        for batch in batches:
            texts, out = utf8(batch.column("text")), []
            for lo, hi in groups_by_size(texts, _CHUNK):
                doc, bucket = _grams(texts[lo:hi])
                out.append(np.bincount(doc, weights=sent.value[bucket], minlength=hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "text_hash", "log_weight"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.StringType()), T.StructField("log_weight", T.DoubleType())])
    return docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash")).mapInArrow(weigh, schema)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, few: int = 4096) -> float | None:
    """The exact k-th largest value of a column of finite doubles (None if there are fewer)."""
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not rows or k > rows or k < 1:
        return None
    inside, above = df.select(F.col(column).alias("x")), 0
    while low < high and rows > few:
        step = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * F.lit(bins)), F.lit(bins - 1))
        held = sorted(inside.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: -r["bin"])
        for r in held:
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high, rows = r["lo"], r["hi"], r["n"]
        inside = inside.filter(F.col("x").between(low, high))
    if low == high:
        return low
    return sorted((r["x"] for r in inside.collect()), reverse=True)[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, log_weight and noisy (with Gumbel noise) of the rows that the sample keeps."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    good = labels.filter("quality = 1").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(True).alias("target")).filter("doc_id is not null").distinct()
    marked = rows.join(broadcast_if_small(good), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    scored = score(rows, model(marked)).groupBy("doc_id", "text_hash", "log_weight").agg(F.count("*").alias("copies"))
    scored = repeated(scored, "copies")  # each row its own noise, by the number of the copy
    key = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash", F.col("copy").cast("string")))
    bits = F.conv(F.substring(key, 1, 13), 16, 10).cast("double")
    noise = -F.log(-F.log((bits + 0.5) / F.lit(2.0**52)))
    scored = materialize(scored.select("doc_id", "log_weight", (F.col("log_weight") + noise).alias("noisy")), "resample-scores")
    k = math.ceil(keep * scored.count())
    least = kth_largest(scored, "noisy", k)
    return scored.filter(F.col("noisy") >= F.lit(least)) if least is not None else scored.filter("false")
