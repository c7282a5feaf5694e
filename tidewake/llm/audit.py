"""Walsh-Hadamard audit of five filters: what each removes under every order of applying them.

A document's failures are a mask of five bits. Per part and label the 32 signed parity sums
``W[s] = sum over documents of (-1) ** (bits that the mask and s share)`` are aggregated; they are inverted
exactly (``cell[m] = sum over s of (-1) ** (bits shared) * W[s] / 32``) to the count of each mask, from
which every order and step is evaluated. Shapley values are closed-form: of the 120 orders, a document of k
failures is removed by each of its failing filters in 120 / k.

Duplicates are decided on counts: texts of one SHA-256 share the other four bits, and of each
text all rows but those of its smallest id fail E. So no row meets all its copies: rows are
counted by (id, digest), then by digest, part and label, and only these counts meet.

Defined cases: a null text is empty, a null lang the empty string, so both count with the empty ones. A text
of no words passes B, an empty one C. Rows that share their id and text are compared with smaller ids
only, so all of them pass E, or all fail; a row without an id has no smaller one and passes E. A document
is good (toxic) if any of its ``labels`` rows has quality = 1 (toxic = 1). Without documents there is no part and no
row. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: The bit of E, which a text alone does not decide.
COPY = 1 << FILTERS.index("E")
BLANKS, UPPER, MARKS = b" \t\n\v\f\r", bytes(range(65, 91)), b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20


def _words(data: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is split piece by piece."""
    if len(data) <= PIECE:
        found = data.split()
        return len(found), len(set(found))
    n, seen, at = 0, set(), 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and data[to] not in BLANKS:
            to += 1
        found = data[at:to].split()
        n, at = n + len(found), to
        seen.update(found)
    return n, len(seen)


def failures(data: bytes) -> int:
    """The mask of the failures that a text shows by itself: bit 0 for A to bit 3 for D."""
    n, distinct = _words(data)
    points, upper = len(data.translate(None, _INNER)), len(data) - len(data.translate(None, UPPER))
    fails = n < 100, 100 * distinct < 80 * n, 100 * upper > 10 * points, any(m in data for m in MARKS)
    return sum(1 << bit for bit, failed in enumerate(fails) if failed)


def _looked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each row, the digest being the text's SHA-256."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            mask, digest = pa.array(map(failures, texts), pa.int32()), pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), mask, digest], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(look, T.StructType([rows.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): counts of documents by their whole mask, in any number of rows each."""
    rows = _looked(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # Rows of the smallest id of their group; rows without an id.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    groups = marked.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), least, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("bare"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("bare") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = groups.withColumn("first", first).withColumn("passing", passing)
    both = F.array(F.struct("mask", F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")


def _odd(mask: Column) -> Column:
    return F.bit_count(mask) % 2 == 1


def _over_masks(value) -> Column:
    """The sum of value(mask) over all masks."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("bigint"), lambda total, m: total + value(m))


def cells(counts: DataFrame) -> DataFrame:
    """(part, label, cells): how many documents have each mask, from the signed parity sums; label: all, good or toxic."""
    label = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")), lambda x: x.isNotNull()))
    sums = [F.sum(F.when(_odd(F.col("mask").bitwiseAND(s)), -F.col("n")).otherwise(F.col("n"))) for s in range(MASKS)]
    parity = counts.select("part", "mask", "n", label.alias("label")).groupBy("part", "label").agg(F.array(*sums).alias("w"))
    w = lambda m, s: F.when(_odd(m.bitwiseAND(s)), -F.get("w", s)).otherwise(F.get("w", s))
    return parity.select("part", "label", F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(_over_masks(lambda s: w(m, s)), len(FILTERS))).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    none = F.array_repeat(F.lit(0).cast("bigint"), MASKS)
    by_label = [F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in ("all", "good", "toxic")]
    parts = cells(masks(docs, labels)).groupBy("part").agg(*by_label)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda k: F.expr(f"shiftleft(1, ascii(substring(filter_order, {k}, 1)) - {ord(FILTERS[0])})")
    before = sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    own = sum((F.when(F.col("step") == k, bit(k)).otherwise(0) for k in range(1, len(FILTERS) + 1)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("own", own)
    fails = lambda m, c: m.bitwiseAND(F.col(c)) > 0
    count = lambda label, cond: _over_masks(lambda m: F.when(cond(m), F.get(label, m)).otherwise(0))
    removed = lambda m: fails(m, "own") & ~fails(m, "before")
    return steps.select(
        "part", "filter_order", "step", count("all", lambda m: ~fails(m, "own") & ~fails(m, "before")).alias("kept"), count("all", removed).alias("removed"),
        count("all", lambda m: fails(m, "own") & fails(m, "before")).alias("redundant"), F.get("all", F.col("own")).alias("unique_fails"),
        count("good", removed).alias("good_lost"), count("toxic", removed).alias("toxic_lost"),
        _over_masks(lambda m: F.when(fails(m, "own"), F.get("all", m) * (F.lit(120) / F.bit_count(m)).cast("bigint")).otherwise(0)).alias("shapley"),
    )


ORACLE = """
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), f AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w
), l AS (
    SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x AS (SELECT unnest(string_split('ABCDE', '')) AS x), o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
    SELECT filter_order, CAST(k AS INTEGER) AS step, 1 << (ascii(filter_order[k]) - 65) AS own,
           list_sum([0] || list_transform(range(1, k), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before FROM o, range(1, 6) t(k)
), r AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (WHERE mask & (own + CAST(before AS INTEGER)) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & CAST(before AS INTEGER) = 0), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & CAST(before AS INTEGER) > 0), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & CAST(before AS INTEGER) = 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & CAST(before AS INTEGER) = 0), 0) AS toxic_lost
    FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
