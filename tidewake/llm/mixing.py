"""Mixing sources to target weights by temperature (DataFrame functions only).

Source token shares p are raised to an exponent a and normalised. a is found by bisection: as large
as possible (at most 1) with the entropy of the weights at least ``entropy`` times ln(sources), and
no smaller than what keeps every source's repetition (quota / tokens) at ``max_repeats`` or less; the
repetition limit goes first where both cannot hold. Five levels of the bisection are evaluated per
job over the source table, so nothing but a few sums reaches the driver.

Quotas (weight times budget, in tokens) are realised as passes over a seeded permutation of each
source; the last pass stops when the quota is reached. The mixture is cut into blocks of about
``block_tokens``; a document falls into the block at its fraction of its source's quota, so each
block holds all sources at their weights, and blocks are permuted inside by another seeded order.
Running sums in permutation order have two levels, with about the square root of the rows in
buckets of the permutation, so no task sees a whole source.

Defined cases: tokens are runs of ``[^\\x20\\x09-\\x0D]``; null texts have none; a null source is a
source of its own; sources without tokens have weight zero and are not drawn; documents without
tokens are drawn where their place falls within the quota; repeated rows (also those without an id) are
counted before the running sums and drawn as often as they are; an empty table gives an empty schedule;
ids keep their type; other columns are ignored by ``schedule`` and pass through ``mixture``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, repeated

ENTROPY = 0.95
MAX_REPEATS = 3.0
BUDGET = 1.0
BLOCK_TOKENS = 250_000
SEED = 7
LEVELS, AHEAD = 40, 5


def token_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def _order(tag: str, *cols):
    return F.md5(F.concat_ws("|", F.lit(f"{SEED}{tag}"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def _bisect(shares: DataFrame, value, good_high: bool) -> float:
    """The border in [0, 1] of an exponent's condition that holds above (good_high) or below it; value: condition over F.col("a")."""
    lo, hi = 0.0, 1.0
    for _ in range(LEVELS // AHEAD):
        n = 1 << AHEAD
        points = [lo + (hi - lo) * k / n for k in range(1, n)]
        grid = shares.withColumn("a", F.explode(F.array(*[F.lit(p) for p in points])))
        good = sorted((r["a"], r["ok"]) for r in grid.groupBy("a").agg(value.alias("ok")).collect())
        holds = [a for a, ok in good if ok]
        if good_high:
            hi = min([hi, *holds])
            lo = max([lo, *(a for a, ok in good if not ok and a < hi)])
        else:
            lo = max([lo, *holds])
            hi = min([hi, *(a for a, ok in good if not ok and a > lo)])
    return hi if good_high else lo


def exponent(shares: DataFrame, budget: int, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for sources (tokens, p), both positive."""
    q = F.pow(F.col("p"), F.col("a"))
    z = F.sum(q)
    spread = F.log(z) - F.col("a") * F.sum(q * F.log("p")) / z
    repeats = F.max(q * F.lit(float(budget)) / F.col("tokens")) / z
    sources = shares.count()
    at_one = shares.withColumn("a", F.lit(1.0)).groupBy("a").agg(spread.alias("h"), repeats.alias("r")).first()
    target = entropy * math.log(sources)
    by_entropy = 1.0 if at_one["h"] >= target else _bisect(shares, spread >= F.lit(target), good_high=False)
    by_repeats = 1.0 if at_one["r"] > max_repeats else _bisect(shares, repeats <= F.lit(max_repeats), good_high=True)
    return max(by_entropy, by_repeats)


def schedule(docs: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS, keep: tuple = ()) -> DataFrame:
    """doc_id, source, epoch, block, position, weight and the kept columns of each drawn document, a row for each draw."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), token_count(F.col("text").cast("string")).alias("tokens"), *keep)
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sized = materialize(sized.groupBy("key", "doc_id", "source", "tokens", *keep).agg(F.count("*").alias("copies")), "mix-sized")
    totals = materialize(sized.groupBy("key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("total"), F.sum("copies").alias("rows")).filter("total > 0"), "mix-totals")
    all_ = totals.agg(F.sum("total").alias("t"), F.sum("rows").alias("n")).first()
    if not all_["t"]:
        return sized.filter("false").select("doc_id", "source", F.lit(0).alias("epoch"), F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("position"), F.lit(0.0).alias("weight"), *keep)
    spend = int(all_["t"] * budget)
    shares = totals.select("key", F.col("total").alias("tokens"), (F.col("total") / F.lit(float(all_["t"]))).alias("p"))
    a = exponent(shares, spend, entropy, max_repeats)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    weight = F.pow(F.col("p"), F.lit(a)) / F.lit(z)
    quota = shares.select("key", F.col("tokens").alias("total"), F.round(weight, 9).alias("weight"), F.floor(F.round(weight, 9) * F.lit(spend)).alias("quota"))
    blocks = max(1, math.ceil(spend / block_tokens))
    digits = max(1, math.ceil(math.log2(all_["n"] + 1) / 8))  # hex digits: about the square root of the rows

    passes = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("quota") / F.col("total")) - 1).cast("int")))
    drawn = sized.join(quota.filter("quota > 0"), "key").withColumn("epoch", passes)
    drawn = drawn.withColumn("place", _order("p", "epoch", "doc_id", "tokens")).withColumn("bucket", F.substring("place", 1, digits)).withColumn("mass", F.col("tokens") * F.col("copies"))
    sums = drawn.groupBy("key", "epoch", "bucket").agg(F.sum("mass").alias("inside"))
    before = Window.partitionBy("key", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0))).drop("inside")
    inside = Window.partitionBy("key", "epoch", "bucket").orderBy("place", "doc_id", "tokens", *keep).rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("inner", F.coalesce(F.sum("mass").over(inside), F.lit(0))).join(sums, ["key", "epoch", "bucket"])
    first = F.col("epoch") * F.col("total") + F.col("before") + F.col("inner")
    drawn = repeated(drawn.withColumn("first", first).filter("first < quota"), "copies")
    drawn = drawn.withColumn("start", F.col("first") + F.col("copy") * F.col("tokens")).filter("start < quota")
    block = F.floor(F.col("start").cast("double") / F.col("quota") * F.lit(blocks))
    drawn = drawn.select("doc_id", "source", "epoch", block.alias("block"), _order("b", "epoch", "doc_id", "tokens").alias("place"), "weight", "tokens", *keep)
    by = Window.partitionBy("block").orderBy("place", "doc_id", "epoch", "tokens", "source", *keep)
    return drawn.withColumn("position", F.row_number().over(by)).select("doc_id", "source", "epoch", "block", "position", "weight", *keep)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The training set: all columns of docs, and epoch, block, position and weight, a row for each draw.

    The schedule is made without the texts, which join it at the end by the name of their row (a hash of
    all columns); rows that are equal in all columns share a name, and one of them is repeated.
    """
    name, epoch, block, position, weight = fresh(docs, "row_name", "epoch", "block", "position", "weight")
    rows = docs.withColumn(name, F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})))
    plan = materialize(schedule(rows, keep=(name,), **options), "mix-plan")
    plan = plan.select(name, F.col("epoch").alias(epoch), F.col("block").alias(block), F.col("position").alias(position), F.col("weight").alias(weight))
    return plan.join(rows.dropDuplicates([name]), name).select(*docs.columns, epoch, block, position, weight)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS tokens FROM documents),
t AS (SELECT key, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY key HAVING sum(tokens) > 0),
g AS (SELECT CAST(sum(total) AS BIGINT) AS spend, list(CAST(total AS DOUBLE) ORDER BY key) AS ts, count(*) AS n, CAST(greatest(1, ceil(sum(total) / 250000.0)) AS BIGINT) AS blocks FROM t),
p AS (SELECT spend, n, blocks, ts, [x / spend for x in ts] AS ps FROM g),
ent(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, ln(list_sum([pow(x, (lo + hi) / 2) for x in ps])) - (lo + hi) / 2 * list_sum([pow(x, (lo + hi) / 2) * ln(x) for x in ps]) / list_sum([pow(x, (lo + hi) / 2) for x in ps]) >= 0.95::DOUBLE * ln(n) AS ok FROM ent, p WHERE i < 40)),
rep(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, list_max([pow(ps[k], (lo + hi) / 2) * spend / ts[k] for k in range(1, len(ts) + 1)]) / list_sum([pow(x, (lo + hi) / 2) for x in ps]) <= 3.0::DOUBLE AS ok FROM rep, p WHERE i < 40)),
a AS (SELECT greatest(CASE WHEN -list_sum([x * ln(x) for x in ps]) >= 0.95::DOUBLE * ln(n) THEN 1.0::DOUBLE ELSE (SELECT lo FROM ent WHERE i = 40) END, (SELECT hi FROM rep WHERE i = 40)) AS a FROM p),
w AS (SELECT key, total, spend, blocks, round(pow(total::DOUBLE / spend, a) / list_sum([pow(x, a) for x in ps]), 9) AS weight FROM t, p, a),
q AS (SELECT *, CAST(floor(weight * spend) AS BIGINT) AS quota FROM w),
e AS (SELECT doc_id, source, tokens, key, total, weight, quota, blocks, unnest(generate_series(0, CAST(ceil(quota::DOUBLE / total) AS BIGINT) - 1)) AS epoch FROM d JOIN q USING (key) WHERE quota > 0),
s AS (SELECT *, epoch * total + coalesce(sum(tokens) OVER (PARTITION BY key, epoch ORDER BY md5('7p|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tokens), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
b AS (SELECT *, CAST(floor(CAST(start AS DOUBLE) / quota * blocks) AS BIGINT) AS block FROM s WHERE start < quota)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, block, CAST(row_number() OVER (PARTITION BY block ORDER BY md5('7b|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tokens), doc_id, epoch, tokens, source) AS INTEGER) AS position, weight FROM b
"""
