"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a few shuffles of the edges; minima are written to the shared folder, so that a node of
very many edges meets its minimum in a join of plain scans, which adaptive execution can split. Rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, measured, settle


def _edges(df: DataFrame) -> DataFrame:
    return materialize(df.distinct(), "cc-edges", mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
    met = near.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")).filter("a <> b"))
    else:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = _edges(out)
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (columns a, b, both long); root: the smallest node reachable."""
    now = _edges(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while measured(now)["rows"]:
        large = _star(now, small=False)
        after = _star(large, small=True)
        same = measured(after) == measured(now)
        discard(now, large)
        now = after
        settle(edges.sparkSession)
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
