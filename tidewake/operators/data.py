"""Samples of seen and unseen texts: labels, ids, exact samples and stratified splits.

Draws are md5 keys over (seed, purpose, id, text), so they depend on neither partitioning nor row
order. Selections of an exact number per group rank only the rows of one key prefix per group; all
rows below that prefix are taken without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import nonblank, order_key

DIGITS = 4


def blob_id(ident, content, numeric: bool = False) -> Column:
    """The id as text, or the SHA-1 of the content where it is null, empty or the number zero."""
    text = ident.cast("string")
    return F.when(text.isNull() | (text == "") | ((text == "0") & F.lit(numeric)), F.sha1(content)).otherwise(text)


def samples(df: DataFrame, label: int, content: str = "content", ident: str | None = "blob_id") -> DataFrame:
    """text, blob_id, label of the rows that are not blank; null content is blank."""
    kinds = {c.lower(): k for c, k in df.dtypes}
    found = F.col(ident) if ident and ident.lower() in kinds else F.lit(None).cast("string")
    numeric = kinds.get((ident or "").lower(), "string") != "string"
    return df.filter(nonblank(content)).select(F.col(content).alias("text"), blob_id(found, F.col(content), numeric).alias("blob_id"), F.lit(label).alias("label"))


def take_per_group(df: DataFrame, group: str, key: Column, quota: DataFrame) -> DataFrame:
    """The ``n`` rows of smallest key of each group; quota: (group, n). Ties of the whole key are broken by blob_id and text."""
    met, edge = _at_the_cut(df.withColumn("_k", key), group, quota)
    return met.filter(F.col("_b") < F.col("_cut")).select(*df.columns).unionByName(edge.select(*df.columns))


def _at_the_cut(keyed: DataFrame, group: str, quota: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed (with ``_k``) with the prefix ``_b`` of the key and that at which its group is cut, ``_cut``; and the rows of
    that prefix that are still taken. Groups are few (labels), so what has a row for each is broadcast and no text is shuffled by its group."""
    keyed = keyed.withColumn("_b", F.substring("_k", 1, DIGITS))
    sizes = keyed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(quota), group)
    cut = sizes.filter("_before < n").groupBy(group).agg(F.max("_b").alias("_cut"), F.max("_before").alias("_below"), F.first("n").alias("_quota"))
    met = keyed.join(F.broadcast(cut), group)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_k", "blob_id", "text"))
    return met, met.filter(F.col("_b") == F.col("_cut")).withColumn("_r", rank).filter(F.col("_r") <= F.col("_quota") - F.col("_below"))


def sample_exact(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, int(N * fraction)) rows of each label, uniformly and without replacement."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    if fraction == 1:
        return df
    quota = df.groupBy("label").agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(float(fraction)))).alias("n"))
    return take_per_group(df, "label", order_key(seed, "sample", "blob_id", "text"), quota)


def split_quota(df: DataFrame, share: float, of_test: bool = False) -> DataFrame:
    """(label, n): rows of each class in the first part of a stratified split, by largest remainders.

    The first part has floor(share * N) rows; with of_test it is what ceil(share * N) test rows leave.
    """
    counts = df.groupBy("label").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    size = (F.col("t") - F.ceil(F.col("t") * F.lit(float(share)))) if of_test else F.floor(F.col("t") * F.lit(float(share)))
    both = counts.crossJoin(F.broadcast(total.select("t", size.alias("size"))))  # one row
    exact = F.col("size") * F.col("c") / F.col("t")
    both = both.withColumn("low", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    everything = Window.partitionBy("t")  # a row for each label
    rank = F.row_number().over(everything.orderBy(F.desc("rest"), "label"))
    left = F.col("size") - F.sum("low").over(everything)
    return both.withColumn("rank", rank).withColumn("left", left).select("label", (F.col("low") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("n"))


def stratified_split(df: DataFrame, train: float = 0.8, seed: int = 42) -> DataFrame:
    """df with a column split, ``train`` or ``test``."""
    if not 0 < train < 1:
        raise ValueError("the train share must lie in (0, 1)")
    return _split(df, split_quota(df, train), order_key(seed, "split", "blob_id", "text"), "train", "test")


def val_split(df: DataFrame, test: float = 0.5, seed: int = 42) -> DataFrame:
    """df with a column split, ``fit`` or ``val``."""
    return _split(df, split_quota(df, test, of_test=True), order_key(seed, "val", "blob_id", "text"), "fit", "val")


def _split(df: DataFrame, quota: DataFrame, key: Column, one: str, other: str) -> DataFrame:
    keyed = df.withColumn("_k", key)
    _, last = _at_the_cut(keyed, "label", quota)  # the last row that is in has the prefix of the cut
    edge = last.groupBy("label").agg(F.max(F.struct("_k", "blob_id", "text")).alias("_edge"))  # all before it are in
    here = F.struct("_k", "blob_id", "text")
    marked = keyed.join(F.broadcast(edge), "label", "left")
    return marked.select(*df.columns, F.when(here <= F.col("_edge"), one).otherwise(other).alias("split"))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("members"), F.count_if(F.col("label") == 0).alias("others"))


def without_seen(unseen: DataFrame, seen: DataFrame) -> DataFrame:
    """Unseen samples whose text no seen sample has (anti-join on the content's hash)."""
    known = seen.select(F.sha2("text", 256).alias("_h")).distinct()
    return unseen.withColumn("_h", F.sha2("text", 256)).join(known, "_h", "left_anti").drop("_h")
