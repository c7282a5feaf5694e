"""Exact ROC metrics: curve, area under it, true-positive rates at set false-positive rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import measured, written

NAMES = ("roc auc", "TPR @ 1% FPR", "TPR @ 0.1% FPR")
RATES = (0.01, 0.001)
#: Distinct scores of a range, about, and ranges at most.
BAND, BANDS = 65_536, 4096


def roc_counts(scored: DataFrame) -> DataFrame:
    """score, tp, fp: cumulative counts at each distinct score from the highest down.

    Scores are first counted by value, then cumulated in two levels (ranges of scores, then scores),
    so no task needs all scores of a large table. The counts by score are written, so that what makes the
    scores runs once.
    """
    return _cumulated(written(_by_score(scored), "roc-scores"))


def _by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(F.sum("label").cast("bigint").alias("pos"), F.sum(1 - F.col("label")).cast("bigint").alias("neg"))


def bands(by: DataFrame, rows: int, size: int = BAND) -> DataFrame:
    """by with ``band``: ranges of about ``size`` distinct scores each, the highest scores first.

    Spark's range partitioner draws the borders from a sample of the scores, so ranges are even however
    scores are spread; the numbers of the ranges are written, as a partition's number holds for one run only.
    """
    n = max(1, min(BANDS, -(-rows // size)))
    if n == 1:
        return by.withColumn("band", F.lit(0))
    return written(by.repartitionByRange(n, F.desc("score")).withColumn("band", F.spark_partition_id()), "roc-bands")


def _cumulated(by: DataFrame, keep: str = "true", size: int = BAND) -> DataFrame:
    """by: the written counts by score; keep: which scores take part."""
    banded = bands(by.filter(keep), measured(by)["rows"], size)
    sums = banded.groupBy("band").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # at most BANDS rows
    sums = sums.select("band", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"))
    inner = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = banded.withColumn("tp", F.sum("pos").over(inner)).withColumn("fp", F.sum("neg").over(inner)).join(F.broadcast(sums), "band")
    return out.select("score", (F.col("tp") + F.col("ap")).alias("tp"), (F.col("fp") + F.col("an")).alias("fp"), "pos", "neg")


def roc_curve(scored: DataFrame) -> DataFrame:
    """fpr, tpr, score of each vertex; (0, 0) has a null score."""
    by = written(_by_score(scored), "roc-scores")
    counts = _cumulated(by)
    totals = by.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = counts.crossJoin(F.broadcast(totals)).select(F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"), "score")
    origin = scored.sparkSession.createDataFrame([(0.0, 0.0, None)], "fpr double, tpr double, score double")
    return origin.unionByName(points)


def metrics(scored: DataFrame) -> DataFrame:
    """metric, value: the three metrics; all null if a score is null or NaN or a class is missing."""
    by = written(_by_score(scored), "roc-scores")
    counts = _cumulated(by, "score is not null and not isnan(score)")
    state = by.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"))
    # a vertex's trapezoid needs only its own counts: (neg) * (tp before + tp) / 2
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))).cast("double") / 2
    points = counts.crossJoin(F.broadcast(state))
    fpr, tpr = F.try_divide("fp", "n"), F.try_divide("tp", "p")
    found = [area.alias("area"), F.first("p").alias("p"), F.first("n").alias("n"), F.first("bad").alias("bad")]
    for i, x in enumerate(RATES):
        found.append(F.max(F.when(fpr <= x, F.struct(fpr.alias("f"), tpr.alias("t")))).alias(f"left{i}"))
        found.append(F.min(F.when(fpr > x, F.struct(fpr.alias("f"), tpr.alias("t")))).alias(f"right{i}"))
    one = points.agg(*found)
    sound = (F.col("bad") == 0) & (F.col("p") > 0) & (F.col("n") > 0)
    values = [F.when(sound, F.try_divide(F.col("area"), F.col("p") * F.col("n")))]
    for i, x in enumerate(RATES):
        lf, lt = F.coalesce(F.col(f"left{i}.f"), F.lit(0.0)), F.coalesce(F.col(f"left{i}.t"), F.lit(0.0))
        rf, rt = F.col(f"right{i}.f"), F.col(f"right{i}.t")
        values.append(F.when(sound, F.when(rf.isNull(), lt).otherwise(lt + F.try_divide((rt - lt) * (F.lit(x) - lf), rf - lf))))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in zip(NAMES, values, strict=True)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def cross_entropy(scored: DataFrame, least: float = 0.0) -> DataFrame:
    """loss, accuracy of probabilities of class 1: mean of -ln P(label), and the share of rows whose likelier class
    (0 for equal ones) is the label. least: a floor under P(label); with 0 the loss is infinite where it is 0."""
    right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    loss = F.when(F.greatest(right, F.lit(least)) > 0, -F.log(F.greatest(right, F.lit(least)))).otherwise(F.lit(float("inf")))
    hit = ((F.col("score") > 0.5).cast("int") == F.col("label")).cast("double")
    return scored.agg(F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy"))
