"""Unifying the metrics of many runs, and a dashboard page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_run(folder) -> tuple:
    """(attack, id) columns: the folder's name cut at its first underscore."""
    parts = F.split(folder, "_", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def last_metrics(rows: DataFrame) -> DataFrame:
    """run_folder, metric, value: null metrics dropped, the last of repeated ones kept."""
    return rows.filter("metric is not null").groupBy("run_folder", "metric").agg(F.max_by("value", "row_idx").alias("value"))


def unify_long(rows: DataFrame) -> DataFrame:
    attack, _ = split_run(F.col("run_folder"))
    return last_metrics(rows).select("run_folder", attack.alias("attack_name"), "metric", F.expr("try_cast(value as double)").alias("value"))


def unify_wide(rows: DataFrame) -> DataFrame:
    """One row per run, one column per metric in ASCII order."""
    long = unify_long(rows)
    return long.groupBy("attack_name", "run_folder").pivot("metric").agg(F.first("value"))


def attack_means(rows: DataFrame) -> DataFrame:
    """metric, attack_name, mean of the numeric values."""
    return unify_long(rows).filter("value is not null").groupBy("metric", "attack_name").agg(F.avg("value").alias("mean"))


#: What precedes the legend: a box for each attack, which hides or shows its bars in all charts.
HEAD = (
    "<!doctype html><meta charset='utf-8'><title>metrics</title>"
    "<script>function show(box, name) { for (const bar of document.getElementsByClassName(name)) bar.style.display = box.checked ? '' : 'none' }</script>"
    "<p>Attack (click to hide or show): "
)


def dashboard(means: DataFrame) -> str:
    """A page of its own: one bar chart per metric, one bar per attack, each attack at one place in all charts,
    hidden and shown by its box in the legend. means has a row per metric and attack."""
    rows = sorted((r["metric"], r["attack_name"], r["mean"]) for r in means.collect())
    names, attacks = sorted({m for m, _, _ in rows}), sorted({a for _, a, _ in rows})
    height, width = max(360 * len(names), 500), max(900, 80 + 110 * len(attacks))
    legend = "".join(f"<label><input type=\"checkbox\" checked onchange=\"show(this, 'a{i}')\">{html.escape(a)}</label> " for i, a in enumerate(attacks))
    parts = [f'{HEAD}{legend}</p><svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">']
    for k, metric in enumerate(names):
        top = k * 360
        parts.append(f'<text x="20" y="{top + 24}" font-size="16">{html.escape(metric)}</text>')
        for m, attack, v in rows:
            if m == metric:
                tall, x = 260 * max(0.0, min(1.0, v)), 40 + attacks.index(attack) * 110
                bar = f'<rect x="{x}" y="{top + 310 - tall:.1f}" width="70" height="{tall:.1f}" fill="#4c78a8"/>'
                parts.append(f'<g class="a{attacks.index(attack)}">{bar}<text x="{x}" y="{top + 328}">{html.escape(attack)}</text><text x="{x}" y="{top + 304 - tall:.1f}">{v:.4f}</text></g>')
    return "".join(parts) + "</svg>"


def write_dashboard(spark: SparkSession, means: DataFrame, path: str) -> None:
    """The page as a text file in any store Spark writes to."""
    spark.createDataFrame([(dashboard(means),)], "value string").coalesce(1).write.mode("overwrite").text(path)
