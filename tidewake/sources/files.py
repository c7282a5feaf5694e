"""Sources: parquet collections, predictions, run folders; and the acquisition of raw rows."""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nonblank
from .scratch import file_system, scratch_path

PREDICTIONS = "blob_id string, label int, score double"
METRICS = "metric string, value string"


def first_parquet(spark: SparkSession, folder: str) -> str:
    """The alphabetically first parquet file of a folder in any store that Spark reads."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        raise FileNotFoundError(f"no folder {folder}")
    names = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.getPath().getName().endswith(".parquet"))
    if not names:
        raise FileNotFoundError(f"no parquet file in {folder}")
    return f"{folder.rstrip('/')}/{names[0]}"


def read_collection(spark: SparkSession, folder: str, all_files: bool = False) -> DataFrame:
    """The first parquet file of a folder, or all of them."""
    return spark.read.parquet(f"{folder}/*.parquet" if all_files else first_parquet(spark, folder))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).csv(path, header=True)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """run_folder, row_idx, metric and value (text) of every run folder's metrics.csv, a file or a folder of part files; folders without one are skipped."""
    raw = spark.read.schema(METRICS).csv(f"{root}/*/metrics.csv", header=True, enforceSchema=False)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metrics\.csv(?:/[^/]*)?$", 1)
    return raw.select(F.url_decode(folder).alias("run_folder"), F.monotonically_increasing_id().alias("row_idx"), "metric", "value")


def preview(df: DataFrame, n: int, content: str = "content", prefix: int = 0) -> DataFrame:
    """name (path, else filename, else a placeholder), blob_id, number of characters and a prefix, of the first n rows by id."""
    have = {c.lower() for c in df.columns}
    names = [F.col(c).cast("string") for c in ("path", "filename") if c in have]
    return df.orderBy("blob_id").limit(n).select(F.coalesce(*names, F.lit("<unknown>")).alias("name"), "blob_id", F.length(content).alias("n_chars"), F.substring(content, 1, prefix).alias("head"))


def row_counts(df: DataFrame, content: str = "content") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(nonblank(content)).alias("nonblank"))


def explode_files(df: DataFrame, files: str = "files") -> DataFrame:
    """One row per file of the nested acquisition rows; null lists and null entries are skipped."""
    out = df.select(F.explode(files).alias("f")).filter("f is not null")
    return out.select("f.*")


def is_python_file(df: DataFrame):
    """Whether a row's language is Python or its path ends in .py; the second name counts where the first is null or absent."""
    have = {c.lower() for c in df.columns}
    pick = lambda *names: F.coalesce(*[F.col(c) for c in names if c in have], F.lit(""))
    return (F.lower(pick("language", "lang")) == "python") | F.endswith(F.lower(pick("path", "filename")), F.lit(".py"))


def not_duplicate(df: DataFrame, exact: str = "exact_duplicates_stackv2", near: str = "near_duplicates_stackv2"):
    """Whether neither flag is set: an absent column counts as set, a null flag as not set."""
    have = {c.lower() for c in df.columns}
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c.lower() in have else F.lit(True)
    return ~flag(exact) & ~flag(near)


def fetch_ok(df: DataFrame) -> DataFrame:
    return df.filter("status_code is null and content is not null")


def take_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by a total order, so that a repeat takes the same."""
    return df.orderBy(*order).limit(n)


def _asked(df: DataFrame, get: Callable[[str], tuple[int, bytes]]) -> DataFrame:
    """df with content, status_code and whether to ask again, from one call of ``get`` a row, in bounded batches."""

    def one(blob, encoding):
        if not blob:
            return None, None, False
        try:
            status, body = get(blob)
            if status == 200:
                return body.decode(encoding or "utf-8", errors="replace"), None, False
            return None, None if status == 429 else f"HTTP {status}", status == 429
        except Exception as problem:
            return None, str(problem), False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = pdf["src_encoding"] if "src_encoding" in pdf else [None] * len(pdf)
            got = [one(b, e if isinstance(e, str) else None) for b, e in zip(pdf["blob_id"], codes, strict=True)]
            text = lambda i: pd.Series([g[i] for g in got], dtype=object, index=pdf.index)  # noqa: B023, E731
            yield pdf.assign(content=text(0), status_code=text(1), again=[g[2] for g in got])

    kept = [f for f in df.schema.fields if f.name not in ("content", "status_code", "again")]
    more = [T.StructField("content", T.StringType()), T.StructField("status_code", T.StringType()), T.StructField("again", T.BooleanType())]
    return df.select(*[f.name for f in kept]).mapInPandas(run, T.StructType([*kept, *more]))


def fetch_content(df: DataFrame, get: Callable[[str], tuple[int, bytes]], folder: str | None = None, wait: float = 10.0, rounds: int | None = None) -> DataFrame:
    """Add content and status_code by calling ``get(blob_id) -> (status, body)`` for each row.

    200 gives the body in src_encoding (else UTF-8), bad bytes replaced; 429 is asked again, ``wait``
    seconds later, without end; any other status is kept as ``HTTP n``, an exception as its text; no id
    gives neither. Each round of asking is a job whose outcome is written to ``folder``, and the next asks
    only for what is still open. A run on the folder of an earlier one goes on where that ended. rounds: how
    many to run at most; what is then still open has neither content nor status.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "fetched")
    fs, _ = file_system(spark, folder)
    path = lambda n: f"{folder}/round-{n:05d}"
    done = 0
    while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path(done)}/_SUCCESS")):
        done += 1
    ran = 0
    while rounds is None or ran < rounds:
        open_ = spark.read.parquet(path(done - 1)).filter("again") if done else df
        if done and open_.isEmpty():
            break
        if done:
            time.sleep(wait)
        _asked(open_, get).write.mode("overwrite").parquet(path(done))
        done, ran = done + 1, ran + 1
    if not done:
        raise ValueError("nothing was asked: rounds is 0 and the folder is empty")
    last = spark.read.parquet(path(done - 1))
    every = last if done == 1 else spark.read.parquet(*[path(n) for n in range(done - 1)]).filter("not again").unionByName(last)
    return every.drop("again")


def write_parquet(df: DataFrame, folder: str, stem: str) -> str:
    """A timestamped parquet folder."""
    path = f"{folder}/{stem}_{time.strftime('%Y%m%d_%H%M%S')}.parquet"
    df.write.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, as a folder of part files."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """A few rows (metrics, a summary) as a single CSV file in any store that Spark writes to; nulls are empty cells."""
    text = io.StringIO()
    rows = csv.writer(text, lineterminator="\n")
    rows.writerow(df.columns)
    rows.writerows(tuple(r) for r in df.collect())
    fs, at = file_system(df.sparkSession, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.getvalue().encode()))
    finally:
        out.close()
