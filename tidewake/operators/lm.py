"""Target models. The built-in one is a count-based bigram model made of DataFrames.

A target model scores tokens, continues prompts and fills gaps; anything that does can stand in.
``served`` has an adapter for models that live in the workers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import cached_property
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from . import fill, packed

ALPHA = 0.1
TOKEN = r"[^ \t-\r]+"
_TOKENS = re.compile(TOKEN)
#: Rows of a table of counts, or of paths, that are broadcast at most.
HOT, PATHS = 500_000, 30_000


@runtime_checkable
class TargetModel(Protocol):
    def token_logprobs(self, docs: DataFrame, max_tokens: int | None = None, keys: tuple = ("blob_id",), outer: bool = False) -> DataFrame:
        """keys, pos, token, lp of every scored token of docs (keys, text); with outer a row of nulls for a text without any."""

    def generate(self, prompts: DataFrame, max_new: int, stop: str | None = None) -> DataFrame:
        """prompts with ``output``, a continuation of ``text`` that ends before stop."""

    def infill(self, prompts: DataFrame, max_new: int) -> DataFrame:
        """prompts with ``output``, what the gap of ``prompt`` (between ``prefix`` and ``suffix``) is filled with."""


def require_model(model) -> TargetModel:
    if not isinstance(model, TargetModel):
        raise RuntimeError(f"{type(model).__name__} is not a supported target model")
    return model


def tokenize(text: str | Column) -> Column:
    """Runs of anything but ASCII white space; null texts have none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def truncate(tokens: str | Column, limit: int, keep_end: bool = False) -> Column:
    """The first (or last) ``limit`` tokens."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(c, F.greatest(F.size(c) - limit + 1, F.lit(1)), limit) if keep_end else F.slice(c, 1, limit)


def words_joined(tokens: str | Column) -> Column:
    return F.array_join(F.col(tokens) if isinstance(tokens, str) else tokens, " ")


def positions(docs: DataFrame, max_tokens: int | None = None, keys: tuple = ("blob_id",), outer: bool = False, cut: Callable[[Column], Column] = tokenize) -> DataFrame:
    """keys, pos, prev, token of every token but the first; with outer also a row of nulls for a text of fewer than two."""
    t = cut(F.col("text"))
    if max_tokens:
        t = truncate(t, max_tokens)
    pairs = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(i.alias("pos"), F.get("t", i - 1).alias("prev"), F.get("t", i).alias("token")))
    rows = docs.select(*keys, t.alias("t"))
    if outer:
        return rows.select(*keys, F.inline_outer(F.when(F.size("t") > 1, pairs)))
    return rows.filter(F.size("t") > 1).select(*keys, F.inline(pairs))


def _pairs_of(docs: DataFrame, cut: Callable[[Column], Column]) -> DataFrame:
    """prev, token of neighbours; of a text of one token, that token and null."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), lambda i: F.struct(F.get("t", i - 1).alias("prev"), F.get("t", i).alias("token")))
    return docs.select(cut(F.col("text")).alias("t")).filter(F.size("t") > 0).select(F.inline(pairs))


class NGramLM:
    """Bigram model with additive smoothing: ln((c(prev, token) + ALPHA) / (c(prev) + ALPHA * V)).

    Counts are written once, when they are first asked for. Without any token all log-probabilities are null.
    cut and joined: how texts become tokens and tokens texts; runs of non-blanks here, ``subword`` has others.
    """

    def __init__(self, docs: DataFrame, alpha: float = ALPHA, hot: int = HOT, temperature: float = fill.TEMPERATURE, top_p: float = fill.TOP_P, seed: int = 42, cut: Callable[[Column], Column] = tokenize, joined: Callable[[Column], Column] = words_joined) -> None:
        self.cut, self.joined, self.docs, self.alpha = cut, joined, docs, float(alpha)
        self.hot, self._paths, self._nucleus = hot, {}, None
        self.temperature, self.top_p, self.seed = temperature, top_p, seed

    @cached_property
    def counts(self) -> packed.Counts:
        """The counts by hash, for the tokens of texts."""
        return packed.Counts(self.docs, self.cut, self.hot)

    @cached_property
    def bigrams(self) -> DataFrame:
        """prev, token, c2, c1, seen (the log-probability), for what generates."""
        # a text of one token counts for the vocabulary only; it is a pair without a second token
        met = written(_pairs_of(self.docs, self.cut).groupBy("prev", "token").agg(F.count("*").alias("c2")), "lm-pairs")
        self._known = met.select(F.explode(F.array("prev", "token")).alias("token")).agg(F.count_distinct("token")).first()[0]
        pairs = met.filter("token is not null")
        contexts = pairs.groupBy("prev").agg(F.sum("c2").alias("c1"))
        seen = self._lp(F.col("c2"), F.col("c1"), self._known).alias("seen")
        return written(pairs.join(contexts, "prev").select("prev", "token", "c2", "c1", seen), "lm-bigrams")

    def _lp(self, c2: Column, c1: Column, vocabulary: int) -> Column:
        return F.log(F.try_divide(c2 + F.lit(self.alpha), c1 + F.lit(self.alpha * vocabulary)))

    def _scored(self) -> Column:
        """The log-probabilities by the arrays c2 and c1."""
        return F.zip_with("c2", "c1", lambda c2, c1: self._lp(c2, c1, self.counts.vocabulary))

    def logprob_lists(self, docs: DataFrame, max_tokens: int | None = None, keys: tuple = ("blob_id",), spread: Callable[[DataFrame], DataFrame] | None = None, orders: tuple | None = None) -> DataFrame:
        """keys, lps of each row of docs (keys, text), or of the rows that spread, or orders, make of them where they are scored: the log-probabilities of its tokens but the first, in order."""
        if orders and self.cut is tokenize:  # other tokens are not those of the text once it is in another order
            spread = None
        met = self.counts.of_texts(docs, max_tokens, keys, spread, orders if spread is None else None)
        return met.select(*keys, self._scored().alias("lps"))

    def token_logprobs(self, docs: DataFrame, max_tokens: int | None = None, keys: tuple = ("blob_id",), outer: bool = False) -> DataFrame:
        """keys, pos, token, lp; texts and counts move in packed rows, tokens are rows only in the result."""
        met = self.counts.of_texts(docs, max_tokens, (*dict.fromkeys([*keys, "text"]),))
        t = F.slice(self.cut(F.col("text")), F.lit(2), F.greatest(F.size("c2"), F.lit(0)))
        rows = met.select(*keys, "c2", "c1", t.alias("_t"))
        at = F.arrays_zip(F.sequence(F.lit(1), F.size("c2")).alias("pos"), F.col("_t").alias("token"), self._scored().alias("lp"))
        if outer:
            return rows.select(*keys, F.inline_outer(F.when(F.size("c2") > 0, at)))
        return rows.filter(F.size("c2") > 0).select(*keys, F.inline(at))

    def pair_logprobs(self, at: DataFrame) -> DataFrame:
        """prev, token, lp of each distinct pair."""
        rows = at.select("prev", "token").distinct().join(self.bigrams.select("prev", "token", "c2"), ["prev", "token"], "left")
        rows = rows.join(self.bigrams.groupBy("prev").agg(F.first("c1").alias("c1")), "prev", "left")
        lp = self._lp(F.coalesce("c2", F.lit(0)), F.coalesce("c1", F.lit(0)), self._known)
        return rows.select("prev", "token", F.when(F.col("token").isNotNull(), lp).alias("lp"))

    def successors(self) -> DataFrame:
        """prev, token: the most frequent successor (ties: the smaller token)."""
        best = F.min(F.struct((-F.col("c2")).alias("c"), F.col("token").alias("t")))
        return self.bigrams.groupBy("prev").agg(best.alias("b")).select("prev", F.col("b.t").alias("token"))

    def paths(self, max_new: int) -> DataFrame:
        """prev, path: the greedy continuation of each token, at most max_new tokens.

        Paths double in length with each join of the table of paths with itself, so their cost follows
        the vocabulary and the logarithm of max_new, not the number of prompts.
        """
        if max_new not in self._paths:
            now, have = written(self.successors().select("prev", F.array("token").alias("path")), "lm-paths"), 1
            while have < max_new:
                more = now.select(F.col("prev").alias("end"), F.col("path").alias("more"))
                both = now.withColumn("end", F.element_at("path", -1)).join(more, "end", "left")
                longer = F.concat("path", F.coalesce("more", F.array().cast("array<string>")))
                now, have = written(both.select("prev", F.slice(longer, 1, max_new).alias("path")), "lm-paths"), 2 * have
            self._paths[max_new] = now
        return self._paths[max_new]

    def generate(self, prompts: DataFrame, max_new: int = 50, stop: str | None = None, text: str = "text", broadcast_rows: int = PATHS) -> DataFrame:
        """prompts with ``output``: the greedy continuation of the last token of the text, empty where there is none.

        Tokens hold no white space, so a line end as stop never cuts anything here.
        """
        paths = self.paths(max_new).select(F.col("prev").alias("_last_token"), F.col("path").alias("_path"))
        paths = F.broadcast(paths) if paths.limit(broadcast_rows + 1).count() <= broadcast_rows else paths
        words = self.cut(F.col(text))
        met = prompts.withColumn("_last_token", F.get(words, F.size(words) - 1)).join(paths, "_last_token", "left")
        output = F.coalesce(self.joined(F.col("_path")), F.lit(""))
        return met.select(*prompts.columns, (F.substring_index(output, stop, 1) if stop else output).alias("output"))

    def nucleus(self) -> DataFrame:
        """The successors that sampling draws from, written once."""
        if self._nucleus is None:
            self._nucleus = written(fill.nucleus(self.bigrams, self.temperature, self.top_p), "lm-nucleus", bytes=fill._bytes("prev", "token"))
        return self._nucleus

    def infill(self, prompts: DataFrame, max_new: int = 50) -> DataFrame:
        """prompts with ``output``: the best path from the prefix to the suffix, else a sampled continuation of the prefix."""
        return fill.fill(prompts, self.bigrams, self.nucleus(), self.cut, max_new, self.seed, joined=self.joined)


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def mean_logprobs(model: TargetModel, docs: DataFrame, max_tokens: int | None, keys: tuple) -> DataFrame:
    """keys, score: the mean of the log-probabilities of each row of docs (keys, text), null without any."""
    if hasattr(model, "logprob_lists"):
        return model.logprob_lists(docs, max_tokens, keys).select(*keys, _mean(F.col("lps")).alias("score"))
    return model.token_logprobs(docs, max_tokens, keys, outer=True).groupBy(*keys).agg(F.avg("lp").alias("score"))


def perplexity(model: TargetModel, docs: DataFrame, keys: tuple = ("blob_id",)) -> DataFrame:
    """keys, ppl = exp(-mean log-probability) of docs (keys, text); 100 for empty texts, 1e6 where there is nothing to average."""
    rows = docs.select(*keys, "text", (F.length(F.coalesce("text", F.lit(""))) == 0).alias("_empty"))
    by = (*keys, "_empty")
    means = mean_logprobs(model, rows, None, by).withColumnRenamed("score", "m")
    return means.select(*keys, F.when(F.col("_empty"), F.lit(100.0)).when(F.col("m").isNull(), F.lit(1e6)).otherwise(F.exp(-F.col("m"))).alias("ppl"))


def chunked_positions(docs: DataFrame, width: int = 2048) -> DataFrame:
    """positions within consecutive windows of ``width`` tokens, each read as a fresh prompt: its first token has no predecessor."""
    return positions(docs).withColumn("chunk", F.floor(F.col("pos") / width).cast("int")).filter(F.col("pos") % width != 0)


def embed(text: str | Column, width: int = 64) -> Column:
    """Counts of lower-cased tokens by crc32 modulo ``width``: the default text embedding."""

    @F.pandas_udf("array<double>")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([np.bincount([zlib.crc32(w.encode()) % width for w in _TOKENS.findall((t or "").lower())], minlength=width).astype(float) for t in texts], dtype=object)

    return counts(text)


class FeatureModel(Protocol):
    """What the stability attack measures outputs with: an embedding and a perplexity."""

    def embed(self, text: Column) -> Column:
        """An array of doubles for each text."""

    def perplexity(self, docs: DataFrame, keys: tuple) -> DataFrame:
        """keys, ppl of docs (keys, text)."""


class CountFeatures:
    """The built-in feature model: hashed token counts, and the perplexity of a target model."""

    def __init__(self, scorer: TargetModel, width: int = 64) -> None:
        self.scorer, self.width = scorer, width

    def embed(self, text: Column) -> Column:
        return embed(text, self.width)

    def perplexity(self, docs: DataFrame, keys: tuple) -> DataFrame:
        return perplexity(self.scorer, docs, keys)


def lagged(tokens: DataFrame, keys: tuple = ("blob_id",)) -> DataFrame:
    """The previous token of each row of (keys, pos, token)."""
    return tokens.withColumn("prev", F.lag("token").over(Window.partitionBy(*keys).orderBy("pos")))
