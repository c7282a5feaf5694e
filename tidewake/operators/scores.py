"""Scores of the model-based attacks without training: mean loss, lowest-k probability, polarized distance."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lm import TOKEN, TargetModel, _mean, mean_logprobs

LOSS_TOKENS, MIN_K_TOKENS, SWAP_TOKENS = 2048, 2048, 4096
K = 0.3
_TOKENS = re.compile(TOKEN)
NEAR, FAR = 30, 5
SWAP_RATIO, MUTANTS = 0.3, 5


#: A text's row while its tokens are scored; ids may repeat.
ROW = ("_row", "blob_id", "label")


def rows_of(docs: DataFrame) -> DataFrame:
    """ROW and text."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), "blob_id", "label", "text")


def _sorted(lps: DataFrame, keys: tuple) -> DataFrame:
    """keys, l of rows (keys, lp), or rows (keys, l) as they are. Attacks read 2,048 or 4,096 tokens of a text at most, so arrays are bounded."""
    if "l" in lps.columns:
        return lps
    return lps.groupBy(*keys).agg(F.sort_array(F.collect_list("lp")).alias("l"))


def lists(model: TargetModel, docs: DataFrame, max_tokens: int, keys: tuple = ("blob_id",), spread: Callable[[DataFrame], DataFrame] = lambda rows: rows, orders: tuple | None = None) -> DataFrame:
    """keys, l: the log-probabilities of each row that spread makes of docs (keys, text), in ascending order; keys name a row. orders: the same rows as orders of tokens, for models that score tokens by their hashes."""
    if hasattr(model, "logprob_lists"):
        return model.logprob_lists(docs, max_tokens, keys, spread, **({"orders": orders} if orders else {})).select(*keys, F.sort_array("lps").alias("l"))
    return _sorted(model.token_logprobs(spread(docs), max_tokens, keys, outer=True), keys)


def min_k(lps: DataFrame, k: float = K, keys: tuple = ("blob_id",)) -> DataFrame:
    """Mean of the max(1, int(n * k)) lowest log-probabilities; null without any."""
    take = F.greatest(F.lit(1), F.floor(F.size("l") * F.lit(float(k)))).cast("int")
    return _sorted(lps, keys).select(*keys, _mean(F.slice("l", F.lit(1), take)).alias("score"))


def ranks(lps: DataFrame, keys: tuple = ("blob_id",)) -> DataFrame:
    """keys, low, lp: the rank of every log-probability within its text, the lowest first."""
    return _sorted(lps, keys).select(*keys, F.posexplode("l").alias("low", "lp")).withColumn("low", F.col("low") + 1)


def polarized_distance(lps: DataFrame, near: int = NEAR, far: int = FAR, keys: tuple = ("blob_id",)) -> DataFrame:
    """Mean of the ``far`` highest minus mean of the ``near`` lowest; both shrink in proportion where they would overlap."""
    n = F.size("l")
    f, m = F.greatest(F.lit(1), F.least(F.lit(far), n)), F.greatest(F.lit(1), F.least(F.lit(near), n))
    shrink = n.cast("double") / (f + m)
    m2 = F.when(f + m > n, F.greatest(F.lit(1), F.floor(m * shrink))).otherwise(m).cast("int")
    f2 = F.when(f + m > n, F.greatest(F.lit(1), F.floor(f * shrink))).otherwise(f).cast("int")
    high = _mean(F.slice("l", F.greatest(n - f2 + 1, F.lit(1)), f2))
    return _sorted(lps, keys).select(*keys, (high - _mean(F.slice("l", F.lit(1), m2))).alias("score"))


def swap_order(n: int, blob: object, variant: int, seed: int, ratio: float) -> list[int]:
    """The places of n tokens after the swaps of a variant."""
    places = list(range(n))
    for k in range(int(ratio * n) if variant else 0):
        key = hashlib.md5(f"{seed}|swap|{blob}|{variant}|{k}".encode()).hexdigest()
        i, j = int(key[:8], 16) % n, int(key[8:16], 16) % (n - 1)
        j += j >= i
        places[i], places[j] = places[j], places[i]
    return places


def swap_tokens(docs: DataFrame, seed: int = 42, ratio: float = SWAP_RATIO, mutants: int = MUTANTS) -> DataFrame:
    """docs with variant 0 (the text) and 1 .. mutants: int(ratio * n) swaps of random distinct places, one after another.

    A swap changes what the next one finds, so the tokens are changed in place, in Arrow batches. Swap k
    draws from md5(seed|swap|blob_id|variant|k): its first place from the first eight digits modulo n, the
    second, among the others, from the next eight modulo n - 1.
    """

    @F.pandas_udf("string")
    def swapped(text: pd.Series, blob: pd.Series, variant: pd.Series) -> pd.Series:
        out = []
        for t, b, v in zip(text, blob, variant, strict=True):
            if v == 0:
                out.append(t)
                continue
            tokens = _TOKENS.findall(t or "")
            out.append(" ".join([tokens[i] for i in swap_order(len(tokens), b, v, seed, ratio)]))
        return pd.Series(out, dtype=object)

    rows = docs.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(mutants))))
    return rows.withColumn("text", swapped("text", F.coalesce("blob_id", F.lit("")), "variant"))


def combine_mutants(distances: DataFrame, keys: tuple = ("blob_id",)) -> DataFrame:
    """score = distance of variant 0 minus the mean over mutants (0 without any)."""
    own = F.max(F.when(F.col("variant") == 0, F.col("score")))
    rest = F.avg(F.when(F.col("variant") > 0, F.col("score")))
    return distances.groupBy(*keys).agg(F.when(F.count_if(F.col("variant") > 0) == 0, F.lit(0.0)).otherwise(own - rest).alias("score"))


def _scores(scored: DataFrame) -> DataFrame:
    return scored.select("blob_id", "label", "score")


def loss_attack(model: TargetModel, docs: DataFrame) -> DataFrame:
    """blob_id, label, score of every row; null where nothing can be scored."""
    return _scores(mean_logprobs(model, rows_of(docs), LOSS_TOKENS, ROW))


def min_k_attack(model: TargetModel, docs: DataFrame, k: float = K) -> DataFrame:
    return _scores(min_k(lists(model, rows_of(docs), MIN_K_TOKENS, ROW), k, ROW))


def swap_attack(model: TargetModel, docs: DataFrame, seed: int = 42) -> DataFrame:
    """Texts without scored tokens have distance 0."""
    keys = (*ROW, "variant")
    orders = lambda n, blob: [np.array(swap_order(n, "" if blob is None else blob, v, seed, SWAP_RATIO), dtype=np.int64) for v in range(MUTANTS + 1)]
    lps = lists(model, rows_of(docs), SWAP_TOKENS, keys, lambda rows: swap_tokens(rows, seed), ("blob_id", "variant", orders))
    return _scores(combine_mutants(polarized_distance(lps, keys=keys).fillna(0.0, ["score"]), ROW))
