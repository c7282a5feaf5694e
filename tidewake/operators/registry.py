"""The attacks by key, and a whole run: split, fit, score, and the files of a run folder.

An attack is a class with ``requires_model``, made by ``cls(model, seed=..., **options)``, with
``fit(docs)``, which returns the attack, and ``score(docs)``, which returns blob_id, label, score of
every row. ``register`` adds one from outside.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learned, scores
from .data import label_counts, sample_exact, stratified_split
from .lm import TargetModel, require_model
from .metrics import metrics
from ..sources.files import write_csv, write_small_csv
from ..sources.scratch import written


class Attack(Protocol):
    requires_model: bool

    def fit(self, docs: DataFrame) -> Attack:
        """Train on docs (text, blob_id, label)."""

    def score(self, docs: DataFrame) -> DataFrame:
        """blob_id, label, score of docs; a higher score is likelier a member."""


ATTACKS: dict[str, Callable[..., Attack]] = {}


def register(key: str, attack: Callable[..., Attack] | None = None):
    """Add an attack under a key that is not taken, as a call or as a decorator of its class."""

    def put(cls):
        if key in ATTACKS:
            raise ValueError(f"there is an attack {key!r} already")
        ATTACKS[key] = cls
        return cls

    return put if attack is None else put(attack)


class _Untrained:
    requires_model = True

    def __init__(self, model: TargetModel, seed: int = 42, **options) -> None:
        self.model, self.seed, self.options = model, seed, options

    def fit(self, docs: DataFrame) -> _Untrained:
        return self


@register("loss")
class Loss(_Untrained):
    """Mean log-probability."""

    def score(self, docs: DataFrame) -> DataFrame:
        return scores.loss_attack(self.model, docs)


@register("mkp")
class LowestK(_Untrained):
    """Mean of the lowest share k of log-probabilities."""

    def score(self, docs: DataFrame) -> DataFrame:
        return scores.min_k_attack(self.model, docs, **self.options)


@register("pac")
class Swaps(_Untrained):
    """Polarized distance against that of token-swap mutants."""

    def score(self, docs: DataFrame) -> DataFrame:
        return scores.swap_attack(self.model, docs, self.seed)


register("trawic", learned.ElementHits)
register("miaadv", learned.Stability)
register("bow", learned.BagOfWords)


def _scored(key: str, parts: DataFrame, model: TargetModel | None, seed: int, options: dict) -> DataFrame:
    attack = ATTACKS[key](model, seed=seed, **options)
    fit, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")
    return attack.fit(fit).score(test)


def _parts(key: str, docs: DataFrame, model: TargetModel | None, fraction: float, train: float, seed: int) -> DataFrame:
    if key not in ATTACKS:
        raise ValueError(f"unknown attack {key!r}")
    if ATTACKS[key].requires_model:
        require_model(model)
    return stratified_split(sample_exact(docs, fraction, seed), train, seed)


def run_attack(key: str, docs: DataFrame, model: TargetModel | None = None, fraction: float = 1.0, train: float = 0.8, seed: int = 42, **options) -> DataFrame:
    """blob_id, label, score of the test split."""
    return _scored(key, _parts(key, docs, model, fraction, train, seed), model, seed, options)


def evaluate(key: str, docs: DataFrame, **options) -> DataFrame:
    return metrics(run_attack(key, docs, **options))


def summary(parameters: dict, parts: DataFrame, found: DataFrame) -> DataFrame:
    """item, value (text) of a run: its parameters, the members and others of each split, and the metrics, null where undefined."""
    spark = parts.sparkSession
    given = spark.createDataFrame([(k, str(v)) for k, v in sorted(parameters.items())], "item string, value string")
    sizes = label_counts(parts).select(F.explode(F.array(*[F.struct(F.concat_ws(" ", "split", F.lit(c)).alias("item"), F.col(c).cast("string").alias("value")) for c in ("members", "others")])).alias("x")).select("x.*")
    return given.unionByName(sizes).unionByName(found.select(F.col("metric").alias("item"), F.col("value").cast("string").alias("value")))


def run(key: str, docs: DataFrame, folder: str, model: TargetModel | None = None, fraction: float = 1.0, train: float = 0.8, seed: int = 42, **options) -> DataFrame:
    """Run an attack and write its run folder: predictions.csv (part files), metrics.csv and summary.csv (one file each).

    Undefined metrics are empty cells. Returns the summary.
    """
    parts = written(_parts(key, docs, model, fraction, train, seed), "run-parts")
    scored = written(_scored(key, parts, model, seed, options), "run-scores")
    found = written(metrics(scored), "run-metrics")
    write_csv(scored, f"{folder}/predictions.csv")
    write_small_csv(found, f"{folder}/metrics.csv")
    about = written(summary({"attack": key, "sample_fraction": fraction, "train_test_split": train, "seed": seed, **options}, parts, found), "run-summary")
    write_small_csv(about, f"{folder}/summary.csv")
    return about
