"""Target models that live in the workers, such as a served language model, behind the protocol of ``lm.TargetModel``.

``load`` is called once per Python worker and returns an object with

- ``logprobs(texts, max_tokens)``: for each text a list of (token, log-probability) of its tokens but the first;
- ``generate(texts, max_new, stop)``: a continuation of each text that ends before ``stop`` (None: no stop).

Null texts are passed as empty ones.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SCORED = [T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("lp", T.DoubleType())]


@functools.cache
def _in_worker(load: Callable):
    return load()


def _profile(spark: SparkSession, resources: dict[str, float]) -> ResourceProfile | None:
    """What each task of the model's stage asks for; an error, before any job, where the cluster offers none of it."""
    if not resources:
        return None
    tasks, executors = TaskResourceRequests(), ExecutorResourceRequests()
    for name, amount in resources.items():
        offered = spark.conf.get(f"spark.executor.resource.{name}.amount", None)
        if offered is None or float(offered) < amount:
            raise RuntimeError(f"the model asks for {amount:g} {name} a task, and spark.executor.resource.{name}.amount is {offered or 'not set'}")
        tasks.resource(name, amount)
        executors.resource(name, int(float(offered)), spark.conf.get(f"spark.executor.resource.{name}.discoveryScript", ""), spark.conf.get(f"spark.executor.resource.{name}.vendor", ""))
    return ResourceProfileBuilder().require(executors).require(tasks).build


class ServedModel:
    """A model that ``load`` opens in each worker; batch: texts per call; resources: what a task of the
    model's stages needs, such as {"gpu": 1}, which Spark then places by a resource profile."""

    def __init__(self, load: Callable, batch: int = 32, resources: dict[str, float] | None = None) -> None:
        self.load, self.batch, self.resources = load, batch, resources or {}

    def _calls(self, texts: list, call: Callable) -> list:
        return [x for at in range(0, len(texts), self.batch) for x in call([t or "" for t in texts[at : at + self.batch]])]

    def token_logprobs(self, docs: DataFrame, max_tokens: int | None = None, keys: tuple = ("blob_id",), outer: bool = False) -> DataFrame:
        """keys, pos, token, lp; with outer a row of nulls for a text without scored tokens."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _in_worker(self.load)
            for pdf in frames:
                found = self._calls(pdf["text"].tolist(), lambda texts: model.logprobs(texts, max_tokens))
                rows = [(*k, i, token, lp) for k, x in zip(pdf[list(keys)].itertuples(index=False), found, strict=True) for i, (token, lp) in (enumerate(x, 1) if x else [(None, (None, None))] * outer)]
                yield pd.DataFrame(rows, columns=[*keys, "pos", "token", "lp"]).astype({"pos": "Int32"})

        schema = T.StructType([*(docs.schema[k] for k in keys), *_SCORED])
        return docs.select(*keys, "text").mapInPandas(run, schema, profile=_profile(docs.sparkSession, self.resources))

    def _continued(self, prompts: DataFrame, column: str, max_new: int, stop: str | None) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _in_worker(self.load)
            for pdf in frames:
                yield pdf.assign(output=self._calls(pdf[column].tolist(), lambda texts: model.generate(texts, max_new, stop)))

        schema = T.StructType([*prompts.schema.fields, T.StructField("output", T.StringType())])
        return prompts.mapInPandas(run, schema, profile=_profile(prompts.sparkSession, self.resources))

    def generate(self, prompts: DataFrame, max_new: int = 50, stop: str | None = None) -> DataFrame:
        return self._continued(prompts, "text", max_new, stop)

    def infill(self, prompts: DataFrame, max_new: int = 50) -> DataFrame:
        return self._continued(prompts, "prompt", max_new, None)


def open_model(name: str, batch: int = 32, resources: dict[str, float] | None = None) -> ServedModel:
    """The model that ``module:function`` opens; an error names what is missing before any job runs."""
    module, _, function = name.partition(":")
    try:
        load = getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as problem:
        raise RuntimeError(f"no model loader {name!r}: {problem}") from problem
    return ServedModel(load, batch, resources)
