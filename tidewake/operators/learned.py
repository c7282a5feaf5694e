"""Trained attacks: bag of words, element hits, and stability under perturbation."""

from __future__ import annotations

import pickle
import secrets
from collections.abc import Callable
from contextlib import nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bag, elements, logistic, perturb
from .data import val_split
from .lm import FeatureModel, TargetModel
from .measures import TrainedFeatures
from .together import adding
from ..functions.folds import bind
from ..functions.text import cosine
from ..sources.scratch import discard, measured, scratch_path, written

TERMS, TOP = 50_000, 40
GEN_TOKENS, PROMPT_TOKENS = 50, 1024
#: Weights that a step of Adam changes at a time; rows of a step (27 numbers each) up to which one task trains faster than several add up half a million gradients.
ADAM, ALONE = 1 << 13, 64
#: Rows of two numbers that are broadcast at most.
SMALL = 200_000
#: Texts that are packed into a block of rows at a time.
PACKED = 2000
DEALT = 1 << 22
SEED = 42


# --- bag of words


def terms_of(text: Column) -> Column:
    """The lower-cased words of two or more characters of a text, and the pairs of them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    none = F.array().cast("array<string>")
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(none)
    return F.coalesce(bind(words, lambda w: F.concat(w, pairs(w))), none)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """blob_id, term, tf of lower-cased words of two or more characters, and of pairs of them.

    Texts are shuffled by id, in partitions of about DEALT characters, and not their terms, of which there are two a word."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // DEALT)
    rows = docs.select("blob_id", "text").repartition(parts, "blob_id")
    return rows.select("blob_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("blob_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, size: int = TERMS) -> DataFrame:
    """term, cf, df, idx of the ``size`` terms of the highest corpus frequency (ties: the smaller term)."""
    top = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).orderBy(F.desc("cf"), "term").limit(size)
    return top.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)  # at most ``size`` rows


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """blob_id, term, idx, w: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per text."""
    w = (1 + F.log("tf")) * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)
    rows = counts.join(F.broadcast(vocab), "term").select("blob_id", "term", "idx", w.alias("w"))  # the vocabulary is capped
    return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("blob_id"))))


class BagOfWords:
    """TF-IDF with logistic regression; the model-free reference for all other attacks."""

    requires_model = False

    def __init__(self, model: TargetModel | None = None, seed: int = SEED, **options) -> None:
        pass

    def fit(self, docs: DataFrame) -> BagOfWords:
        self.n, characters = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        rows, again = bag.by_id(docs, terms_of)
        top = bag.commonest(rows, TERMS, characters)
        top = top.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)  # at most TERMS rows
        self.vocab = docs.sparkSession.createDataFrame(top.collect(), "term string, cf long, df long, idx int")
        self.bags = bag.Bags(self.vocab, self.n)
        sent = docs.sparkSession.sparkContext.broadcast(self.bags)

        def pack(batches):
            kind = pa.schema([("labels", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])
            for batch in batches:
                for low in range(0, batch.num_rows, PACKED):
                    part = batch.slice(low, PACKED)
                    (labels, own), (row, idx, tf) = bag._flat(part.column("labels")), sent.value.rows(part.column("h"))
                    nth = np.arange(len(own)) - np.searchsorted(own, own)
                    for k in range(int(nth.max(initial=-1)) + 1):  # an id of several rows has as many, of the same terms
                        which = np.flatnonzero(nth == k)
                        chosen = np.isin(row, own[which])
                        (y, sizes), data = logistic.packed(labels[which].astype(float), np.searchsorted(own[which], row[chosen]), idx[chosen], tf[chosen])
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((y, sizes, data), kind, strict=True)], schema=kind)

        blocks = rows.select("labels", bag.hashed().alias("h")).mapInArrow(pack, "labels array<double>, sizes array<int>, data binary")
        theta = logistic.fit(blocks, len(self.bags.idf), weigh=self.bags.weights)
        self.coefficients, self.intercept = theta[:-1], float(theta[-1])
        discard(again)
        return self

    def _coefficients(self) -> DataFrame:
        """idx, coef: at most TERMS rows."""
        return self.vocab.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(self.coefficients)], "idx int, coef double")

    def score(self, docs: DataFrame) -> DataFrame:
        """Probabilities as sums of weights times coefficients, where the texts are."""
        sent = docs.sparkSession.sparkContext.broadcast((self.bags, self.coefficients, self.intercept))

        def judge(batches):
            bags, coefficients, intercept = sent.value
            for batch in batches:
                row, idx, tf = bags.rows(batch.column("h"))
                z = np.bincount(row, weights=bags.weights(row, idx, tf, batch.num_rows) * coefficients[idx], minlength=batch.num_rows) + intercept
                yield pa.RecordBatch.from_arrays([batch.column("blob_id"), batch.column("labels"), pa.array(1 / (1 + np.exp(-z)))], names=["blob_id", "labels", "score"])

        kinds = dict(docs.dtypes)
        rows, _ = bag.by_id(docs, terms_of)
        scored = rows.select("blob_id", "labels", bag.hashed().alias("h")).mapInArrow(judge, f"blob_id {kinds['blob_id']}, labels array<{kinds['label']}>, score double")
        return scored.select("blob_id", F.explode("labels").alias("label"), "score")

    def top_features(self, n: int = TOP) -> DataFrame:
        """term, coef, side: the n largest and the n smallest coefficients."""
        coef = self._coefficients().join(self.vocab, "idx")
        high = coef.orderBy(F.desc("coef"), "term").limit(n).select("term", "coef", F.lit("member").alias("side"))
        return high.unionByName(coef.orderBy("coef", "term").limit(n).select("term", "coef", F.lit("other").alias("side")))


# --- element hits


class ElementHits:
    """A random forest over the twelve hit features."""

    requires_model = True
    columns = [f"{x}_{y}" for x in elements.FEATURE_ORDER for y in ("hits", "total")]

    def __init__(self, model: TargetModel, seed: int = SEED, **options) -> None:
        self.lm, self.seed = model, seed

    def features(self, docs: DataFrame) -> DataFrame:
        """Written once: the forest reads its rows at every level of its trees."""
        own = written(docs.select("blob_id", "label"), "hits-docs")
        found = elements.features(own, elements.infill_hits(self.lm, docs.select("blob_id", "text"), self.seed))
        rows = written(own.join(found, "blob_id"), "hits-features")
        return VectorAssembler(inputCols=self.columns, outputCol="features").transform(rows)

    def fit(self, docs: DataFrame) -> ElementHits:
        forest = RandomForestClassifier(numTrees=100, maxDepth=20, featureSubsetStrategy="sqrt", impurity="gini", seed=self.seed, featuresCol="features", labelCol="label").fit(self.features(docs))
        path = scratch_path(docs.sparkSession, "forest")  # a stored model has no training summary, whose session cannot be sent to executors
        forest.write().overwrite().save(path)
        self.model = RandomForestClassificationModel.load(path)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        return self.model.transform(self.features(docs)).select("blob_id", "label", vector_to_array("probability")[1].alias("score"))


# --- stability under perturbation


def stability_features(model: TargetModel, measure: FeatureModel, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """blob_id, label and 27 features: similarities of twelve outputs to the truth with mean and deviation,
    relative perplexities of eleven outputs with mean and deviation. Outputs are written once and end before
    a line end; each text is embedded once, and of equal outputs, which most variants of a text have, one is measured."""
    split = perturb.prefix_split(docs.select("blob_id", "label", "text"), seed)
    rows = perturb.variants(split.select("blob_id", "label", "prefix"), "prefix", seed, PROMPT_TOKENS)
    out = model.generate(rows.select("blob_id", "label", "variant", F.col("code").alias("text")), GEN_TOKENS, "\n")
    out = written(out.select("blob_id", "label", "variant", F.col("output").alias("text")), "stability")
    named = F.xxhash64("text").alias("output")
    different = written(out.select(named, "text").dropDuplicates(["output"]), "stability-outputs")
    ppl = written(measure.perplexity(different, ("output",)), "stability-ppl")
    ppl = F.broadcast(ppl) if measured(ppl)["rows"] <= SMALL else ppl
    truth = split.select("blob_id", measure.embed(F.col("gt")).alias("truth"))
    sims = out.withColumn("e", measure.embed(F.col("text"))).join(truth, "blob_id").select("blob_id", "label", "variant", named, cosine("e", "truth").alias("sim"))
    return feature_vectors(sims.join(ppl, "output"))


def feature_vectors(rows: DataFrame) -> DataFrame:
    """blob_id, label, features of rows (blob_id, label, variant 0 .. 11, sim, ppl)."""
    sims = [F.max(F.when(F.col("variant") == i, F.col("sim"))).alias(f"s{i}") for i in range(12)]
    ppls = [F.max(F.when(F.col("variant") == i, F.col("ppl"))).alias(f"p{i}") for i in range(12)]
    wide = rows.groupBy("blob_id", "label").agg(*sims, *ppls, F.avg("sim").alias("sm"), F.stddev_pop("sim").alias("ss"))
    rel = [(F.col(f"p{i}") - F.col("p0")) / F.col("p0") for i in range(1, 12)]
    arr = F.array(*rel)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / 11
    std = F.sqrt(F.aggregate(F.transform(arr, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / 11)
    return wide.select("blob_id", "label", F.array(*[F.col(f"s{i}") for i in range(12)], "sm", "ss", *rel, mean, std).alias("features"))


def scaler(rows: DataFrame) -> DataFrame:
    """i, mean, std (population; zero reads as one) of each feature."""
    long = rows.select(F.posexplode("features").alias("i", "x"))
    std = F.stddev_pop("x")
    return long.groupBy("i").agg(F.avg("x").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _adam(q: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, count: float, rate: float, t: int) -> None:
    """One step of Adam in place, in pieces that stay in the processor's cache; g: the sum of count gradients."""
    first, second, share, scale, pace = np.empty(min(ADAM, len(q))), np.empty(min(ADAM, len(q))), 1 / count, (1 - 0.999**t) ** -0.5, rate / (1 - 0.9**t)
    for at in range(0, len(q), ADAM):
        x, y, z = q[at : at + ADAM], m[at : at + ADAM], v[at : at + ADAM]
        d, e = first[: len(x)], second[: len(x)]
        np.multiply(g[at : at + ADAM], share, out=d)
        np.subtract(d, y, out=e)
        e *= 0.1
        y += e
        d *= d
        d -= z
        d *= 0.001
        z += d
        np.sqrt(z, out=d)
        d *= scale
        d += 1e-8
        np.divide(y, d, out=d)
        d *= pace
        x -= d


class Mlp:
    """27 -> 512 x 3 -> 2 with ReLU, dropout and Adam, in numpy; rate drops tenfold every ten epochs.

    Batches and dropout follow from a row's number, the epoch and the seed, so the same rows give the same network
    on any number of workers, up to the rounding of sums.
    """

    def __init__(self, seed: int = SEED, hidden: int = 512, epochs: int = 25, batch: int = 32, rate: float = 1e-3, dropout: float = 0.1, steps: int = 1000, alone: int = ALONE) -> None:
        self.alone = alone
        self.seed, self.hidden, self.epochs, self.batch, self.rate, self.dropout, self.steps = seed, hidden, epochs, batch, rate, dropout, steps

    def _draw(self, ids: np.ndarray, epoch: int, unit: np.ndarray) -> np.ndarray:
        key = _mixed(ids.astype(np.uint64)[:, None] + np.uint64((self.seed * 1_000_003 + epoch + 1) * 0x9E3779B97F4A7C15 % 2**64))
        return _mixed(key + unit.astype(np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))

    def _sums(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> list[np.ndarray]:
        """Sums over rows of the gradients of weights and offsets; keep: the rows' dropout factors of the three layers."""
        layers = [x]
        for i in range(3):
            layers.append(np.maximum(layers[-1] @ self.w[i] + self.b[i], 0) * keep[:, i])
        logit = layers[-1] @ self.w[3] + self.b[3]
        p = np.exp(logit - logit.max(1, keepdims=True, initial=-np.inf))
        d = p / p.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        gw, gb = [], []
        for i in (3, 2, 1, 0):
            gw.insert(0, np.matmul(layers[i].T, d, out=self.gw[i]))  # in place: new arrays of this size cost as much as the product
            gb.insert(0, d.sum(0))
            if i:
                d = (d @ self.w[i].T) * (layers[i] > 0) * keep[:, i - 1]
        return [*gw, *gb]

    def _train(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, n: int, val: tuple[np.ndarray, np.ndarray] | None, together: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Mlp:
        """Train on this worker's rows of n in all; together adds up a list of arrays over the workers."""
        self.history: list[tuple[float, float]] = []
        r = np.random.default_rng(self.seed)
        sizes = [x.shape[1], self.hidden, self.hidden, self.hidden, 2]
        self.w = [r.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        params, self.gw = [*self.w, *self.b], [np.empty_like(w) for w in self.w]
        moments, t = [(p.ravel(), np.zeros(p.size), np.zeros(p.size)) for p in params], 0
        steps, units = max(1, min(self.steps, -(-n // self.batch))), np.arange(3 * self.hidden) + 1
        for epoch in range(self.epochs):
            step_of = (self._draw(ids, epoch, np.zeros(1))[:, 0] % np.uint64(steps)).astype(int)
            order = np.argsort(step_of, kind="stable")
            cuts = np.searchsorted(step_of[order], np.arange(steps + 1))
            for k in range(steps):
                at = np.sort(order[cuts[k] : cuts[k + 1]])
                drawn = self._draw(ids[at], epoch, units) >> np.uint64(11)
                keep = (drawn >= np.uint64(int(self.dropout * 2**53))) / (1 - self.dropout)
                *grads, count = together([*self._sums(x[at], y[at], keep.reshape(-1, 3, self.hidden)), np.array([float(len(at))])])
                if not count[0]:
                    continue
                t += 1
                for (q, m, v), g in zip(moments, grads, strict=True):
                    _adam(q, m, v, np.ravel(g), count[0], self.rate * 0.1 ** (epoch // 10), t)
            if val is not None:
                loss, right, count = together([np.array([z]) for z in self._judge(*val)])
                if count[0]:
                    self.history.append((float(loss[0] / count[0]), float(right[0] / count[0])))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, val: tuple[np.ndarray, np.ndarray] | None = None) -> Mlp:
        """Train on (x, y) here; ``history`` holds evaluate(*val) after every epoch, which decides nothing."""
        return self._train(x, y, np.arange(len(x)), len(x), val, lambda parts: parts)

    def fit_rows(self, rows: DataFrame, mean: np.ndarray, std: np.ndarray, workers: int) -> Mlp:
        """Train on written rows (id, features, label, split: fit or val) where they are: a barrier stage of ``workers``
        tasks, each with its part of the rows, that add up their gradients at every step. The driver gets the network.

        Up to ``ALONE`` rows a step, which bounds the rows as well, one task does it."""
        n, net, key = rows.filter("split = 'fit'").count(), self, secrets.token_bytes(16)
        workers = 1 if n <= self.alone * self.steps else workers

        def work(batches):
            task = BarrierTaskContext.get()

            table = pa.Table.from_batches(list(batches), schema)
            order = np.argsort(table.column("id").to_numpy(), kind="stable")
            x = (np.array(table.column("features").to_pylist(), dtype=float).reshape(-1, len(mean))[order] - mean) / std
            ids, y = table.column("id").to_numpy()[order], table.column("label").to_numpy()[order].astype(int)
            fit = np.array(table.column("split").to_pylist(), dtype=object)[order] == "fit"
            with nullcontext(lambda parts: parts) if workers == 1 else adding(task, key) as together:
                net._train(x[fit], y[fit], ids[fit], n, (x[~fit], y[~fit]), together)
            if task.partitionId() == 0:
                yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps((net.w, net.b, net.history))], pa.binary())})

        schema = pa.schema([("id", pa.int64()), ("features", pa.list_(pa.float64())), ("label", pa.int32()), ("split", pa.string())])
        dealt = rows.select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"), F.col("split").cast("string").alias("split"))
        self.w, self.b, self.history = pickle.loads(dealt.repartition(workers).mapInArrow(work, "net binary", barrier=True).collect()[0]["net"])
        return self

    def _judge(self, x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
        """Sum of the cross-entropies, rows whose likelier class is the label, and rows."""
        p = self.predict(x)
        right = np.where(y == 1, p, 1 - p)
        with np.errstate(divide="ignore"):
            return float(-np.log(right).sum()), float(((p > 0.5) == (y == 1)).sum()), float(len(y))

    def predict(self, x: np.ndarray) -> np.ndarray:
        for i in range(3):
            x = np.maximum(x @ self.w[i] + self.b[i], 0)
        logit = x @ self.w[3] + self.b[3]
        return 1 / (1 + np.exp(logit[:, 0] - logit[:, 1]))

    def evaluate(self, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Mean cross-entropy and accuracy."""
        loss, right, n = self._judge(x, y)
        return loss / n, right / n


class Stability:
    """The perceptron over stability features; it trains on half of the training split, judged on the other half after every epoch."""

    requires_model = True

    def __init__(self, model: TargetModel, seed: int = SEED, features: FeatureModel | None = None, workers: int = 4, **options) -> None:
        self.lm, self.seed, self.workers = model, seed, workers
        self.measure = features

    def fit(self, docs: DataFrame) -> Stability:
        if self.measure is None:  # trained on these texts, apart from the target model
            self.measure = TrainedFeatures(docs)
        rows = written(stability_features(self.lm, self.measure, docs, self.seed).withColumn("text", F.lit("")), "stability-fit")
        parts = written(val_split(rows, 0.5, self.seed).withColumn("id", F.monotonically_increasing_id()), "stability-parts")
        stats = scaler(parts.filter("split = 'fit'")).orderBy("i").collect()  # one row a feature
        self.mean, self.std = np.array([r["mean"] for r in stats]), np.array([r["std"] for r in stats])
        workers = max(1, min(self.workers, docs.sparkSession.sparkContext.defaultParallelism))
        self.net = Mlp(self.seed).fit_rows(parts, self.mean, self.std, workers)
        discard(rows, parts)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast((self.net, self.mean, self.std))

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            net, mean, std = sent.value
            return pd.Series(net.predict((np.stack(features.to_numpy()) - mean) / std)) if len(features) else pd.Series([], dtype=float)

        return stability_features(self.lm, self.measure, docs, self.seed).select("blob_id", "label", predict("features").alias("score"))
