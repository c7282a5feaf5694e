"""Feature models that are trained apart from the target model: Kneser-Ney trigrams for perplexity, and
word vectors of a factorised co-occurrence matrix for embeddings."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, settle, written
from . import packed
from .lm import tokenize

# Tokens that an embedding and a perplexity read, and what stands for perplexities that are not defined.
EMBEDDED, POSITIONS = 512, 1024
EMPTY, UNDEFINED = 100.0, 1e6
DISCOUNT = 0.75


def _ending(cut: Callable[[Column], Column], longest: int | None) -> Column:
    """The tokens of ``text``; of one of more than ``longest`` characters, the last that many."""
    t = cut(F.col("text"))
    if longest:
        t = F.when(F.length("text") > longest, F.slice(t, F.greatest(F.size(t) - longest + 1, F.lit(1)), longest)).otherwise(t)
    return t


def triples(docs: DataFrame, keys: tuple = (), cut: Callable[[Column], Column] = tokenize, longest: int | None = None) -> DataFrame:
    """keys, pos, u, v, w: each token w after the two before it, which are empty ahead of the text.

    longest: of a text of more characters than that, the last that many tokens count.
    """
    rows = docs.select(*keys, F.concat(F.array(F.lit(""), F.lit("")), _ending(cut, longest)).alias("t")).filter(F.size("t") > 2)
    at = F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda i: F.struct((i - 2).alias("pos"), F.get("t", i - 2).alias("u"), F.get("t", i - 1).alias("v"), F.get("t", i).alias("w")))
    return rows.select(*keys, F.inline(at))


class KneserNey:
    """Interpolated Kneser-Ney trigrams with one discount.

    The counts of shorter histories are continuation counts: of how many different tokens a pair, or a
    token, was seen after. What the discount takes is handed to the shorter history, and last to all known
    tokens and one unknown one alike, so the probabilities of every history sum to 1.
    """

    def __init__(self, docs: DataFrame, discount: float = DISCOUNT, cut: Callable[[Column], Column] = tokenize) -> None:
        self.cut, d = cut, F.lit(float(discount))
        share = lambda n, total: F.greatest(n - d, F.lit(0.0)) / total
        rest = lambda kinds, total: d * kinds / total
        three = written(triples(docs, cut=cut).groupBy("u", "v", "w").agg(F.count("*").alias("n")), "kn-three")
        two = written(three.groupBy("v", "w").agg(F.count("*").alias("n")), "kn-two")
        one = written(two.groupBy("w").agg(F.count("*").alias("n")), "kn-one")
        after3 = written(three.groupBy("u", "v").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "kn-after3")
        after2 = written(two.groupBy("v").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "kn-after2")
        total, known = one.agg(F.sum("n"), F.count("*")).first()
        #: The probability of a token that was never seen, without a history.
        self.unknown = discount * known / total / (known + 1) if known else 1.0
        self.one = one.select("w", (share(F.col("n"), F.lit(float(total or 1))) + F.lit(self.unknown)).alias("p1"))
        self.two = two.join(after2, "v").select("v", "w", share(F.col("n"), F.col("total")).alias("p2"))
        self.three = three.join(after3, ["u", "v"]).select("u", "v", "w", share(F.col("n"), F.col("total")).alias("p3"))
        self.after2 = after2.select("v", rest(F.col("kinds"), F.col("total")).alias("r2"))
        self.after3 = after3.select("u", "v", rest(F.col("kinds"), F.col("total")).alias("r3"))
        self.three, self.two = written(self.three, "kn-p3"), written(self.two, "kn-p2")
        discard(three, two)

    def logprobs(self, at: DataFrame) -> DataFrame:
        """u, v, w, lp of each distinct triple of at."""
        rows = at.select("u", "v", "w").distinct()
        for table, on in ((self.three, ["u", "v", "w"]), (self.after3, ["u", "v"]), (self.two, ["v", "w"]), (self.after2, ["v"]), (self.one, ["w"])):
            rows = rows.join(table, on, "left")
        p = F.coalesce("p1", F.lit(self.unknown))
        for own, rest in (("p2", "r2"), ("p3", "r3")):
            p = F.coalesce(own, F.lit(0.0)) + F.coalesce(rest, F.lit(1.0)) * p
        return rows.select("u", "v", "w", F.log(p).alias("lp"))

    def perplexity(self, docs: DataFrame, keys: tuple = ("blob_id",), longest: int = POSITIONS) -> DataFrame:
        """keys, ppl = exp(-mean log-probability of all tokens but the first); of texts of over ``longest``
        characters the last ``longest`` tokens count. An empty text has 100, a text of one token, or none, 1e6."""
        rows = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
        ends = F.transform(F.concat(F.array(F.lit(""), F.lit("")), _ending(self.cut, longest)), lambda w: F.xxhash64(w))
        unknown = self.unknown

        def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            or_else = lambda x, y: np.where(np.isnan(x), y, x)
            p = or_else(a[2], 0.0) + or_else(b[1], 1.0) * or_else(a[0], unknown)
            return np.log(or_else(a[4], 0.0) + or_else(b[3], 1.0) * p)

        values = self.values
        settle(docs.sparkSession)
        sums = written(values.sums(rows, keys, ends, score), "kn-sums")
        means = sums.groupBy(*keys).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("_mean"))
        out = rows.select(*keys, (F.length("text") == 0).alias("_empty")).join(means, list(keys), "left")
        return out.select(*keys, F.when(F.col("_empty"), F.lit(EMPTY)).when(F.col("_mean").isNull(), F.lit(UNDEFINED)).otherwise(F.exp(-F.col("_mean"))).alias("ppl"))

    @cached_property
    def values(self) -> packed.Values:
        """What a probability is made of: p1 and r2 of tokens, p2 and r3 of pairs, p3 of threes."""
        h = lambda c: F.xxhash64(c)
        none, no = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        tokens = self.one.join(self.after2.withColumnRenamed("v", "w"), "w", "full_outer").select(h("w").alias("x"), none.alias("y"), none.alias("z"), F.col("p1").alias("a"), F.col("r2").alias("b"))
        pairs = self.two.join(self.after3.select(F.col("u").alias("v"), F.col("v").alias("w"), "r3"), ["v", "w"], "full_outer").select(h("v"), h("w"), none, "p2", "r3")
        return packed.Values(tokens.union(pairs).union(self.three.select(h("u"), h("v"), h("w"), "p3", no)))


# --- word vectors


def cooccurrences(docs: DataFrame, terms: int = 20_000, window: int = 2) -> tuple[DataFrame, list[str]]:
    """(i, j, x): the positive pointwise mutual information of lower-cased tokens at most ``window`` places
    apart, among the ``terms`` most frequent ones (ties: the smaller token), which are returned in order."""
    t = tokenize(F.lower("text"))
    words = docs.select(F.explode(t).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(terms).collect()
    vocab = sorted(r["token"] for r in words)  # capped by terms
    ids = docs.sparkSession.createDataFrame(list(enumerate(vocab)), "i int, token string")
    near = F.concat(*[F.when(F.size("t") > d, F.zip_with(F.slice("t", F.lit(1), F.size("t") - d), F.slice("t", F.lit(1 + d), F.size("t") - d), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:string,b:string>>")) for d in range(1, window + 1)])
    pairs = docs.select(t.alias("t")).select(F.inline(near)).groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = pairs.join(F.broadcast(ids.select(F.col("token").alias("a"), "i")), "a").join(F.broadcast(ids.select(F.col("token").alias("b"), F.col("i").alias("j"))), "b")
    both = pairs.select("i", "j", "n").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    counts = written(both.groupBy("i", "j").agg(F.sum("n").cast("double").alias("n")), "vectors-counts")
    rows = counts.groupBy("i").agg(F.sum("n").alias("row"))
    total = counts.agg(F.sum("n")).first()[0] or 0.0
    met = counts.join(F.broadcast(rows), "i").join(F.broadcast(rows.select(F.col("i").alias("j"), F.col("row").alias("column"))), "j")  # at most terms rows
    x = F.log(F.col("n") * F.lit(total) / (F.col("row") * F.col("column")))
    out = written(met.select("i", "j", x.alias("x")).filter("x > 0").repartition("i").sortWithinPartitions("i"), "vectors-pmi")
    discard(counts)
    return out, vocab


def times(matrix: DataFrame, dense: np.ndarray) -> np.ndarray:
    """The product of a matrix (i, j, x), whose rows lie together, and a dense one of few columns."""
    sent = matrix.sparkSession.sparkContext.broadcast(dense)

    def part(batches):
        for batch in batches:
            if batch.num_rows:
                i, j, x = (batch.column(c).to_numpy() for c in ("i", "j", "x"))
                for lo in range(0, len(i), 65536):
                    own = i[lo : lo + 65536]
                    first = np.flatnonzero(np.append(True, np.diff(own) != 0))
                    sums = np.add.reduceat(sent.value[j[lo : lo + 65536]] * x[lo : lo + 65536, None], first, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(list(sums))], names=["i", "y"])

    out = np.zeros_like(dense)
    found = matrix.mapInArrow(part, "i int, y array<double>").toArrow()  # about as many rows as the matrix, each as short as dense's
    for batch in found.to_batches():
        np.add.at(out, batch.column("i").to_numpy(), batch.column("y").flatten().to_numpy().reshape(-1, dense.shape[1]))
    sent.destroy()
    return out


def decompose(matrix: DataFrame, size: int, rank: int, spare: int = 16, passes: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` largest singular values of a symmetric matrix (i, j, x), and an eigenvector for each, by a randomised
    block Krylov space: products with the matrix are Spark jobs; the bases, ``passes`` blocks of size x (rank + spare), are the driver's."""
    fresh = np.random.default_rng(seed).standard_normal((size, min(size, rank + spare)))
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(passes):
        for _ in range(2):  # orthogonal to what is there, twice for the rounding
            fresh = fresh - basis @ (basis.T @ fresh)
        fresh = np.linalg.qr(fresh)[0][:, : size - basis.shape[1]]
        if not fresh.shape[1]:
            break
        product = times(matrix, fresh)
        basis, image, fresh = np.hstack([basis, fresh]), np.hstack([image, product]), product
    inner = basis.T @ image
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-np.abs(value), kind="stable")[:rank]
    return np.abs(value[best]), basis @ vector[:, best]


class WordVectors:
    """Tokens as rows of the factorised matrix, each direction weighted by the root of its singular value."""

    def __init__(self, docs: DataFrame, rank: int = 64, terms: int = 20_000, window: int = 2, seed: int = 42) -> None:
        matrix, vocab = cooccurrences(docs, terms, window)
        self.rank, self.values, vectors = rank, np.zeros(0), np.zeros((0, rank))
        if vocab:
            self.values, found = decompose(matrix, len(vocab), rank, seed=seed)
            vectors = np.zeros((len(vocab), rank))
            vectors[:, : len(self.values)] = found * np.sqrt(self.values)
        discard(matrix)
        self.sent = docs.sparkSession.sparkContext.broadcast((dict(zip(vocab, range(len(vocab)), strict=True)), vectors.astype(np.float32)))

    def embed(self, text: Column) -> Column:
        """The mean vector of the known ones among the first 512 tokens; zeros without any."""
        sent, rank = self.sent, self.rank

        @F.pandas_udf("array<double>")
        def mean(tokens: pd.Series) -> pd.Series:
            known, vectors = sent.value
            held = ([known[w] for w in t if w in known] for t in tokens)
            return pd.Series([vectors[at].mean(axis=0).astype(float) if at else np.zeros(rank) for at in held], dtype=object)

        return mean(F.slice(tokenize(F.lower(text)), 1, EMBEDDED))


class TrainedFeatures:
    """The feature model of the stability attack: both of the above, trained on texts of one's own choice."""

    def __init__(self, docs: DataFrame, rank: int = 64) -> None:
        self.language, self.vectors = KneserNey(docs), WordVectors(docs, rank)

    def embed(self, text: Column) -> Column:
        return self.vectors.embed(text)

    def perplexity(self, docs: DataFrame, keys: tuple) -> DataFrame:
        return self.language.perplexity(docs, keys)
