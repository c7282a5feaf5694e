"""Toxicity by a bidirectional GRU with attention pooling, over character and word inputs.

A word's input is the sum of a hashed word embedding and the mean of its hashed character 3- and
4-gram embeddings; one
coordinate of each says how much more often toxic training texts hold the word or gram. Windows of ``WIDTH`` words every ``STRIDE`` words are read by a GRU in either
direction; attention weights pool the states, and a linear layer gives the window's logit. A text's
logit is the largest over all its windows. The network is trained in numpy on at most
``SAMPLE`` labelled documents of each class, whole texts, by the windows that decide
each text; then one offset is fitted, on cross-fitted logits, so that the threshold 0.7 lies between the classes.

Inputs are texts alone: no label, language, source or id. Defined cases: null and empty texts have
one empty window and get its score; null labels and labels without a document teach nothing; a
document that several labels disagree on counts as toxic; repeated rows are scored as they are;
without labelled documents of both classes the score is 0; other columns are ignored.
"""

from __future__ import annotations

import pickle
from concurrent.futures import ProcessPoolExecutor
from multiprocessing import get_context

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import broadcast_if_small, groups_by_size, utf8

WIDTH, STRIDE = 32, 16
#: Labelled documents of each class used for training, at most.
SAMPLE = 500
THRESHOLD = 0.7
HIDDEN, INPUT = 8, 12
WORDS, GRAMS = 1 << 13, 1 << 14
EPOCHS, BATCH, RATE = 7, 32, 0.02
#: Parts of the training texts for cross-fitting; the share of the rate at which embeddings move with SAMPLE toxic texts.
FOLDS, MOVE = 5, 0.1
_CHUNK = 1 << 20
_CACHE = 1 << 16
_SHUT = 30.0  # update gate of padding: the state stays


def _grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the 3- and 4-grams of each word between border marks."""
    sizes = ends - starts + 2
    to = np.cumsum(sizes)
    at = to - sizes
    flat = np.full(int(to[-1]) if len(to) else 0, 2, dtype=np.uint8)
    word = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(flat)) - at[word]
    body = (inner > 0) & (inner < sizes[word] - 1)
    flat[body] = raw[(starts[word] + inner - 1)[body]]
    flat[at] = 1
    who, bucket = [], []
    h = kernels._MIX[flat]
    for n in (3, 4):
        if len(flat) < n:
            continue
        g = kernels.rolling(h, n)
        same = word[n - 1 :] == word[: len(word) - n + 1]
        who.append(word[: len(word) - n + 1][same])
        bucket.append((g[same] % np.uint64(GRAMS)).astype(np.int32))
    return (np.concatenate(who), np.concatenate(bucket)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _sum_rows(table: np.ndarray, who: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Mean of the rows of table that each word (numbered in ascending order) refers to."""
    out = np.zeros((n, table.shape[1]), dtype=np.float32)
    order = np.argsort(who, kind="stable")
    who, bucket = who[order], bucket[order]
    for lo in range(0, len(who), 1 << 18):
        hi = min(lo + (1 << 18), len(who))
        first = np.flatnonzero(np.concatenate([[True], np.diff(who[lo:hi]) != 0]))
        out[who[lo:hi][first]] += np.add.reduceat(table[bucket[lo:hi]], first, axis=0)
    count = np.bincount(who, minlength=n).astype(np.float32)
    return out / np.maximum(count, 1)[:, None]


class Text:
    """Word hashes of texts, the distinct words among them, and the index of each window's words."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
        self.raw, self.starts, self.ends, self.hashes = kernels.words(data)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, bounds)
        counts = np.diff(self.first)
        steps = np.maximum(1, -(-np.maximum(counts - WIDTH, 0) // STRIDE) + 1)
        self.doc = np.repeat(np.arange(len(texts)), steps)
        k = np.arange(len(self.doc)) - np.repeat(np.cumsum(steps) - steps, steps)
        self.at = self.first[self.doc] + k * STRIDE
        self.stop = self.first[self.doc + 1]

    def windows(self, lo: int, hi: int, index: np.ndarray, pad: int) -> np.ndarray:
        pos = self.at[lo:hi, None] + np.arange(WIDTH)
        inside = pos < self.stop[lo:hi, None]
        return np.where(inside, index[np.minimum(pos, max(0, len(index) - 1))], pad) if len(index) else np.full(pos.shape, pad)


class Net:
    """Parameters, forward pass, and gradients of the network."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": g(WORDS, INPUT, scale=0.1), "gram": g(GRAMS, INPUT, scale=0.3), "w": g(2, INPUT, 3 * HIDDEN, scale=0.4), "u": g(2, HIDDEN, 3 * HIDDEN, scale=0.3), "b": np.zeros((2, 3 * HIDDEN), np.float32), "v": g(2 * HIDDEN, scale=0.3), "c": g(2 * HIDDEN, scale=0.5), "d": np.full(1, -1.0, np.float32)}
        self.shift = 0.0

    def inputs(self, hashes, raw, starts, ends):
        who, bucket = _grams(raw, starts, ends)
        word = (hashes % np.uint64(WORDS)).astype(np.int32)
        return self.p["word"][word] + _sum_rows(self.p["gram"], who, bucket, len(hashes)), (who, bucket, word)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of each word in both directions, and of padding in the last row."""
        out = np.zeros((2, len(x) + 1, 3 * HIDDEN), dtype=np.float32)
        out[:, :-1] = np.matmul(x[None], self.p["w"]) + self.p["b"][:, None]
        out[:, -1, :HIDDEN] = _SHUT
        return out

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows of word indices; index -> gates rows."""
        n, pad = len(index), gates.shape[1] - 1
        states = np.empty((n, WIDTH, 2 * HIDDEN), dtype=np.float32)
        kept = []
        for d in range(2):
            h, u = np.zeros((n, HIDDEN), dtype=np.float32), self.p["u"][d]
            for t in range(WIDTH) if d == 0 else range(WIDTH - 1, -1, -1):
                x, s = gates[d][index[:, t]], h @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                if keep:
                    kept.append((d, t, h, z, r, c, s[:, 2 * HIDDEN :]))
                h = c + z * (h - c)
                states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        a = np.where(index == pad, np.float32(-1e9), states @ self.p["v"])
        a = np.exp(a - a.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, states)
        logit = pooled @ self.p["c"] + self.p["d"][0]
        return (logit, states, a, pooled, kept) if keep else logit

    def gradients(self, gates, x, feats, index, out, slope):
        """Of sum(slope * logit) in all parameters."""
        _, states, a, pooled, kept = out
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"], g["d"] = slope @ pooled, np.array([slope.sum()], dtype=np.float32)
        dpool = slope[:, None] * p["c"]
        da = np.einsum("nh,nth->nt", dpool, states)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,nth->h", ds, states)
        dstate = a[:, :, None] * dpool[:, None] + ds[:, :, None] * p["v"]
        dgate = np.zeros_like(gates)
        dh, now = None, None
        for d, t, h, z, r, c, sc in reversed(kept):
            if d != now:
                now, dh = d, np.zeros_like(h)
            dh = dh + dstate[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * sc * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], axis=1)
            dsum = np.concatenate([dz, dr, dc * r], axis=1)
            g["u"][d] += h.T @ dsum
            np.add.at(dgate[d], index[:, t], dx)
            dh = dh * z + dsum @ p["u"][d].T
        dgate = dgate[:, :-1]
        g["b"] = dgate.sum(axis=1)
        g["w"] = np.matmul(x.T[None], dgate)
        dx = np.einsum("dnk,dik->ni", dgate, p["w"])
        who, bucket, word = feats
        np.add.at(g["word"], word, dx)
        np.add.at(g["gram"], bucket, (dx / np.maximum(np.bincount(who, minlength=len(dx)), 1)[:, None])[who].astype(np.float32))
        return g


class Scorer:
    """Scores texts with gate inputs cached by word."""

    def __init__(self, net: Net) -> None:
        self.net, self.known, self.gates = net, np.zeros(0, dtype=np.uint64), None

    def _gates(self, t: Text) -> np.ndarray:
        new = np.unique(t.hashes)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
            new = new[self.known[at] != new]
        if len(new) or self.gates is None:
            if len(self.known) + len(new) > _CACHE:
                self.known, self.gates, new = self.known[:0], None, np.unique(t.hashes)
            seen, where = np.unique(t.hashes, return_index=True)
            where = where[np.searchsorted(seen, new)]
            x, _ = self.net.inputs(new, t.raw, t.starts[where], t.ends[where])
            made = self.net.project(x)
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            body = made[:, :-1] if self.gates is None else np.concatenate([self.gates[:, :-1], made[:, :-1]], axis=1)
            self.gates = np.concatenate([body[:, order], made[:, -1:]], axis=1)
            self.known = known[order]
        return np.searchsorted(self.known, t.hashes)

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, Text, np.ndarray]:
        t = Text(texts)
        index, pad = self._gates(t), self.gates.shape[1] - 1
        out = np.concatenate([self.net.forward(self.gates, t.windows(at, at + 4096, index, pad)) for at in range(0, len(t.doc), 4096)])
        best = np.full(len(texts), -np.inf, dtype=np.float32)
        np.maximum.at(best, t.doc, out)
        return best, t, out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for lo, hi in groups_by_size(texts, _CHUNK):
            out.append(self.logits(texts[lo:hi])[0])
        logit = np.round(np.concatenate(out).astype(np.float64) if out else np.zeros(0), 3) + self.net.shift
        return np.round(1 / (1 + np.exp(-np.clip(logit, -60, 60))), 6)


def _evidence(net: Net, texts: list[bytes], y: np.ndarray, fold: np.ndarray) -> list[dict[str, np.ndarray]]:
    """How much more toxic texts hold each word and gram, shrunk towards none: from all texts but those of each fold, and, last, from all."""
    folds = int(fold.max()) + 1
    held = {k: np.zeros((folds, 2, len(net.p[k]))) for k in ("word", "gram")}
    for text, label, f in zip(texts, y.astype(int), fold, strict=True):
        t = Text([text])
        seen, where = np.unique(t.hashes, return_index=True)
        _, (_, bucket, word) = net.inputs(seen, t.raw, t.starts[where], t.ends[where])
        held["word"][f, label, np.unique(word)] += 1
        held["gram"][f, label, np.unique(bucket)] += 1
    out = []
    for f in [*range(folds), None]:
        n = [((fold != f) & (y == label)).sum() for label in (0, 1)]
        counts = {k: v.sum(0) - (v[f] if f is not None else 0) for k, v in held.items()}
        out.append({k: np.log((toxic + 2) / (clean * n[1] / max(1, n[0]) + 2)).astype(np.float32) for k, (clean, toxic) in counts.items()})
    return out


def _border(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut between the classes at which a share of clean texts called toxic costs four times a share of toxic ones missed; the middle of the widest such gap."""
    points = np.sort(logit)
    cuts = (points[1:] + points[:-1]) / 2
    cost = [4 * ((logit >= c) & (y == 0)).sum() / (y == 0).sum() + ((logit < c) & (y > 0)).sum() / (y > 0).sum() for c in cuts]
    best = np.flatnonzero(np.array(cost) <= min(cost) + 1e-9)
    return float(cuts[max(best, key=lambda i: points[i + 1] - points[i])])


def train(texts: list[bytes], toxic: list[int], epochs: int = EPOCHS, seed: int = 5) -> Net | None:
    """The network fitted to whole texts and their labels (None without both classes).

    The evidence coordinates are cross-fitted: a text is learned from, and the border is set, with the
    evidence of the other folds only, so that a word that one text holds by chance teaches nothing. The other
    coordinates move the less the fewer texts there are.
    """
    y = np.array(toxic, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, r = Net(seed), np.random.default_rng(seed)
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        mine = r.permutation(np.flatnonzero(y == label))
        fold[mine] = np.arange(len(mine)) % FOLDS
    evidence = _evidence(net, texts, y, fold)

    def use(f: int) -> None:
        for at, (k, table) in enumerate(evidence[f].items()):
            net.p[k][:, at] = table

    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    slow = {k: MOVE * min(1.0, y.sum() / SAMPLE) ** 2 for k in ("word", "gram")}
    rounds = max(epochs, min(60, 1500 * epochs // (SAMPLE + len(y))))
    for epoch in range(rounds):
        orders = [r.permutation(np.flatnonzero(fold == f)) for f in range(int(fold.max()) + 1)]
        batches = [(f, order[lo : lo + BATCH]) for f, order in enumerate(orders) for lo in range(0, len(order), BATCH)]
        for n in r.permutation(len(batches)):
            f, mine = batches[n]
            use(f)
            t = Text([texts[i] for i in mine])
            seen, where, index = np.unique(t.hashes, return_index=True, return_inverse=True)
            x, feats = net.inputs(seen, t.raw, t.starts[where], t.ends[where])
            gates, pad = net.project(x), len(seen)
            logit = np.concatenate([net.forward(gates, t.windows(at, at + 4096, index, pad)) for at in range(0, len(t.doc), 4096)])
            rank = np.lexsort((-logit, t.doc))
            place = np.arange(len(rank)) - np.searchsorted(t.doc[rank], t.doc[rank])
            take = np.sort(rank[place < (4 if epoch == 0 else 2)])
            windows = np.concatenate([t.windows(i, i + 1, index, pad) for i in take])
            out = net.forward(gates, windows, keep=True)
            who = mine[t.doc[take]]
            part = np.bincount(t.doc[take], minlength=len(mine))[t.doc[take]]
            slope = ((1 / (1 + np.exp(-out[0])) - y[who]) * balance[who] / part / len(mine)).astype(np.float32)
            grads, step = net.gradients(gates, x, feats, windows, out, slope), step + 1
            rate = RATE * min(1.0, 2 * (1 - epoch / rounds))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] -= (slow.get(k, 1.0) * rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    logit = np.zeros(len(y))
    for f in range(int(fold.max()) + 1):
        use(f)
        scorer, mine = Scorer(net), np.flatnonzero(fold == f)
        logit[mine] = np.concatenate([scorer.logits([texts[i] for i in mine[lo:hi]])[0] for lo, hi in groups_by_size([texts[i] for i in mine], _CHUNK)])
    use(-1)
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - _border(logit, y))
    return net


def held_out(doc_id):
    """Ids whose labels are never learned from: crc32 of the id's text modulo 3 is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net | None:
    """Train on at most ``sample`` labelled documents of each class that are not held out, chosen by a hash of the id;
    of an id that repeats with other texts the smallest text is used. The sample is trained on in one task; the driver
    gets the parameters."""
    ids = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    ids = ids.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = ids.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text of an id: at most 2 * sample rows

    def learn(table: pa.Table) -> pa.Table:
        held = sorted((r["doc_id"], r["text"], r["toxic"]) for r in table.to_pylist())
        with ProcessPoolExecutor(1, mp_context=get_context("fork")) as child:  # whose memory goes back as it ends
            net = child.submit(train, [t.encode() for _, t, _ in held], [x for *_, x in held]).result()
        return pa.table({"net": pa.array([pickle.dumps(net)], pa.binary())})

    trained = found.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "net binary").collect()
    return pickle.loads(trained[0]["net"]) if trained else None


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs' doc_id and score."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.scores(utf8(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(scan, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the network does not call toxic."""
    net = fit(docs, labels)
    if net is None:
        return docs
    sent, columns, schema = docs.sparkSession.sparkContext.broadcast(net), docs.columns, docs.schema

    def scan(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            good = scorer.scores(utf8(batch.column("text").cast(pa.string()))) < THRESHOLD
            yield pa.RecordBatch.from_arrays(batch.columns, names=columns).filter(pa.array(good))

    return docs.mapInArrow(scan, schema)
