"""Operators without SQL against plain versions of their definitions."""

import hashlib
import math
import random
import time
import zlib

import numpy as np

from tidewake.llm import kernels, pii, resample, topk, toxicity

from test_ops import docs, frame, words_of

# --- 2: the network word by word and window by window


def plain_logit(net, text):
    p = net.p
    found = [w.encode() for w in words_of(text)]
    inputs = []
    for w in found:
        _, _, _, h = kernels.words(np.frombuffer(w, dtype=np.uint8))
        framed = b"\1" + w + b"\2"
        grams = [framed[i : i + n] for n in (3, 4) for i in range(len(framed) - n + 1)]
        buckets = [int(kernels.rolling(kernels._MIX[np.frombuffer(g, dtype=np.uint8)], len(g))[0] % np.uint64(toxicity.GRAMS)) for g in grams]
        inputs.append(p["word"][int(h[0] % np.uint64(toxicity.WORDS))] + (np.mean([p["gram"][b] for b in buckets], axis=0) if buckets else 0))
    sigma = lambda v: 1 / (1 + np.exp(-v))
    n, size = toxicity.HIDDEN, toxicity.WIDTH
    best = -np.inf
    for at in range(0, max(1, len(found) - size + toxicity.STRIDE) if len(found) > size else 1, toxicity.STRIDE):
        window = inputs[at : at + size]
        states = [[np.zeros(n), np.zeros(n)] for _ in window]
        for d in (0, 1):
            h = np.zeros(n)
            for t in range(len(window)) if d == 0 else range(len(window) - 1, -1, -1):
                x, s = window[t] @ p["w"][d] + p["b"][d], h @ p["u"][d]
                z, r = sigma(x[:n] + s[:n]), sigma(x[n : 2 * n] + s[n : 2 * n])
                c = np.tanh(x[2 * n :] + r * s[2 * n :])
                h = (1 - z) * c + z * h
                states[t][d] = h
        joined = np.array([np.concatenate(s) for s in states]).reshape(len(window), 2 * n)
        weights = np.exp(joined @ p["v"])
        pooled = (weights[:, None] * joined).sum(axis=0) / weights.sum() if len(window) else np.zeros(2 * n)
        best = max(best, float(pooled @ p["c"] + p["d"][0]))
    return best


def test_toxicity_scores_every_window(monkeypatch):
    net = toxicity.Net(3)
    r = random.Random(1)
    words = ["lorem", "Ipsum", "é", "dolor", "x", "sit-amet", "12"]
    texts = [" ".join(r.choice(words) for _ in range(k)) for k in (1, 2, 31, 32, 33, 47, 48, 49, 64, 65, 200)] + ["-"]
    net.shift = 0.25
    monkeypatch.setattr(toxicity, "_CHUNK", 300)
    got = toxicity.Scorer(net).scores([t.encode() for t in texts])
    for t, score in zip(texts[:-1], got, strict=False):
        assert abs(score - 1 / (1 + math.exp(-(plain_logit(net, t) + 0.25)))) < 2e-3, t


def test_toxicity_gradients_of_embeddings():
    net = toxicity.Net(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.Text([b"some words that repeat some words"])
    seen, where, index = np.unique(t.hashes, return_index=True, return_inverse=True)

    def loss():
        x, feats = net.inputs(seen, t.raw, t.starts[where], t.ends[where])
        gates = net.project(x)
        return net.forward(gates, t.windows(0, 1, index, len(seen))).sum(), gates, x, feats

    _, gates, x, feats = loss()
    windows = t.windows(0, 1, index, len(seen))
    grads = net.gradients(gates, x, feats, windows, net.forward(gates, windows, keep=True), np.ones(1))
    for k, row in (("word", int(feats[2][0])), ("gram", int(feats[1][0]))):
        old = net.p[k][row, 2]
        up, down = (loss()[0] for net.p[k][row, 2] in (old + 1e-2, old - 1e-2))
        net.p[k][row, 2] = old
        assert abs((up - down) / 2e-2 - grads[k][row, 2]) < 2e-3, k


def test_toxicity_of_text_ids(spark):
    rows = [(f"a-{i}", "bad grumblex" if i % 2 else "fine words") for i in range(60)] + [(None, "grumblex")] + [("a-1", "other words")] * 5
    d = frame(spark, rows, "doc_id string, text string")
    labels = frame(spark, [(f"a-{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    out = toxicity.report(d, labels).collect()
    assert len(out) == len(rows) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(r["doc_id"].encode()) % 3 == 1) for r in out)


# --- 6: counts, weights, noise and the sample by definition


def plain_sample(texts, ids, target, keep):
    def buckets(text):
        found = [w.encode() for w in words_of(text)]
        h = [kernels.words(np.frombuffer(w, dtype=np.uint8))[3][0] for w in found]
        pairs = [kernels.rolling(np.array(p, dtype=np.uint64), 2)[0] for p in zip(h, h[1:], strict=False)]
        return [int(x & np.uint64(resample.BUCKETS - 1)) for x in [*h, *pairs]]

    held = [buckets(t) for t in texts]
    raw, good = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    for b, i in zip(held, ids, strict=True):
        for x in b:
            raw[x] += 1
            good[x] += i in target
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    copies, out = {}, []
    for t, b, i in zip(texts, held, ids, strict=True):
        h = hashlib.md5((t or "").encode()).hexdigest()
        k = copies[i, h] = copies.get((i, h), -1) + 1
        bits = int(hashlib.md5(f"{resample.SEED}|{'' if i is None else i}|{h}|{k}".encode()).hexdigest()[:13], 16)
        weight = sum(ratio[x] for x in b)
        out.append((weight - math.log(-math.log((bits + 0.5) / 2.0**52)), weight, i))
    out.sort(key=lambda x: -x[0])
    return out[: math.ceil(keep * len(out))]


def test_resampling_against_its_definition(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["Alpha", "beta", "é", "x1"]) for _ in range(r.randint(0, 12))) for _ in range(150)] + [None, "", "same", "same", "same", "same"]
    ids = [*range(150), 150, None, 7, 7, None, None]
    labels = frame(spark, [(i, int(i % 3 == 0)) for i in range(0, 150, 2)], "doc_id long, quality int")
    want = plain_sample(texts, ids, {i for i in range(0, 150, 2) if i % 3 == 0}, 0.6)
    got = resample.resample(docs(spark, texts, ids).repartition(3), labels, keep=0.6).collect()
    assert len(got) == len(want)
    for a, b in zip(sorted((x["noisy"], x["log_weight"], str(x["doc_id"])) for x in got), sorted((n, w, str(i)) for n, w, i in want), strict=True):
        assert abs(a[0] - b[0]) < 1e-6 and abs(a[1] - b[1]) < 1e-6 and a[2] == b[2]


def test_equal_rows_have_noise_of_their_own(spark):
    d = docs(spark, ["same text"] * 400, [5] * 400)
    kept = resample.resample(d, frame(spark, [(5, 1)], "doc_id long, quality int"), keep=0.5).collect()
    assert len(kept) == 200 and len({r["noisy"] for r in kept}) == 200


# --- 10: EM and the classifier row by row


def plain_classifier(cells):
    rows = [c for c, k in sorted(cells.items()) for _ in range(k)]
    prior, p = 0.5, {(i, v, y): {1: {"+": 0.6, "-": 0.1, "0": 0.3}, 0: {"+": 0.2, "-": 0.4, "0": 0.4}}[y][v] for i in range(4) for v in "+-0" for y in (0, 1)}

    def soft(c):
        yes, no = prior, 1 - prior
        for i in range(4):
            yes, no = yes * p[i, c[1 + i], 1], no * p[i, c[1 + i], 0]
        return yes / (yes + no)

    for _ in range(pii.ROUNDS):
        held = [soft(c) for c in rows]
        prior = (sum(held) + 1) / (len(rows) + 2)
        new = {}
        for i, v, y in p:
            mass = [(h if y else 1 - h) for h in held]
            new[i, v, y] = (sum(m for m, c in zip(mass, rows, strict=True) if c[1 + i] == v) + 1) / (sum(mass) + 3)
        p = new
    held, out = [soft(c) for c in rows], []
    for c in cells:
        yes, no = sum(held) + 1, sum(1 - h for h in held) + 1
        for at in (0, 3, 4, 5, 6):
            kinds = len({x[at] for x in rows})
            same = [h for h, x in zip(held, rows, strict=True) if x[at] == c[at]]
            yes *= (sum(same) + 1) / (sum(held) + kinds)
            no *= (sum(1 - h for h in same) + 1) / (sum(1 - h for h in held) + kinds)
        if abs(yes - no) > 1e-9 * yes:
            out.append((c, yes >= no))
    return out


def test_classifier_against_plain_version():
    r = random.Random(8)
    for _ in range(5):
        cells = {f"{r.randrange(8)}{r.choice('+0')}{r.choice('+-0')}{r.choice('+-0')}{r.choice('+-')}{r.randrange(3)}{r.randrange(3)}": r.randint(1, 9) for _ in range(60)}
        good = set(pii.classify(cells))
        assert all((c in good) == yes for c, yes in plain_classifier(cells))
    assert pii.classify({}) == []


def test_one_long_row_is_fast(spark):
    d = docs(spark, ["mail a@b.com, token=abcdef1234567890abc and 123-45-6789. " * 60])
    pii.report(d).collect()
    start = time.time()
    pii.report(d).collect()
    assert time.time() - start < 3


# --- 7: the lists are not always read to their ends


def test_topk_stops_early():
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, 32)) * 400
    x = np.floor(centres[r.integers(0, 40, 2000)] + r.standard_normal((2000, 32)) * 40)
    ids, q = np.arange(2000), x[::50]
    exact = x @ q.T
    exact[ids[:, None] == ids[::50][None]] = -np.inf
    floor = np.full(len(q), -np.inf)
    who, at, score, depth = topk.nra(x, ids, q, ids[::50], 5, floor)
    assert depth < 2000
    for j in range(len(q)):
        assert sorted(score[who == j]) == sorted(np.sort(exact[:, j])[-5:])
