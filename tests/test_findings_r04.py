"""What the findings of round 4 showed."""

import collections
import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tidewake.operators import bag, elements, fill, learned, lm, logistic, packed, perturb, scores


def test_variants_equal_the_columns(spark, monkeypatch):
    """the variants of a text are made at once, in Arrow batches, as the columns make them one by one."""
    monkeypatch.setattr(perturb, "BATCH", 100)
    odd = [
        "", "\n", "a\r\nb\x0bc\x0cd\x1ce\x1ff\x85g h i", "def f(a):\n\treturn a\n", "\x1fdef g(x):\n y = x\n", "  def h():\n  pass", "def if():\n def IF():\ndef Up():\n",
        "été = naïve_1\nx²=1\n_a b1 B2", "def\nName()\ndef ok()", "if:\n for:\n", "é áb 一x", "9 99 999\n" * 30, "x", ":\n:", None,
    ]
    odd += [f"def f{i}(v):\n    w{i} = v # {i}\n\n    print(w{i}, 'def f{i}')\nclass K{i}:\n  pass" for i in range(40)]
    docs = spark.createDataFrame([(str(i) if i % 7 else None, t) for i, t in enumerate(odd)], "blob_id string, text string").withColumn("at", F.monotonically_increasing_id())
    columns = F.array("text", *[f(F.col("text")) for f in perturb.VARIANTS.values()])
    want = {(r["at"], r["variant"]): r["code"] for r in docs.select("at", F.posexplode(columns).alias("variant", "code")).collect()}
    assert {(r["at"], r["variant"]): r["code"] for r in perturb.variants(docs, "text").collect()} == want
    cut = {(r["at"], r["variant"]): r["code"] for r in perturb.variants(docs, "text", last=2).collect()}
    assert cut == {k: None if x is None else " ".join(perturb._TOKENS.findall(x)[-2:]) for k, x in want.items()}


def test_every_successor_counts_in_the_lattice(spark):
    """no end, successor or length is cut, from whichever side the search goes on; ties as before."""
    r = random.Random(6)
    names = [f"t{i:02d}" for i in range(70)]
    cost = {(x, y): r.randrange(1, 4) for x in names for y in r.sample(names, 40)} | {("only", f"s{i:02d}"): 1 for i in range(40)} | {("only", "rare"): 3, ("rare", "end"): 3}
    pairs = spark.createDataFrame([(x, y, -c / fill.COST) for (x, y), c in cost.items()], "prev string, token string, seen double")

    def best(a, b, length):
        front, found = {a: (0, ())}, []
        for n in range(1, length + 1):
            grown = {}
            for (x, y), c in cost.items():
                if x in front:
                    grown[y] = min(grown.get(y, (10**9,)), (front[x][0] + c, (*front[x][1], y)))
            front = grown
            found += [((front[x][0] + c) / (n + 1), n, front[x][1]) for (x, y), c in cost.items() if y == b and x in front]
        return min(found)[2] if found else None

    for ends in ([("only", "end"), ("only", "s01"), ("end", "only"), (names[0], names[1]), (names[0], names[2]), (names[0], names[3])], [(x, names[5]) for x in names[:6]] + [("only", "end"), ("s01", "t01")]):
        got = {(x["a"], x["b"]): tuple(x["path"]) for x in fill.lattice(spark.createDataFrame(ends + ends[:2], "a string, b string"), pairs, length=3).collect()}
        assert got == {k: p for k in ends if (p := best(*k, 3))} and got[("only", "end")] == ("rare",)


def test_bag_of_words_shuffles_no_terms(spark, monkeypatch):
    """the vocabulary is exact with few buckets and blocks, ids may repeat, and texts are weighed where they are."""
    monkeypatch.setattr(bag, "BLOCK", 50)
    monkeypatch.setattr(learned, "TERMS", 60)
    r = random.Random(2)
    words = ["aa", "bb", "Éa", "cc1", "x"] + [f"w{i}" for i in range(60)]
    rows = [(r.choice(["k1", "k2", "k3"]) if i % 9 == 0 else f"i{i}", i % 2, " ".join(r.choice(words[: 5 + 60 * (i % 2)]) for _ in range(r.randrange(1, 30)))) for i in range(60)] + [("none", 1, ""), ("null", 0, None)]
    docs = spark.createDataFrame(rows, "blob_id string, label int, text string").repartition(4)
    bow = learned.BagOfWords().fit(docs)
    counts = learned.ngram_counts(docs)
    want = learned.vocabulary(counts, 60)
    assert sorted(map(tuple, bow.vocab.collect())) == sorted(map(tuple, want.select("term", "cf", "df", "idx").collect()))
    z, coef = collections.defaultdict(float), bow.coefficients
    for x in learned.tfidf(counts, want, 62).collect():
        z[x["blob_id"]] += x["w"] * coef[x["idx"]]
    got = bow.score(docs).collect()
    assert sorted((x["blob_id"], x["label"]) for x in got) == sorted((i, y) for i, y, _ in rows)
    assert all(abs(x["score"] - 1 / (1 + math.exp(-z[x["blob_id"]] - bow.intercept))) < 1e-9 for x in got)
    theta = logistic.fit(logistic.sparse_rows(docs, learned.tfidf(counts, want, 62)), 60, workers=2)
    assert np.allclose(theta, [*coef, bow.intercept], atol=1e-3)
    once = docs.filter("blob_id like 'i%'")
    plan = bow.score(once)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= docs._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_swapped_texts_do_not_move(spark, monkeypatch):
    """texts are swapped in their blocks, as hashes, with the scores that the swapped texts themselves have."""
    for name, size in (("BLOCK", 40), ("PART", 200), ("SLICE", 1 << 8), ("FILTER", 1 << 10)):
        monkeypatch.setattr(packed, name, size)
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(60))) for _ in range(40)] + ["", "one", "a  b\tc d"]
    docs = spark.createDataFrame([(r.choice([None, "k"]) if i % 11 == 0 else f"i{i}", i % 2, t) for i, t in enumerate(texts)], "blob_id string, label int, text string")
    known = docs.filter("label = 1")
    found, moved = (scores.swap_attack(lm.NGramLM(known, hot=h, cut=cut), docs) for h, cut in ((5, lm.tokenize), (10**6, lambda c: lm.tokenize(c))))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, moved.collect())) and found.count() == len(texts)
    plans = ["ArrowEvalPython" in x._jdf.queryExecution().executedPlan().toString() for x in (found, moved)]
    assert plans == [False, True]


def test_texts_without_a_mark_are_not_searched(spark):
    """a text that cannot have an element is not searched for it, which took the square of its length."""
    docs = spark.createDataFrame([("a: " * 60_000,), ("b = 1",), ("",), (None,)], "text string")
    start = time.time()
    got = docs.select(F.transform(elements.elements_of("variable_names", F.col("text")), lambda e: e["value"]).alias("v")).collect()
    assert [r["v"] for r in got] == [[], ["b"], [], []] and time.time() - start < 30
