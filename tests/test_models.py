"""The models that stand in for language models, against plain versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import fill, learned, lm, logistic, measures, metrics, packed, served, subword
from tidewake.sources import files

TEXTS = ["a b c a b d a b c e", "b c b c d e a c", "d a d b", "e c a b c", "f", "g f g"]


def docs_of(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "blob_id string, text string")


def plain_costs(texts):
    pairs = Counter(p for t in texts for p in itertools.pairwise(t.split()))
    firsts, v = Counter(), len({w for t in texts for w in t.split()})
    for (a, _), n in pairs.items():
        firsts[a] += n
    return {p: round(-fill.COST * math.log((n + 0.1) / (firsts[p[0]] + 0.1 * v))) for p, n in pairs.items()}


def test_lattice_equals_enumeration(spark):
    cost, words = plain_costs(TEXTS), "abcdefg"
    ends = [(a, b) for a in words for b in words]
    model = lm.NGramLM(docs_of(spark, TEXTS))
    got = {(r["a"], r["b"]): tuple(r["path"]) for r in fill.lattice(spark.createDataFrame(ends + ends[:3], "a string, b string"), model.bigrams, length=3).collect()}
    want = {}
    for a, b in ends:
        found = []
        for n in (1, 2, 3):
            paths = [p for p in itertools.product(words, repeat=n) if all(s in cost for s in itertools.pairwise((a, *p, b)))]
            if paths:
                total, path = min((sum(cost[s] for s in itertools.pairwise((a, *p, b))), p) for p in paths)
                found.append((total / (n + 1), n, path))
        if found:
            want[a, b] = min(found)[2]
    assert got == want and len(got) > 20
    assert fill.lattice(spark.createDataFrame([], "a string, b string"), model.bigrams).count() == 0


def test_nucleus_is_tempered_and_cut(spark):
    pairs = spark.createDataFrame([("x", "a", 8), ("x", "b", 8), ("x", "c", 4), ("x", "d", 1), ("y", "a", 3)], "prev string, token string, c2 long")
    unit = fill.WEIGHT
    rows = sorted(map(tuple, fill.nucleus(pairs, temperature=0.5, top_p=0.95).collect()))
    assert rows == [("x", "a", 0, unit, unit * 9 // 4), ("x", "b", unit, 2 * unit, unit * 9 // 4), ("x", "c", 2 * unit, unit * 9 // 4, unit * 9 // 4), ("y", "a", 0, unit, unit)]
    assert [r[1] for r in sorted(map(tuple, fill.nucleus(pairs, temperature=0.2, top_p=0.4).collect())) if r[0] == "x"] == ["a"]


def test_draws_have_the_frequencies_of_the_nucleus(spark):
    pairs = spark.createDataFrame([("x", "a", 3), ("x", "b", 2), ("x", "c", 1), ("a", "x", 1), ("b", "x", 1), ("c", "end", 1)], "prev string, token string, c2 long")
    table = lm.written(fill.nucleus(pairs, temperature=1.0, top_p=1.0), "t", bytes=fill._bytes("prev", "token"))
    n = 6000
    starts = spark.range(n).select(F.col("id").alias("_row"), F.col("id").alias("blob_id"), F.lit("x").alias("_here"))
    out = [r["output"].split() for r in fill.sampled(starts, table, 24, 42, ("blob_id",)).collect()]
    first = Counter(o[0] for o in out)
    for token, share in (("a", 1 / 2), ("b", 1 / 3), ("c", 1 / 6)):
        assert abs(first[token] - n * share) < 5 * math.sqrt(n * share * (1 - share))
    third = Counter(o[2] for o in out if len(o) > 2)
    assert abs(third["a"] - sum(third.values()) / 2) < 5 * math.sqrt(n) / 2
    follows = defaultdict(set)
    for o in out:
        for a, b in itertools.pairwise(o):
            follows[a].add(b)
    assert follows == {"a": {"x"}, "b": {"x"}, "x": {"a", "b", "c"}, "c": {"end"}} and max(map(len, out)) == 24
    assert sorted(map(str, out)) == sorted(str(r["output"].split()) for r in fill.sampled(starts.repartition(5), table, 24, 42, ("blob_id",)).collect())


def test_infill_reads_both_sides_and_falls_back(spark):
    model = lm.NGramLM(docs_of(spark, ["the red fox sat", "the blue fox ran", "the blue dog sat", "one two"]))
    rows = [(0, "see the", "fox again"), (1, "the", "dog"), (2, "see one", "nowhere"), (3, "nothing", "dog"), (4, "", "fox"), (5, "two", ""), (6, None, None), (7, "the", "fox x")]
    prompts = spark.createDataFrame([(i % 7, "strings", i, p, s) for i, p, s in rows], "blob_id int, level string, ord int, prefix string, suffix string")
    got = {r["ord"]: r["output"] for r in model.infill(prompts, 3).collect()}
    assert got == {0: "blue", 1: "blue", 2: "two", 3: "", 4: "", 5: "", 6: "", 7: "blue"}


def test_ranges_of_scores_are_even(spark):
    """One far score leaves the ranges even; counts over many ranges are those over one."""
    by = metrics.written(spark.range(200_000).select(F.when(F.col("id") == 7, 1e9).otherwise(F.pow(F.lit(1.0001), "id")).alias("score"), (F.col("id") % 3).alias("pos"), (F.col("id") % 2).alias("neg")), "t")
    sizes = [r["count"] for r in metrics.bands(by, 200_000, 10_000).groupBy("band").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 10_000 and sum(sizes) == 200_000
    few = by.filter("score < 1.3")
    few = metrics.written(few, "t")
    assert sorted(metrics._cumulated(few, size=100).collect()) == sorted(metrics._cumulated(few).collect())


def plain_kneser_ney(texts, d=0.75):
    three = Counter((u, v, w) for t in texts for u, v, w in zip(["", "", *t.split()], ["", *t.split()], t.split(), strict=False))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)

    def level(counts, history, token, lower):
        own = {k[-1]: n for k, n in counts.items() if k[:-1] == history}
        total = sum(own.values())
        return (max(own.get(token, 0) - d, 0) + d * len(own) * lower) / total if own else lower

    def p(u, v, w):
        total = sum(one.values())
        p1 = max(one.get(w, 0) - d, 0) / total + d * len(one) / total / (len(one) + 1)
        return level(three, (u, v), w, level(two, (v,), w, p1))

    return p, [*one, "unseen"]


def test_kneser_ney_sums_to_one_and_equals_the_definition(spark):
    p, words = plain_kneser_ney(TEXTS)
    histories = [("", ""), ("", "a"), ("a", "b"), ("b", "c"), ("zz", "b"), ("zz", "zz"), ("c", "zz")]
    model = measures.KneserNey(docs_of(spark, TEXTS))
    rows = model.logprobs(spark.createDataFrame([(*h, w) for h in histories for w in words], "u string, v string, w string")).collect()
    sums = defaultdict(float)
    for r in rows:
        assert abs(math.exp(r["lp"]) - p(r["u"], r["v"], r["w"])) < 1e-12
        sums[r["u"], r["v"]] += math.exp(r["lp"])
    assert len(sums) == len(histories) and all(abs(x - 1) < 1e-9 for x in sums.values())
    long = " ".join(["a b"] * 700)
    docs = spark.createDataFrame([("0", "a b c"), ("1", ""), ("2", None), ("3", "one"), ("4", long), ("5", "  ")], "blob_id string, text string")
    got = {r["blob_id"]: r["ppl"] for r in model.perplexity(docs).collect()}
    assert abs(math.log(got["0"]) + (math.log(p("", "a", "b")) + math.log(p("a", "b", "c"))) / 2) < 1e-9
    assert (got["1"], got["2"], got["3"], got["5"]) == (100.0, 100.0, 1e6, 1e6)
    tail = long.split()[-1024:]
    lps = [math.log(p(tail[i - 2] if i > 1 else "", tail[i - 1], tail[i])) for i in range(1, 1024)]
    assert abs(math.log(got["4"]) + sum(lps) / 1023) < 1e-9
    assert {r["ppl"] for r in measures.KneserNey(docs.filter("false")).perplexity(docs.filter("blob_id = 0")).collect()} == {1.0}


def test_word_vectors_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    matrix, vocab = measures.cooccurrences(docs, 600)
    dense = np.zeros((len(vocab),) * 2)
    for r in matrix.collect():
        dense[r["i"], r["j"]] = r["x"]
    assert (dense == dense.T).all() or np.abs(dense - dense.T).max() < 1e-12
    value, vector = measures.decompose(matrix, len(vocab), 16)
    want = np.linalg.svd(dense, compute_uv=False)[:16]
    assert np.abs(value / want - 1).max() < 0.01
    counts, at = Counter(), {w: i for i, w in enumerate(vocab)}
    for (text,) in docs.select("text").collect():
        t = [w.lower() for w in lm._TOKENS.findall(text or "")]
        for d in (1, 2):
            for a, b in zip(t, t[d:], strict=False):
                if a in at and b in at:
                    counts[at[a], at[b]] += 1
                    counts[at[b], at[a]] += 1
    rows = Counter()
    for (i, _), n in counts.items():
        rows[i] += n
    total = sum(rows.values())
    (i, j), n = counts.most_common(40)[-1]
    assert abs(dense[i, j] - max(0, math.log(n * total / rows[i] / rows[j]))) < 1e-9
    vectors = measures.WordVectors(docs, rank=8, terms=600)
    one, two, none, both = (np.array(r["e"]) for r in spark.createDataFrame([(vocab[5],), (vocab[9].upper(),), ("q0q0",), (f"{vocab[5]} q0q0 {vocab[9]}",)], "t string").coalesce(1).select(vectors.embed(F.col("t")).alias("e")).collect())
    assert np.allclose(both, (one + two) / 2, atol=1e-5) and not none.any() and one.any()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_subwords_round_trip_and_cut(spark, name):
    own = subword.Subword(f"/opt/tokenizers/{name}")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(2)
    rows = docs.select("text", own.ids(F.col("text")).alias("ids")).select("text", "ids", own.text(F.col("ids")).alias("back"), own.count(F.col("text")).alias("n"), own.truncate(F.col("text"), 20).alias("head"), own.truncate(F.col("text"), 20, keep_end=True).alias("tail")).collect()
    exact = not name.startswith("piece")  # which writes runs of blanks as one
    coder = subword._coder(own.path)
    for r in rows:
        assert r["back"] == r["text"] if exact else r["back"].split() == r["text"].split()
        assert r["n"] == len(r["ids"]) and list(r["ids"]) == coder.encode(r["text"])
        if r["n"] <= 20:
            assert r["head"] == r["tail"] == r["text"]
        else:
            assert (r["head"], r["tail"]) == (coder.decode(list(r["ids"][:20])), coder.decode(list(r["ids"][-20:])))
    (none,) = spark.range(1).select(own.ids(F.lit(None).cast("string")).alias("a"), own.truncate(F.lit(None).cast("string"), 3).alias("b"), own.text(F.array().cast("array<int>")).alias("c")).collect()
    assert (list(none["a"]), none["b"], none["c"]) == ([], None, "")


def test_two_vocabulary_files_agree_and_special_strings_are_text(spark):
    texts = ["The quick<|endoftext|> fox's  1234 caf\u00e9\n\n end", "def f(x):\n    return x  # ok"]
    a, b = (subword._coder(f"/opt/tokenizers/byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    for t in texts:
        assert a.encode(t) == b.encode(t) and 50256 not in a.encode(t)
    assert a.decode([*a.encode("x"), 50256]) == "x"
    with pytest.raises(ValueError):
        subword._coder("/opt/tokenizers/README.md")


def test_a_model_of_subwords(spark):
    own = subword.Subword("/opt/tokenizers/byte_bpe_50k.json")
    docs = docs_of(spark, ["print(value) and print(other)", "print(value) or none"])
    model = lm.NGramLM(docs, cut=own.tokens, joined=own.joined)
    plain = lm.NGramLM(docs)
    counts = [m.token_logprobs(docs).count() for m in (model, plain)]
    assert counts[0] > counts[1] and counts[0] == sum(len(subword._coder(own.path).encode(r["text"])) - 1 for r in docs.collect())
    (out,) = model.generate(spark.createDataFrame([("0", "x print")], "blob_id string, text string"), 3).collect()
    assert out["output"] == "(value)"
    (gap,) = model.infill(spark.createDataFrame([("0", "strings", 0, "print(", ") and")], "blob_id string, level string, ord int, prefix string, suffix string"), 4).collect()
    assert gap["output"] == "value"


def test_lookups_beyond_the_broadcast_are_the_same(spark):
    docs = docs_of(spark, TEXTS)
    want = sorted(map(tuple, lm.NGramLM(docs).token_logprobs(docs, outer=True).collect()), key=repr)
    for hot in (0, 1, 3):
        assert sorted(map(tuple, lm.NGramLM(docs, hot=hot).token_logprobs(docs, outer=True).collect()), key=repr) == want


def test_sub_words_are_cut_once(spark):
    """A text is encoded once for its number of tokens, its head and its tail, and once for what a filter leaves of its tokens."""
    own, text = subword.Subword("/opt/tokenizers/byte_bpe_50k.json"), F.col("text")
    docs = docs_of(spark, ["one two three four five six", "", None, "caf\u00e9 au lait"])
    evals = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in line]
    got = docs.select("blob_id", own.summary(text, 3, 2).alias("x")).select("blob_id", "x.*")
    want = docs.select("blob_id", own.count(text).alias("tokens"), own.truncate(text, 3).alias("head"), own.truncate(text, 2, keep_end=True).alias("tail"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    for df, use in ((got, "summed("), (lm.positions(docs, cut=own.tokens), "encode(")):
        assert len(evals(df)) == 1 and evals(df)[0].count(use) == 1


def test_a_fit_is_one_job(spark):
    """Logistic regression takes as many sums as steps, not as many jobs; parts without rows take part too."""
    rows = spark.createDataFrame([(float(i % 2), [0, 1 + i % 2], [0.6, 0.8]) for i in range(40)] + [(1.0, None, None)], "label double, idx array<int>, w array<double>")
    spark.sparkContext.setJobGroup("logistic-fit", "a fit")
    theta = logistic.fit(rows, 3, workers=3)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("logistic-fit")
    spark.sparkContext._jsc.clearJobGroup()
    assert len(theta) == 4 and theta[2] > 1 > -1 > theta[1] and len(jobs) <= 3
    assert np.allclose(theta, logistic.fit(rows, 3, workers=1), atol=1e-3)


def test_fetching_asks_again_without_end_and_goes_on(spark, tmp_path):
    """A blob is busy ten times, then there, over three runs on one folder; what was answered is not asked again."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def get(blob):
        with open(asked / blob, "a+") as log:
            log.write("x")
            log.flush()
            n = log.tell()
        if blob == "err":
            raise ValueError("no such host")
        return (429, b"") if blob == "busy" and n <= 10 else (200, f"é {blob}".encode("latin-1")) if blob != "gone" else (404, b"")

    rows = spark.createDataFrame([("busy", "latin-1", 1), ("ok", "latin-1", 2), ("gone", None, 3), ("err", "utf-8", 4), (None, None, 5), ("", None, 6)], "blob_id string, src_encoding string, n int")
    folder = str(tmp_path / "state")
    first = {r["n"]: r for r in files.fetch_content(rows, get, folder, wait=0.0, rounds=3).collect()}
    assert (first[1]["content"], first[1]["status_code"], first[2]["content"]) == (None, None, "é ok")
    files.fetch_content(rows, get, folder, wait=0.0, rounds=4)
    last = {r["n"]: (r["content"], r["status_code"]) for r in files.fetch_content(rows, get, folder, wait=0.0).collect()}
    assert last == {1: ("é busy", None), 2: ("é ok", None), 3: (None, "HTTP 404"), 4: (None, "no such host"), 5: (None, None), 6: (None, None)}
    assert {p.name: len(p.read_text()) for p in asked.iterdir()} == {"busy": 11, "ok": 1, "gone": 1, "err": 1}
    assert {r["n"] for r in files.fetch_ok(files.fetch_content(rows, get, folder)).collect()} == {1, 2}


def test_a_model_that_needs_a_resource_says_so_early(spark, monkeypatch):
    docs = docs_of(spark, ["a b"])
    with pytest.raises(RuntimeError, match="spark.executor.resource.gpu.amount is not set"):
        served.ServedModel(object, resources={"gpu": 1}).token_logprobs(docs)
    spark.conf.set("spark.executor.resource.gpu.amount", "2")
    try:
        profile = served._profile(spark, {"gpu": 0.5})
        assert profile.taskResources["gpu"].amount == 0.5 and profile.executorResources["gpu"].amount == 2
        given = []
        monkeypatch.setattr(type(docs), "mapInPandas", lambda self, func, schema, barrier=False, profile=None: given.append(profile))
        served.ServedModel(object, resources={"gpu": 0.5}).generate(docs)
        assert given[0].taskResources["gpu"].amount == 0.5
    finally:
        spark.conf.unset("spark.executor.resource.gpu.amount")
    assert served._profile(spark, {}) is None


def test_bag_of_words_finds_a_planted_signal(spark):
    """Members hold one of forty rare words more often than others do: held-out members rank above others."""
    rng = random.Random(11)
    common, rare = [f"word{i}" for i in range(300)], [f"rare{i}" for i in range(40)]

    def text(member):
        return " ".join(rng.choices(common, k=40) + rng.choices(rare, k=3 if member else 0) + rng.choices(common, k=10))

    rows = [(text(i % 2), str(i), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, blob_id string, label int")
    bow = learned.BagOfWords().fit(docs.filter("blob_id < '7'"))
    held = docs.filter("blob_id >= '7'")
    auc = metrics.metrics(bow.score(held)).filter("metric = 'roc auc'").first()["value"]
    assert auc > 0.85
    top = bow.top_features(20).filter("side = 'member'").collect()
    assert sum("rare" in r["term"] for r in top) >= 15


def test_perceptron_is_the_same_on_any_number_of_workers(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((230, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), "fit" if i < 180 else "val") for i in range(230)]
    frame = lm.written(spark.createDataFrame(rows, "id long, features array<double>, label int, split string"), "t")
    mean, std = x[:180].mean(0), x[:180].std(0)
    z = (x - mean) / std
    plain = learned.Mlp(hidden=24, epochs=6).fit(z[:180], y[:180], (z[180:], y[180:]))
    for workers in (1, 3):
        net = learned.Mlp(hidden=24, epochs=6).fit_rows(frame, mean, std, workers)
        assert max(np.abs(a - b).max() for a, b in zip([*net.w, *net.b], [*plain.w, *plain.b], strict=True)) < 1e-6
        assert np.allclose(net.history, plain.history, atol=1e-6) and len(net.history) == 6
    assert plain.history[-1][0] < plain.history[0][0]


def test_perplexities_shuffle_no_tokens(spark, monkeypatch):
    """Texts go to blocks, which ask parts of the values; many blocks and parts give what one does."""
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(40))) for _ in range(30)] + ["", None, "one", "a"]
    model, docs = measures.KneserNey(docs_of(spark, TEXTS)), docs_of(spark, texts)
    want = {x["blob_id"]: x["ppl"] for x in model.perplexity(docs).collect()}
    for name, size in (("VALUE_BLOCK", 4), ("VALUE_PART", 50), ("HELD", 7)):
        monkeypatch.setattr(packed, name, size)
    found = model.perplexity(docs)
    assert not re.search(r"hashpartitioning\([^)]*\b[uvw]#", found._jdf.queryExecution().executedPlan().toString())
    got = {x["blob_id"]: x["ppl"] for x in found.collect()}
    assert got.keys() == want.keys() and len(got) == 34 and all(abs(math.log(got[k] / want[k])) < 1e-9 for k in got)


def test_perceptron_of_few_rows_a_step_is_trained_by_one_task(spark):
    """Which gives the network that several give when they add up their gradients."""
    r = np.random.default_rng(2)
    x = r.standard_normal((120, 5))
    y = (x[:, 0] > 0).astype(int)
    frame = lm.written(spark.createDataFrame([(i, x[i].tolist(), int(y[i]), "fit") for i in range(120)], "id long, features array<double>, label int, split string"), "t")
    alone, several = (learned.Mlp(hidden=16, epochs=3, alone=n).fit_rows(frame, np.zeros(5), np.ones(5), 3) for n in (64, 0))
    assert max(np.abs(a - b).max() for a, b in zip([*alone.w, *alone.b], [*several.w, *several.b], strict=True)) < 1e-9


def test_equal_outputs_are_measured_once(spark):
    asked = []

    class Sizes:
        def embed(self, text):
            return F.array(F.length(text).cast("double"), F.lit(1.0))

        def perplexity(self, docs, keys):
            asked.append(docs.count())
            return docs.select(*keys, (F.length("text") + 1.0).alias("ppl"))

    docs = spark.createDataFrame([(f"value{i} = name{i} + 1\nprint(value{i})\n" * 3, str(i), i % 2) for i in range(12)], "text string, blob_id string, label int")
    rows = learned.stability_features(lm.NGramLM(docs), Sizes(), docs).collect()
    assert len(rows) == 12 and all(len(r["features"]) == 27 for r in rows) and asked[0] < 12 * 12
