"""Operators of the engine: elements, perturbations, strings, samples, metrics, sources, attacks."""

import hashlib
import keyword
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.operators import data, elements, learned, lm, metrics, perturb, registry, report, scores, served
from tidewake.plans import code as code_queries
from tidewake.sources import files
from tidewake.streaming.acquire import acquire

PYTHON = {
    "docstrings": (r"""("{3}|'{3})([\s\S]*?)\1""", 2), "comments": (r"\s*#(.*)", 1), "function_names": (r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([\s\S]*?)\)", 1),
    "class_names": (r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:\(([\s\S]*?)\))?", 1), "variable_names": (r"([a-zA-Z_][a-zA-Z0-9_]*)(?:\s*:\s*[^=]*?)?\s*=", 1), "strings": (r"""(["'])(.+?)\1""", 2),
}
CODES = [c for _, c in code_queries.CODE] + [
    '"""a"""\n\'\'\'b\'\'\'\nx = """"""\n', "x = 1 # note # twice\n#\n", "émoji = 1\n# é ü 漢\nclass É: pass\n", "subclass Foo(\n)", "if x:\n y = 1\nelse:\n z = 2\n",
    "a == b; c <= d; e += 1; f(k=1)", "x\u00a0= 1\r# one\u2028still\n", "t: dict[str, int] = {}\nu=v='s'\n", "def __init__(self,\n  a, b): return '#no'", "x = 1\n" * 300, "a\x01b = 1 # c\x02d\n'\x01' = \x02\ne = 2\n",
]


def frame(spark, codes):
    return spark.createDataFrame(list(enumerate(codes)), "i long, text string").select(F.col("i").cast("string").alias("blob_id"), "text")


@pytest.mark.parametrize("level", list(elements.LEVELS))
def test_elements_equal_python(spark, level):
    pattern, group = PYTHON[level]
    for r in frame(spark, CODES).select("blob_id", "text", elements.elements_of(level, F.col("text")).alias("e")).collect():
        want = [(m[group], m.start(group), m.end(group)) for m in re.finditer(pattern, r["text"])]
        assert [(e["value"], e["start"], e["end"]) for e in r["e"]] == want
        assert all(r["text"][e["start"] : e["end"]] == e["value"] for e in r["e"])
        if level in ("docstrings", "strings"):
            assert [e["quote_char"] for e in r["e"]] == [m[1] for m in re.finditer(pattern, r["text"])]


def test_elements_map_and_null(spark):
    df = spark.createDataFrame([("a", ""), ("b", None)], "blob_id string, text string")
    for r in df.select(elements.elements_map("text").alias("m")).collect():
        assert set(r["m"]) == set(elements.LEVELS) and not any(r["m"].values())


def test_cap_and_short(spark):
    rows = frame(spark, ["ab = 1\n" * 50 + "x = 2\n"])
    capped = elements.cap(rows, "variable_names").collect()
    assert len(capped) == 20 and len({r["ord"] for r in capped}) == 20
    found = elements.extract(rows).filter("level = 'variable_names'")
    assert found.filter(elements.long_enough()).count() == 50
    chosen = {(r["ord"], r["value"]) for r in elements.infills(rows).filter("level = 'variable_names'").collect()}
    assert chosen == {(r["ord"], r["value"]) for r in capped if len(r["value"]) > 1}


def test_prompt_context(spark):
    text = "p" * 4000 + "NAME" + "s" * 4000
    e = spark.createDataFrame([("0", text, 4000, 4004), ("0", text, 10, 12)], "blob_id string, text string, start int, end int")
    rows = {r["start"]: r for r in elements.prompts(e).collect()}
    assert rows[4000]["prefix"] == "p" * 3000 and rows[4000]["suffix"] == "s" * 3000 and rows[4000]["prompt"].startswith("<fim_prefix>")
    assert rows[10]["prompt"].startswith("<file_sep><fim_prefix>" + "p" * 10 + "<fim_suffix>")
    (r,) = elements.infills(frame(spark, ["x" * 10 + "\nname = 1\n"])).collect()
    assert r["prompt"] == "<file_sep><fim_prefix>" + "x" * 10 + "\n<fim_suffix> = 1\n<fim_middle>" and r["value"] == "name"


def test_python_strings(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(" \t\n\r\x0b\x0c\x1c\x1f\x85\u2028\u00a0aé") for _ in range(r.randint(0, 12))) for _ in range(300)]
    for x in frame(spark, texts).select("text", tx.py_strip("text").alias("s"), tx.py_splitlines("text").alias("l")).collect():
        assert x["s"] == x["text"].strip()
        assert x["l"] == x["text"].splitlines()


def test_fuzz_ratio(spark):
    r = random.Random(2)
    pairs = [("".join(r.choice("abc ") for _ in range(r.randint(0, 9))), "".join(r.choice("abc ") for _ in range(r.randint(0, 9)))) for _ in range(80)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not b else (lambda old: [0, *_next(old, x, b)])(row)
        return row[-1]

    def _next(old, x, b):
        now = [0]
        for j, y in enumerate(b):
            now.append(old[j] + 1 if x == y else max(old[j + 1], now[-1]))
        return now[1:]

    for x in spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.fuzz_ratio("a", "b").alias("f")).collect():
        a, b = x["a"].strip(), x["b"].strip()
        want = 100 if not a and not b else math.floor(200 * lcs(a, b) / (len(a) + len(b)) + 0.5)
        assert x["f"] == want


def draw(purpose, blob, n):
    return int(hashlib.md5(f"42|{purpose}|{blob}".encode()).hexdigest()[:8], 16) % max(n, 1)


def plain_variants(code, blob):
    """The eleven variants by their definitions, with the same draws."""
    lines = code.splitlines()
    pick = lambda options, purpose: options[draw(purpose, blob, len(options))] if options else None
    put = lambda at, *new: "\n".join([*lines[:at], *new, *lines[at:]])
    anywhere = lambda purpose: draw(purpose, blob, len(lines) + 1)
    names = sorted({t for t in re.findall(r"\b[_a-zA-Z][_a-zA-Z0-9]*\b", code) if re.match("[_a-z]", t) and not keyword.iskeyword(t)})
    methods = [m for m in re.findall(r"(?m)^\s*def\s+((?!^[A-Z])[_a-zA-Z][_a-zA-Z0-9]*)", code) if not keyword.iskeyword(m)]
    chars = string.ascii_letters + string.digits + string.punctuation

    def constant(purpose):
        h = hashlib.md5(f"42|{purpose}-word|{blob}".encode()).hexdigest()
        word = "'" + "".join(chars[int(h[2 * i : 2 * i + 2], 16) % len(chars)] for i in range(12)) + "'"
        return word if draw(purpose + "-kind", blob, 2) else str(draw(purpose, blob, 10000))

    number = lambda purpose: str(1000 + draw(purpose, blob, 9000))
    line_of = lambda name: next((i for i, x in enumerate(lines) if re.search(rf"\b{re.escape(name)}\b", x)), None)

    def loop(purpose):
        x, y = sorted((draw(purpose + e, blob, 10000) for e in "xy"), reverse=True)
        return f"for _ in range({x}, {y}):"

    def after(name, message):
        at = line_of(name)
        indent = "" if at is None else re.match(r"\s*", lines[at])[0]
        out = list(lines)
        out.insert((at or 0) + 1, indent + message)
        return "\n".join(out)

    bodies = ['    print("Debug: Entering loop")', "    pass"]
    conditions = ['if "key" != "key":', "if False:"]
    value = pick(names, "p3") or constant("p3k")
    at, new = line_of(value), f"unused_{number('p3n')} = {value}"
    renamed = lambda name, to: code if name is None else re.sub(rf"\b{name}\b", to, code)
    entered, shown = pick(methods, "p7") or "foo", pick(names, "p8") or "x"
    return [
        put(anywhere("p1"), pick(conditions, "p1c"), pick(["    void_array = [''] * 50", "    void_array[10] = 'A'"], "p1b")),
        put(anywhere("p2"), pick(conditions, "p2c"), "    " + (pick([x.strip() for x in lines if x.strip() and not x.strip().endswith(":")], "p2b") or "pass")),
        "\n".join([*lines, new, *lines]) if at is None else put(at, new),
        put(anywhere("p4"), f"unused_{number('p4n')} = {constant('p4k')}"),
        renamed(pick(names, "p5"), "var_" + number("p5n")), renamed(pick(methods, "p6"), "method_" + number("p6n")),
        after(entered, f'print("Debug: Entering method {entered}()")'),
        after(shown, f'print("Debug: Variable {shown} = ", {shown})') if lines else code,
        put(anywhere("p9"), loop("p9"), pick(bodies, "p9b")),
        put(anywhere("p10"), pick(["while False:", 'while "key" != "key":'], "p10c"), pick(bodies, "p10b")),
        put(anywhere("p11"), loop("p11"), f"unused_{number('p11n')} = {constant('p11k')}"),
    ]


def test_perturbations(spark):
    codes = [*CODES, "def Run(a):\n\treturn a\n", "A = B\nC = 1", "12 == 12\n", "   \n\n", "def\nFoo(): pass", "def é(): x\u00e9 = x\n"]
    rows = frame(spark, [c for c in codes for _ in range(4)])
    for r in perturb.variants(rows, "text").collect():
        want = [r["text"], *plain_variants(r["text"], r["blob_id"])][r["variant"]]
        assert r["code"] == want, (r["variant"], r["text"])
    assert perturb.variants(rows.limit(3).repartition(2), "text").count() == 36
    nulls = spark.createDataFrame([("1", None)], "blob_id string, text string")
    assert {r["code"] for r in perturb.variants(nulls, "text").collect()} == {None}


def sample_frame(spark, members=70, others=31):
    rows = [(f"text {i % 40}", str(i % 90), int(i < members)) for i in range(members + others)]
    return spark.createDataFrame(rows, "text string, blob_id string, label int")


def test_samples_and_splits(spark):
    df = sample_frame(spark)
    picked = {r["label"]: r["count"] for r in data.sample_exact(df, 0.29).groupBy("label").count().collect()}
    assert picked == {1: int(70 * 0.29), 0: int(31 * 0.29)}
    assert data.sample_exact(df, 0.001).count() == 2 and data.sample_exact(df, 1.0).count() == 101
    counts = {(r["label"], r["split"]): r["count"] for r in data.stratified_split(df).groupBy("label", "split").count().collect()}
    assert counts[1, "train"] + counts[0, "train"] == 80 and counts[1, "train"] in (55, 56) and sum(counts.values()) == 101
    one = sorted(map(tuple, data.stratified_split(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, data.stratified_split(df.repartition(7)).collect()))
    val = {r["split"]: r["count"] for r in data.val_split(df).groupBy("split").count().collect()}
    assert val == {"fit": 50, "val": 51}
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            data.sample_exact(df, bad)
    with pytest.raises(ValueError):
        data.stratified_split(df, 1.0)


def test_sample_frame_ids(spark):
    df = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None), (" \n", "y"), (None, "z")], "content string, blob_id string")
    assert sorted(r["blob_id"] for r in data.samples(df, 1).collect()) == sorted(["x", "e9d71f5ee7c92d6dc9e92ffdad17b8bd49418f98", "84a516841ba77a5b4648de2cd0dfcb30ea46dbb4"])
    numbers = spark.createDataFrame([("a", 0), ("b", 5)], "content string, blob_id int")
    assert sorted(r["blob_id"] for r in data.samples(numbers, 0).collect()) == ["5", "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"]


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_metrics(spark):
    r = random.Random(5)
    rows = [(round(r.gauss(y * 0.5, 1), 1), y) for y in (0, 1) * 150]
    got = {x["metric"]: x["value"] for x in metrics.metrics(spark.createDataFrame(rows, "score double, label int")).collect()}
    assert list(got) == list(metrics.NAMES) and abs(got["roc auc"] - auc(rows)) < 1e-12
    curve = sorted((x["fpr"], x["tpr"]) for x in metrics.roc_curve(spark.createDataFrame(rows, "score double, label int")).collect())
    fpr, tpr = map(np.array, zip(*curve, strict=True))
    for x, name in zip(metrics.RATES, metrics.NAMES[1:], strict=True):
        assert abs(got[name] - np.interp(x, fpr, tpr)) < 1e-12
    turned = {x["metric"]: x["value"] for x in metrics.metrics(spark.createDataFrame([(-s, y) for s, y in rows], "score double, label int")).collect()}
    assert abs(turned["roc auc"] + got["roc auc"] - 1) < 1e-12
    for bad in ([(float("nan"), 1), *rows], [(None, 0), *rows], [x for x in rows if x[1]]):
        assert [x["value"] for x in metrics.metrics(spark.createDataFrame(bad, "score double, label int")).collect()] == [None] * 3


def test_model_scores(spark):
    docs = spark.createDataFrame([("1", "a b a b c", 1), ("2", "a", 0), ("3", "x y z", 0), ("4", "", 0)], "blob_id string, text string, label int")
    model = lm.NGramLM(docs.filter("label = 1"))
    got = {r["blob_id"]: r["score"] for r in scores.loss_attack(model, docs).collect()}
    lp = lambda c2, c1: math.log((c2 + 0.1) / (c1 + 0.1 * 3))
    assert abs(got["1"] - (2 * lp(2, 2) + lp(1, 2) + lp(1, 2)) / 4) < 1e-9
    assert got["2"] is None and got["4"] is None and abs(got["3"] - math.log(0.1 / 0.3)) < 1e-9
    low = {r["blob_id"]: r["score"] for r in scores.min_k_attack(model, docs).collect()}
    assert abs(low["1"] - lp(1, 2)) < 1e-9
    assert {r["blob_id"]: r["output"] for r in model.generate(docs, 4).collect()}["2"] == "b a b a"
    assert {r["blob_id"]: r["output"] for r in model.generate(docs, 2, broadcast_rows=0).collect()}["2"] == "b a"
    ppl = {r["blob_id"]: r["ppl"] for r in lm.perplexity(model, docs).collect()}
    assert ppl["4"] == 100.0 and ppl["2"] == 1e6 and abs(ppl["1"] - math.exp(-got["1"])) < 1e-9
    with pytest.raises(RuntimeError):
        lm.require_model(object())
    for hot in (1, 2):
        part = lm.NGramLM(docs.filter("label = 1"), hot=hot)
        assert {(r["blob_id"], r["pos"], r["token"], round(r["lp"], 9)) for r in part.token_logprobs(docs).collect()} == {(r["blob_id"], r["pos"], r["token"], round(r["lp"], 9)) for r in model.token_logprobs(docs).collect()}
    empty = lm.NGramLM(docs.filter("false"))
    assert [r["score"] for r in scores.loss_attack(empty, docs).collect()] == [None] * 4


def test_greedy_paths(spark):
    r = random.Random(3)
    text = " ".join(r.choice("abcdefgh") for _ in range(200)) + " end"
    model = lm.NGramLM(spark.createDataFrame([("1", text)], "blob_id string, text string"))
    words = text.split()
    counts = {}
    for a, b in zip(words, words[1:], strict=False):
        counts.setdefault(a, {}).setdefault(b, 0)
        counts[a][b] += 1
    best = {a: min(v, key=lambda b: (-v[b], b)) for a, v in counts.items()}
    for n in (1, 5, 50):
        out = {x["text"]: x["output"] for x in model.generate(spark.createDataFrame([(c,) for c in [*"abcdefgh", "end", "none", "", " "]], "text string"), n).collect()}
        for start, got in out.items():
            want, at = [], start
            while len(want) < n and at in best:
                at = best[at]
                want.append(at)
            assert got == " ".join(want)


def test_repeated_ids_are_scored_by_row(spark):
    docs = spark.createDataFrame([("1", "a b a b c", 1), ("1", "x y", 1), ("2", "a", 0)], "blob_id string, text string, label int")
    model = lm.NGramLM(docs)
    for attack in (scores.loss_attack, scores.min_k_attack, scores.swap_attack):
        rows = attack(model, docs).collect()
        assert len(rows) == 3 and len({r["score"] for r in rows if r["blob_id"] == "1"}) == 2
    assert scores.swap_attack(model, docs.filter("blob_id = '2'")).first()["score"] == 0.0


def test_served_model(spark):
    class Echo:
        """A model of known answers: every token has the log-probability -length, a continuation repeats the last word."""

        def logprobs(self, texts, max_tokens):
            return [[(w, -float(len(w))) for w in t.split()[1:max_tokens]] for t in texts]

        def generate(self, texts, max_new, stop):
            return [" ".join(t.split()[-1:] * max_new).partition(stop or "\0")[0] for t in texts]

    docs = spark.createDataFrame([("1", "a bb ccc", 1), ("2", "a", 0), ("3", None, 0)], "blob_id string, text string, label int")
    model = served.ServedModel(Echo, batch=2)
    assert lm.require_model(model) is model
    assert {r["blob_id"]: r["score"] for r in scores.loss_attack(model, docs).collect()} == {"1": -2.5, "2": None, "3": None}
    assert {r["blob_id"]: r["output"] for r in model.generate(docs, 2, "c c").collect()} == {"1": "cc", "2": "a a", "3": ""}
    hits = elements.infill_hits(model, docs)
    assert hits.count() == 0
    with pytest.raises(RuntimeError):
        served.open_model("no_such_module:load")
    assert served.open_model("collections:Counter").batch == 32


@pytest.mark.parametrize("n", [1, 10, 34, 100])
def test_polarized_distance(spark, n):
    v = [math.sin(i) for i in range(n)]
    far, near = max(1, min(5, n)), max(1, min(30, n))
    if near + far > n:
        s = n / (near + far)
        near, far = max(1, int(near * s)), max(1, int(far * s))
    w = sorted(v)
    got = scores.polarized_distance(spark.createDataFrame([("a", x) for x in v], "blob_id string, lp double")).first()["score"]
    assert abs(got - (sum(w[-far:]) / far - sum(w[:near]) / near)) < 1e-9


def test_token_swap_by_definition(spark):
    texts = ["", "one", "a b c d e f g h i j", " ".join(map(str, range(300)))]
    for r in scores.swap_tokens(frame(spark, texts)).collect():
        t = texts[int(r["blob_id"])].split()
        for k in range(int(0.3 * len(t)) if r["variant"] else 0):
            h = hashlib.md5(f"42|swap|{r['blob_id']}|{r['variant']}|{k}".encode()).hexdigest()
            i, j = int(h[:8], 16) % len(t), int(h[8:16], 16) % (len(t) - 1)
            j += j >= i
            t[i], t[j] = t[j], t[i]
        assert r["text"] == " ".join(t)


def test_token_swap(spark):
    rows = scores.swap_tokens(spark.createDataFrame([("a", " ".join(map(str, range(40)))), ("b", "x y")], "blob_id string, text string")).collect()
    assert len(rows) == 12
    for r in rows:
        assert sorted(r["text"].split()) == sorted((" ".join(map(str, range(40))) if r["blob_id"] == "a" else "x y").split())
    assert len({r["text"] for r in rows if r["blob_id"] == "a"}) == 6


def test_attacks_run(spark):
    docs = spark.createDataFrame([(f"def f{i}(a):\n    v{i} = a + {i}  # {'alpha' if i % 2 else 'beta'} note\n    return v{i}\n", str(i), i % 2) for i in range(60)], "text string, blob_id string, label int")
    model = lm.NGramLM(docs.filter("label = 1"))
    for key in ("bow", "pac", "trawic"):
        out = registry.run_attack(key, docs, model=model).collect()
        assert len(out) == 12 and all(r["score"] is not None for r in out)
    assert {r["metric"]: r["value"] for r in registry.evaluate("bow", docs).collect()}["roc auc"] == 1.0
    with pytest.raises(ValueError):
        registry.run_attack("nothing", docs)
    with pytest.raises(RuntimeError):
        registry.run_attack("loss", docs)


def test_registered_attack_and_run_folder(spark, tmp_path):
    class Length:
        requires_model = False

        def __init__(self, model, seed=42, **options):
            self.by = options.get("by", 1)

        def fit(self, docs):
            return self

        def score(self, docs):
            return docs.select("blob_id", "label", (F.length("text") / self.by).alias("score"))

    registry.register("length", Length)
    try:
        with pytest.raises(ValueError):
            registry.register("loss", Length)
        docs = spark.createDataFrame([("x" * (i + 40 * (i % 2)), str(i), i % 2) for i in range(1, 41)], "text string, blob_id string, label int")
        about = {r["item"]: r["value"] for r in registry.run("length", docs, str(tmp_path / "runs" / "length_1"), by=2).collect()}
        assert about["attack"] == "length" and about["by"] == "2" and about["test members"] == "4" and about["train others"] == "16" and about["roc auc"] == "1.0"
        assert (tmp_path / "runs" / "length_1" / "metrics.csv").read_text().startswith("metric,value\nroc auc,1.0\n")
        assert files.read_predictions(spark, str(tmp_path / "runs" / "length_1" / "predictions.csv")).count() == 8
        registry.run("length", docs.filter("label = 1").unionByName(docs.filter("label = 0").limit(1)), str(tmp_path / "runs" / "length_2"))
        wide = {r["run_folder"]: r["roc auc"] for r in report.unify_wide(files.read_runs(spark, str(tmp_path / "runs"))).collect()}
        assert wide["length_1"] == 1.0 and wide["length_2"] is None
        assert (tmp_path / "runs" / "length_2" / "metrics.csv").read_text() == "metric,value\nroc auc,\nTPR @ 1% FPR,\nTPR @ 0.1% FPR,\n"
    finally:
        del registry.ATTACKS["length"]


def test_stability_with_another_feature_model(spark):
    class Sizes:
        def embed(self, text):
            return F.array(F.length(text).cast("double"), F.lit(1.0))

        def perplexity(self, docs, keys):
            return docs.select(*keys, (F.length("text") + 1.0).alias("ppl"))

    docs = spark.createDataFrame([(f"value{i} = name{i} + 1\nprint(value{i})\n" * 3, str(i), i % 2) for i in range(30)], "text string, blob_id string, label int")
    model = lm.NGramLM(docs.filter("label = 1"))
    rows = learned.stability_features(model, Sizes(), docs).collect()
    assert len(rows) == 30 and all(len(r["features"]) == 27 and not any(math.isnan(x) for x in r["features"]) for r in rows)
    out = registry.run_attack("miaadv", docs, model=model, features=Sizes()).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)


def test_logistic_regression_is_at_its_optimum(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(" ".join(r.choice(["alpha", "beta", "gamma", "delta", "only" if i % 2 else "never"]) for _ in range(8)), str(i), i % 2) for i in range(80)], "text string, blob_id string, label int")
    bow = learned.BagOfWords().fit(docs)
    idx = {x["term"]: x["idx"] for x in bow.vocab.collect()}
    x, y = np.zeros((80, len(idx))), np.arange(80) % 2
    for w in learned.tfidf(learned.ngram_counts(docs), bow.vocab, 80).collect():
        x[int(w["blob_id"]), idx[w["term"]]] = w["w"]
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    w, b = bow.coefficients, bow.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 2e-4 and abs((p - y).sum()) < 2e-4  # sum of losses + |w|^2 / 2
    got = {v["blob_id"]: v["score"] for v in bow.score(docs).collect()}
    assert max(abs(got[str(i)] - p[i]) for i in range(80)) < 1e-9


def test_embedding_counts(spark):
    texts = ["A b a", "", None, "é x\ty"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", lm.embed("t", 8).alias("e")).collect():
        want = [0.0] * 8
        for w in (r["t"] or "").lower().split():
            want[zlib.crc32(w.encode()) % 8] += 1
        assert list(r["e"]) == want


def test_acquisition_stops_early(spark, tmp_path):
    for i in range(12):
        spark.createDataFrame([(i, j) for j in range(10)], "i long, j long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keep = lambda rows: rows.filter("j % 2 = 0")
    paths = str(tmp_path / "out"), str(tmp_path / "cp")
    assert acquire(spark, str(tmp_path / "in"), "i long, j long", 12, keep, *paths) == 12
    assert len(list((tmp_path / "cp" / "commits").glob("[0-9]*"))) <= 5 and spark.read.parquet(f"{paths[0]}/*").filter("j % 2 = 0").count() == 12
    assert acquire(spark, str(tmp_path / "in"), "i long, j long", 12, keep, *paths) == 12
    assert acquire(spark, str(tmp_path / "in"), "i long, j long", 1000, keep, *paths) <= 60


def test_features_and_perceptron(spark):
    hits = spark.createDataFrame([("a", "strings", 1), ("a", "strings", 0), ("a", "comments", 1)], "blob_id string, level string, hit int")
    rows = {r["blob_id"]: r for r in elements.features(spark.createDataFrame([("a",), ("b",)], "blob_id string"), hits).collect()}
    assert (rows["a"]["strings_hits"], rows["a"]["strings_total"], rows["a"]["comments_hits"]) == (0.5, 2.0, 1.0) and sum(list(rows["b"])[1:]) == 0
    r = np.random.default_rng(0)
    x = r.standard_normal((200, 27))
    y = (x[:, 0] > 0).astype(int)
    net = learned.Mlp().fit(x[:150], y[:150], (x[150:], y[150:]))
    assert ((net.predict(x) > 0.5) == y).mean() > 0.9
    p = net.predict(x[150:])
    loss, accuracy = net.evaluate(x[150:], y[150:])
    assert net.history[-1] == (loss, accuracy) and len(net.history) == net.epochs
    got = metrics.cross_entropy(spark.createDataFrame(list(zip(p.tolist(), y[150:].tolist(), strict=True)), "score double, label int")).first()
    assert abs(got["loss"] - loss) < 1e-9 and abs(got["accuracy"] - accuracy) < 1e-12


def test_sources(spark, tmp_path):
    spark.createDataFrame([("b",)], "content string").coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    spark.createDataFrame([("a",)], "content string").coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    assert files.read_collection(spark, str(tmp_path)).collect()[0]["content"] == "a"
    assert files.read_collection(spark, str(tmp_path), all_files=True).count() == 2
    with pytest.raises(FileNotFoundError):
        files.first_parquet(spark, str(tmp_path / "none"))
    flags = spark.createDataFrame([(1, False)], "id long, exact_duplicates_stackv2 boolean")
    assert flags.filter(files.not_duplicate(flags)).count() == 0  # an absent flag counts as set
    for name, body in (("loss_1", "metric,value\nroc auc,0.5\n"), ("bow_x_y", "metric,value\nroc auc,0.9\n")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "metrics.csv").write_text(body)
    (tmp_path / "runs" / "empty").mkdir()
    wide = report.unify_wide(files.read_runs(spark, str(tmp_path / "runs"))).collect()
    assert {(r["attack_name"], r["run_folder"], r["roc auc"]) for r in wide} == {("loss", "loss_1", 0.5), ("bow", "bow_x_y", 0.9)}
    page = report.dashboard(report.attack_means(files.read_runs(spark, str(tmp_path / "runs"))))
    assert "roc auc" in page and page.count("<rect") == 2 and page.count('type="checkbox"') == 2
    assert page.count('<g class="a0">') == page.count('<g class="a1">') == 1 and "show(this, 'a1')" in page


def test_stream(spark, tmp_path):
    from tidewake.streaming.scorer import score_stream

    spark.createDataFrame([("1", "a b")], "blob_id string, text string").write.parquet(str(tmp_path / "in"))
    run = lambda: score_stream(spark, str(tmp_path / "in"), "blob_id string, text string", lambda b: b.select("blob_id", F.length("text").alias("score")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    spark.createDataFrame([("2", "abc de")], "blob_id string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {(r["blob_id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1", 3), ("2", 6)}


def test_registry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3


def test_names_are_drawn_once_a_text(spark):
    """Not again for every line: the lines are looked through with a name that is bound outside."""
    lines = F.array(F.lit("a = 1"), F.lit("bb = a"))
    text = str(perturb._first_line(lines, F.lower(F.lit("BB"))))
    assert text.lower().index("lower") < text.index("array_contains")
    assert spark.range(1).select(perturb._first_line(lines, F.lower(F.lit("BB"))).alias("i"), perturb._first_line(lines, F.lit("c")).alias("n")).first()[:] == (1, None)
