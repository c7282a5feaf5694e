"""The exact join of similar texts against brute force."""

import random

from tidewake.llm import similar, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return set(root)


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choices(words, k=12))
    texts = ["", None, "one two", "One  two", "one two three"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([40, 100, 300]))
        texts.append(line + " " + " ".join(base))
        for edits in (1, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = rng.choice(words)
            texts.append(line + " " + " ".join(copy))
    return texts


def test_near_copies_against_brute_force(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)
    expected = kept_by_brute_force(texts)
    assert {r["doc_id"] for r in similar.keep_one(rows).collect()} == expected
    assert {r["doc_id"] for r in simhash.report(rows).collect() if r["component_id"] == r["doc_id"]} > expected
    least = {}
    for r in similar.similar(rows, limit=3).collect():
        least[r["root"]] = min(r["doc_id"], least.get(r["root"], r["doc_id"]))
    assert set(least.values()) == expected


def test_repeated_ids(spark):
    a, b = "one two three four five six", "quite another text of some few words"
    rows = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a, "en", "s", 1), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in similar.keep_one(rows).collect()) == [(1, a), (2, b), (3, "x")]


def test_equal_rows_leave_the_smallest(spark):
    """Rows equal in id and text differ elsewhere; columns named as the operator's own stay as they are."""
    rows = spark.createDataFrame([(1, "a b c", z, r, {"k": z}) for z, r in (("y", 2), ("x", 9), ("x", 3))], "doc_id long, text string, root string, node int, rid map<string,string>").repartition(3)
    (kept,) = similar.keep_one(rows).collect()
    assert kept.asDict() == {"doc_id": 1, "text": "a b c", "root": "x", "node": 3, "rid": {"k": "x"}}
    assert similar.keep_one(rows.filter("false")).count() == 0
