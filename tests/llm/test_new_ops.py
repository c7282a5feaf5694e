"""Row patterns, the filter audit and exact dedup against plain versions, with the defined cases."""

import datetime as dt
import hashlib
import random
from itertools import permutations

import held_out_toxicity
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm import audit, exact, rowpattern

CLICKS = T.StructType([
    T.StructField("click_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("client_id", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
START = dt.datetime(2024, 3, 30, 22, 0)


def plain_matches(rows, gap=dt.timedelta(minutes=15)):
    """The pattern by recursion over each client's sorted distinct rows."""
    clients = {}
    for r in set(rows):
        if r[2] is not None and r[1] is not None:
            clients.setdefault(r[2], []).append(r)
    out = []
    low = lambda x: (x is not None, x if x is not None else 0)
    for client, own in clients.items():
        own.sort(key=lambda r: (r[1], low(r[0]), (r[3] is not None, r[3] or ""), low(r[4])))
        fine = [None if r[4] is None or not np.isfinite(r[4]) else int(np.floor(100 * r[4] + 0.5)) for r in own]

        def moves(i, sign):
            near = own[i][1] - own[i - 1][1] <= gap and fine[i] is not None and fine[i - 1] is not None
            return near and own[i][3] not in (None, "error") and (fine[i] - fine[i - 1]) * sign > 0

        def peak(i, s):
            return own[i][1] - own[i - 1][1] <= gap and own[i][3] == "view" and fine[i] is not None and fine[i] >= fine[s]

        def tail(i):
            return "D" + tail(i + 1) if i < len(own) and moves(i, -1) else ""

        def body(i, s):
            if i >= len(own):
                return None
            for letter, sign in (("D", -1), ("U", 1)):
                if moves(i, sign) and (rest := body(i + 1, s)) is not None:
                    return letter + rest
            return "P" + tail(i + 1) if peak(i, s) else None

        s, no = 0, 0
        while s < len(own):
            rest = body(s + 1, s) if fine[s] is not None else None
            if rest is None:
                s += 1
                continue
            no, labels = no + 1, "A" + rest
            end = s + len(labels)
            out.append((client, no, own[s][0], own[end - 1][0], len(labels), sum(fine[s:end]), labels))
            s = end
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels").collect()), key=repr)


@pytest.mark.parametrize("pack", [1, 50, 8192])
def test_matches_equal_recursion(spark, pack):
    rng = random.Random(pack)
    rows = []
    for client in range(12):
        at = START + dt.timedelta(minutes=rng.randrange(3000))
        for _ in range(rng.choice([1, 3, 40, 160])):
            at += dt.timedelta(seconds=rng.choice([0, 0, 1, 60, 400, 899, 900, 901, 1, 5, 5000]), microseconds=rng.choice([0, 0, 1]))
            value = rng.choice([None, 1.0, 1.5, 2.0, 2.5, 3.005, 1.004, float("nan"), 7.0] + [float(rng.randrange(6))] * 20)
            rows.append((rng.choice([None] + [len(rows)] * 30), at, rng.choice([None] + [client] * 40), rng.choice(["view", "view", "click", "error", None, "view"]), value, rng.choice([None, "{}"])))
    rows += rows[::5]
    assert found(rowpattern.match(spark.createDataFrame(rows, CLICKS).repartition(5), pack=pack)) == plain_matches(rows)


def test_segments_over_buckets_and_days(spark):
    """One client: a segment of three days without a cut, then short ones; numbers go on over days."""
    rows, at = [], START
    for i in range(700):
        at += dt.timedelta(minutes=7) if i < 650 else dt.timedelta(minutes=20 if i % 3 else 1)
        rows.append((i, at, 1, "click" if i < 640 and i != 600 else "view", float(i % 2) if i < 650 else float(i), None))
    rows[600] = rows[600][:4] + (100.0, None)
    got = found(rowpattern.match(spark.createDataFrame(rows, CLICKS)))
    assert got == plain_matches(rows) and any(r[4] > 500 for r in got) and len(got) > 10


def test_pattern_cases(spark):
    empty = rowpattern.report(spark.createDataFrame([], CLICKS))
    assert empty.count() == 0 and empty.columns == ["client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256"]
    minute = lambda k: START + dt.timedelta(minutes=k)
    rows = [(i, minute(i), 1, k, v, None) for i, (k, v) in enumerate([(None, 2.0), ("click", 1.0), ("click", 5.0), ("view", 5.0), ("click", 4.0), ("error", 3.0)])]
    rows += [(7, START, None, "view", 1.0, None), (8, None, 1, "view", 1.0, None)]
    clash = spark.createDataFrame(rows, CLICKS).withColumn("pack", F.lit(1)).withColumn("seg", F.lit("x")).withColumn("CENTS", F.lit(0)).withColumn("m", F.create_map(F.lit("k"), F.col("kind")))
    assert found(rowpattern.match(clash)) == [(1, 1, 0, 4, 5, 1700, "ADUPD")]
    named = spark.createDataFrame([(f"c{i}", r[1], "me" if r[2] else None, r[3], r[4]) for i, r in enumerate(rows)], "click_id string, ts timestamp_ntz, client_id string, kind string, value double")
    assert found(rowpattern.match(named)) == [("me", 1, "c0", "c4", 5, 1700, "ADUPD")]


def test_times_do_not_depend_on_the_zone(spark):
    """In the hour that a zone leaves out or repeats, times without a zone are 15 minutes apart as written."""
    rows = [(i, dt.datetime(2024, 3, 31, 1, 50) + dt.timedelta(minutes=10 * i), 1, "view", float(i), None) for i in range(5)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert found(rowpattern.match(spark.createDataFrame(rows, CLICKS))) == plain_matches(rows) == [(1, 1, 0, 4, 5, 1000, "AUUUP")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_last_row_of_a_match_opens_the_next(spark):
    """After a match the search goes on at its last row, in the same segment and over the border of a bucket."""
    minute = lambda k: START + dt.timedelta(minutes=k)
    rows = [(i, minute(7 * i), 1, k, v, None) for i, (k, v) in enumerate([("click", 1.0), ("view", 5.0), ("click", 4.0), ("click", 6.0), ("view", 6.0), ("view", 6.0), ("click", 9.0)])]
    assert found(rowpattern.match(spark.createDataFrame(rows, CLICKS))) == [(1, 1, 0, 4, 5, 2200, "AUDUP"), (1, 2, 4, 5, 2, 1200, "AP")]


def plain_audit(docs, labels):
    first, masks = {}, []
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for i, t, lang in docs:
        t, copy = t or "", i is not None and i > first[t or ""]
        words = t.encode().split()
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), copy)
        masks.append((lang or "", {f for f, x in zip("ABCDE", fails) if x}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {m[0] for m in masks}:
        rows = [m[1:] for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                seen = set(order[:k])
                gone = [r for r in rows if f in r[0] and not r[0] & seen]
                shapley = sum(120 // len(r[0]) for r in rows if f in r[0])
                out.append((part, "".join(order), k + 1, sum(not r[0] & (seen | {f}) for r in rows), len(gone), sum(f in r[0] and bool(r[0] & seen) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), shapley))
    return sorted(out)


def test_audit_equals_counting(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "Bc", "DEF", "x#", "é", "ZZ", "tail"]) + str(rng.randrange(400))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 99, 100, 101, 300]))) for _ in range(40)] + [None, "", " \t\n", "A", "a|b", "x" * 3_000_000 + " y" * 700_000]
    docs = [(rng.choice([None] + list(range(60)) * 2), rng.choice(texts), rng.choice(["en", None, "", "de"])) for _ in range(200)]
    labels = [(rng.choice([None] + list(range(60))), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("m")).withColumn("PART", F.lit(1)).withColumn("n", F.lit(2)).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert audit.audit(frame.limit(0), marks).count() == 0
    assert sorted(map(tuple, audit.audit(frame, marks.limit(0)).collect())) == plain_audit(docs, [])


def test_words_are_counted_alike_in_pieces(monkeypatch):
    data = b" ab  c\x0bd\xc2\xa0e ab\n" * 50
    whole = audit._words(data)
    monkeypatch.setattr(audit, "PIECE", 7)
    assert audit._words(data) == whole == (len(data.split()), len(set(data.split())))


def plain_dedup(docs):
    groups = {}
    norm = lambda t: b" ".join(p for p in __import__("re").split(rb"[\x20\x09-\x0D]+", (t or "").encode()))
    for i, t in docs:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1, 40, exact.SHARD])
def test_exact_dedup_equals_grouping(spark, shard):
    rng = random.Random(shard)
    texts = [None, "", " ", "\n\t", "a b", "a\x0b\n b", " a b", "a b ", "a b", "z " * 500_000] + [f"t {k}" for k in range(120)]
    docs = [(rng.choice([None] + list(range(300)) * 3), rng.choice(texts + ["hot text"] * 60)) for _ in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("N", F.lit(1)).withColumn("copy", F.lit(0))
    got = exact.report(frame, shard)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup(docs)


def test_exact_dedup_cases(spark):
    assert exact.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = exact.report(spark.createDataFrame([("b", "x  y"), ("a", "x y"), (None, "q")], "doc_id string, text string"))
    assert sorted((r[0] or "", r[1] or "", *r[2:4]) for r in named.collect()) == [("", "", 1, True), ("a", "a", 2, True), ("b", "a", 2, False)]


def test_history_answers_batches(spark):
    """Members of a loaded history are known, nonmembers are not, at any number of shards, or with an empty history."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 3000).cast("string")).alias("text"))
    old, new = exact.digests(docs.filter("doc_id < 2000")), exact.digests(docs.filter("doc_id >= 2000"))
    for shards in (1, 7):
        got = exact.merge(exact.build(old, shards), new, shards)
        rows = got.groupBy("known").agg(F.count("*"), F.sum("n"), F.sum("winner")).orderBy("known").collect()
        assert [tuple(r) for r in rows] == [(False, 1000, 1000, sum(range(2000, 3000))), (True, 2000, 3000, sum(range(2000)))]
    none = exact.merge(exact.build(old.limit(0), 3), new, 3)
    assert none.filter("known").count() == 0 and none.count() == 2000


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 1000, 30_000):
        words = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
        perfect = exact.PerfectHash.of(words)
        again = exact.PerfectHash(perfect.sizes, perfect.packed())
        assert sorted(again.slots(words).tolist()) == list(range(n))
        others = again.slots(rng.integers(0, 2**63, (500, 4), dtype=np.uint64))
        assert ((others >= -1) & (others < max(n, 1))).all()
        assert sum(perfect.sizes) <= 4.5 * n + 200


def test_toxicity_holds_on_labels_it_never_saw():
    """33 toxic texts to learn from: most of the held-out toxic ones are found, few clean ones called toxic."""
    auc, found, toxic, false, clean = held_out_toxicity.figures(*held_out_toxicity.labelled("/root/testdata/sf0.01"), seed=5)
    assert auc >= 0.85 and 2 * found >= toxic == 18 and false <= 5 and clean == 95
