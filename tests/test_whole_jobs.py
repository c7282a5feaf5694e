"""Registered jobs over whole tables, and infills of full length."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewake.operators import elements, fill, learned, lm, packed
from tidewake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["agg_sim_stats", "agg_ppl_stats", "adv_features"])
def test_all_events(spark, name):
    sql = catalog.ORACLE_SQL[name].replace("FROM events", f"FROM '{SF}/events.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in catalog.QUERIES[name](spark, SF).collect()}
    assert len(got) == -(-spark.read.parquet(f"{SF}/events.parquet").count() // 12) > 80 and got.keys() == want.keys()
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-6) for k in got for a, b in zip(got[k], want[k], strict=True))


@pytest.mark.parametrize("name", ["attack_loss", "attack_mkp"])
def test_untrained_attacks_score_every_sample(spark, name):
    """Not the held-out split alone."""
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = {(r[0], r[1]): r[2] for r in duckdb.sql(catalog.ORACLE_SQL[name]).fetchall()}
    got = {(r[0], r[1]): r[2] for r in catalog.QUERIES[name](spark, SF).collect()}
    assert len(got) == catalog.samples(spark, SF).count() and got.keys() == want.keys()
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-6) for k in got for a, b in [(got[k], want[k])])


@pytest.mark.parametrize("name", ["stratified_split", "agg_label_counts", "val_split"])
def test_splits_do_not_shuffle_texts_by_label(spark, name):
    """What has a row for each label is broadcast; a shuffle by label would give half of all texts to one task."""
    assert "SortMergeJoin" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == sorted(duckdb.sql(catalog.ORACLE_SQL[name]).fetchall())


def _moved(df) -> tuple[str, list[str]]:
    """The plan, and what its shuffles are dealt by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", plan)


@pytest.mark.parametrize("name", ["lm_token_logprobs", "attack_loss", "agg_min_k", "agg_polarized_distance", "win_rank_logprob", "ppl_text", "attack_pac"])
def test_scores_shuffle_no_tokens(spark, name):
    """Texts go to blocks, and blocks ask parts of the counts; a token is no row of a shuffle, and has no key of its own there."""
    _, keys = _moved(catalog.QUERIES[name](spark, SF))
    assert keys and not any("token" in k or "prev" in k or "_key" in k for k in keys), keys


@pytest.mark.parametrize("hot", [0, 5, 100_000])
def test_counts_of_blocks_and_parts(spark, hot, monkeypatch):
    """Many blocks and parts, repeated rows, null and empty texts, and texts cut short."""
    monkeypatch.setattr(packed, "BLOCK", 50)
    monkeypatch.setattr(packed, "PART", 100)
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(r.randrange(60))) for _ in range(60)] + ["", None, "one", "a  b\ta b"]
    rows = [(str(i), t) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "blob_id string, text string")
    known = [(t or "").split() for _, t in rows if t != texts[0]]
    c2 = Counter(p for t in known for p in zip(t, t[1:], strict=False))
    c1 = Counter(a for t in known for a in t[:-1])
    counts = packed.Counts(docs.filter(F.col("text").isNull() | (F.col("text") != texts[0])), lm.tokenize, hot)
    assert counts.parts > 5 and counts.vocabulary == len({w for t in known for w in t})
    for most in (None, 7):
        want = sorted((b, [c2[p] for p in zip(t, t[1:], strict=False)], [c1[a] for a in t[:-1]]) for b, t in ((b, (t or "").split()[:most]) for b, t in rows))
        assert sorted((x["blob_id"], x["c2"], x["c1"]) for x in counts.of_texts(docs, most, ("blob_id",)).collect()) == want


@pytest.mark.parametrize("name", ["win_ngrams", "tfidf"])
def test_terms_are_counted_where_their_texts_are(spark, name):
    _, keys = _moved(catalog.QUERIES[name](spark, SF))
    assert keys and not any("blob_id" in k and "term" in k for k in keys), keys


def test_infills_of_several_words(spark):
    known = spark.createDataFrame([("k", "# alpha beta gamma delta\n")], "blob_id string, text string")
    hits = elements.infill_hits(lm.NGramLM(known), known).filter("level = 'comments'").collect()
    assert [r["hit"] for r in hits] == [1]


def test_hit_features_are_made_once(spark):
    """The forest reads its rows at every level: they are written, with nothing left to compute but the vector."""
    known = spark.createDataFrame([("k", "# alpha beta gamma delta\n", 1), ("l", "x = 'one two'\n", 0)], "blob_id string, text string, label int")
    rows = learned.ElementHits(lm.NGramLM(known)).features(known)
    plan, keys = _moved(rows)
    assert not keys and "Join" not in plan and "Generate" not in plan and rows.count() == 2


def test_draws_wait_for_tokens_that_are_not_common(spark, monkeypatch):
    """With next to nothing broadcast, draws are those of the definition, and the table of successors is not shuffled."""
    monkeypatch.setattr(fill, "BYTES", 1500)
    monkeypatch.setattr(fill, "COMMON", 3)
    r = random.Random(3)
    pairs = sorted({(a, b): r.randrange(1, 5) for a in "abcdefgh" for b in r.sample("abcdefghz", 3)}.items())
    table = lm.written(fill.nucleus(spark.createDataFrame([(a, b, n) for (a, b), n in pairs], "prev string, token string, c2 long"), 1.0, 1.0), "t", bytes=fill._bytes("prev", "token"))
    ranges = {}
    for x in table.collect():
        ranges.setdefault(x["prev"], []).append((x["lo"], x["hi"], x["mass"], x["token"]))
    starts = spark.range(200).select(F.col("id").alias("_row"), F.col("id").alias("blob_id"), F.element_at(F.array(*map(F.lit, "abcdefghzq")), (F.col("id") % 10 + 1).cast("int")).alias("_here"))
    got = {x["_row"]: x["output"].split() for x in fill.sampled(starts, table, 12, 42, ("blob_id",)).collect()}
    for i in range(200):
        here, want = "abcdefghzq"[i % 10], []
        while len(want) < 12 and here in ranges:
            u = int(hashlib.md5(f"42|infill|{i}|{len(want)}".encode()).hexdigest()[:8], 16) / 2**32
            (here,) = [t for lo, hi, mass, t in ranges[here] if lo <= math.floor(u * mass) < hi]
            want.append(here)
        assert got[i] == want
    assert len(got) == 200
