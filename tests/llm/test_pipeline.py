"""The pipeline's stages on the smallest tables, each held against its operator and brute force."""

import corpus_pipeline

from tidewake.llm import decontaminate, mixing, queries, toxicity

from test_similar import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.materialize(stage(spark, seen[-1], SF), "t"))
    assert all(x.columns == docs.columns for x in seen[:-1])
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    toxic = {r["doc_id"] for r in toxicity.report(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert toxic and ids[1] == ids[0] - toxic
    rows = sorted((r["doc_id"], r["text"]) for r in seen[1].collect())
    assert ids[2] == {rows[i][0] for i in kept_by_brute_force([t for _, t in rows])}
    clean = {r["doc_id"] for r in decontaminate.report(seen[2], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("not contaminated").collect()}
    assert ids[3] == clean and ids[4] == clean and ids[5] <= clean
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (seen[3], seen[4]))
    changed = [i for i in before if before[i] != after[i]]
    assert changed and all("<" in after[i] for i in changed)
    plan = sorted((r["doc_id"], r["epoch"], r["block"], r["position"], r["weight"]) for r in mixing.schedule(seen[4]).collect())
    drawn = seen[5].collect()
    assert plan == sorted((r["doc_id"], r["epoch"], r["block"], r["position"], r["weight"]) for r in drawn)
    assert all(r["text"] == after[r["doc_id"]] for r in drawn) and seen[5].columns[: len(docs.columns)] == docs.columns
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, drawn))


def test_registry():
    assert set(queries.ORACLE_SQL) < set(queries.QUERIES) and len(queries.QUERIES) == 14
