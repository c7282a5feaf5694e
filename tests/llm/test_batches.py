"""Memory of Python workers: batches of texts and the tables that stay between them are bounded."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tidewake.llm import common, kernels

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stage", range(3))
def test_stages_send_small_batches(spark, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    setting = common._BATCH
    spark.conf.unset(setting)
    few = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    long = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('x', 2000) as text")
    try:
        corpus_pipeline.STAGES[stage][1](spark, few, SF)
        seen = long.mapInArrow(sizes, "n bigint, b bigint").collect()
        assert sum(r["n"] for r in seen) == 9000 and max(r["b"] for r in seen) < common.BATCH_BYTES + 10_000
        spark.conf.set(setting, 1000)
        common.small_batches(spark)
        assert spark.conf.get(setting) == "1000"
    finally:
        spark.conf.unset(setting)


def test_one_table_of_powers_stays(monkeypatch):
    monkeypatch.setattr(kernels, "_POWERS", (np.zeros(0, dtype=np.uint64),) * 2)
    for n in (10, 5000, 70_000, 40):
        up, down = kernels.powers(n)
        assert len(up) > n and (up[: n + 1] * down[: n + 1] == 1).all() and int(up[n]) == pow(int(kernels.BASE), n, 1 << 64)
    assert sum(x.nbytes for x in kernels._POWERS) == 2 * 8 * ((1 << 17) + 1)
    kernels.words(np.full(3 * (1 << 20), 32, dtype=np.uint8))
    assert sum(x.nbytes for x in kernels._POWERS) < 10 << 20
