"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import audit, chat, decontaminate, exact, mixing, pii, resample, rowpattern, simhash, suffixes, topk, toxicity, urlfilter


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_decontamination": lambda s, d: decontaminate.report(_t(s, d, "documents"), _t(s, d, "benchmark")),
    "op2_toxicity": lambda s, d: toxicity.report(_t(s, d, "documents"), _t(s, d, "labels")),
    "op3_chat_rotation": lambda s, d: chat.rotate(_t(s, d, "conversations")),
    "op4_temperature_mixing": lambda s, d: mixing.schedule(_t(s, d, "documents")),
    "op5_url_filter": lambda s, d: urlfilter.judge(_t(s, d, "pages"), urlfilter.rule_table(s)),
    "op6_importance_resampling": lambda s, d: resample.resample(_t(s, d, "documents"), _t(s, d, "labels")),
    "op7_exact_topk": lambda s, d: topk.top_k(_t(s, d, "embeddings")),
    "op8_simhash_golay": lambda s, d: simhash.report(_t(s, d, "documents")),
    "op9_suffix_dedup": lambda s, d: suffixes.report(_t(s, d, "documents")),
    "op10_pii": lambda s, d: pii.report(_t(s, d, "documents")),
    "op11_row_pattern": lambda s, d: rowpattern.report(_t(s, d, "clicks")),
    "op12_filter_audit": lambda s, d: audit.audit(_t(s, d, "documents"), _t(s, d, "labels")),
    "op13_exact_dedup": lambda s, d: exact.report(_t(s, d, "documents")),
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_chat_rotation": chat.ORACLE,
    "op4_temperature_mixing": mixing.ORACLE,
    "op5_url_filter": urlfilter.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op11_row_pattern": rowpattern.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_exact_dedup": exact.ORACLE,
}
