"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("op1_bpe", "op2_quality", "op3_shards", "op4_neardup", "op5_warc", "op6_langid",
           "op7_packing", "op8_license", "op9_minhash", "op10_rules", "op11_conversations", "op12_bytebpe", "op13_runs")


def _modules():
    return [importlib.import_module(f"sqlweave.llm.{m}") for m in MODULES]


def queries() -> dict:
    import corpus_pipeline
    out = {"pipeline": corpus_pipeline.run}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.SQL)
    import corpus_pipeline
    if corpus_pipeline.ORACLE_SQL is not None:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
