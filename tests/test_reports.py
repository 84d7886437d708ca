"""Gate and link reports cover every catalog of the corpus."""

from pyspark.sql import functions as F


def test_gate_report_covers_all_catalogs(small):
    from sqlweave.plans.check_jobs import planted, q_gate_report
    want = {r.variant: r.n for r in planted(small).groupBy("variant").agg(F.count("*").alias("n")).collect()}
    got = {r["mode"]: r for r in q_gate_report(small).collect()}
    assert {k: r.n for k, r in got.items()} == want
    assert got["gold"].valid == got["gold"].graph_valid == got["gold"].exact == 1.0
    assert got["bad_column"].valid == got["bad_table"].valid == 0.0


def test_link_report_covers_all_catalogs(small):
    from sqlweave.plans.module_jobs import module_corpus, q_link_report
    r = q_link_report(small).first()
    tabs, _, _, specs, _ = module_corpus(small)
    assert r.n_questions == specs.count() > specs.filter("schema_id = 'm00'").count()
    assert r.mean_tables_before == tabs.count() and 0 < r.recall <= 1
