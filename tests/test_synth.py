"""Synthetic shadow tables: no orphans, deterministic."""

from pyspark.sql import functions as F


def test_no_orphans(small):
    from sqlweave.plans.synth_jobs import q_synth_fk_orphans
    rows = q_synth_fk_orphans(small).collect()
    assert rows and all(r.orphans == 0 for r in rows)


def test_deterministic(small):
    from sqlweave.plans.synth_jobs import q_synth_rows
    a = q_synth_rows(small).agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0]
    b = q_synth_rows(small).agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0]
    assert a == b


def test_missing_parents_are_orphans(small, monkeypatch):
    from sqlweave.plans import synth_jobs
    real = synth_jobs.synth_table

    def thinned(spark, layout, table, n_rows):
        df = real(spark, layout, table, n_rows)
        return df.filter("o_orderkey % 2 = 0") if table == "orders" else df
    monkeypatch.setattr(synth_jobs, "synth_table", thinned)
    rows = {(r.from_table, r.to_table): r for r in synth_jobs.q_synth_fk_orphans(small).collect()}
    assert 0 < rows["lineitem", "orders"].orphans < rows["lineitem", "orders"].n_rows
    assert all(r.orphans == 0 for k, r in rows.items() if k[1] != "orders")
