"""Whole-table profile jobs on planted data: orphans, NULL keys, a hot key, domains."""

import os
import tempfile

import pytest


@pytest.fixture(scope="module")
def planted(spark):
    from sqlweave.sources.tables import Tables
    root = tempfile.mkdtemp(prefix="sqlweave-profile-")
    # parent keys 1..100; child: a hot key (1/3 of rows), 5 orphans, 3 NULL keys
    spark.createDataFrame([(i, f"p{i}") for i in range(1, 101)], "pid bigint, name string") \
        .write.parquet(os.path.join(root, "parent.parquet"))
    rows = [(1, "A")] * 300 + [(i % 100 + 1, "B") for i in range(600)] + \
        [(1000 + i, "C") for i in range(5)] + [(None, "A")] * 3
    spark.createDataFrame(rows, "pid bigint, flag string") \
        .write.parquet(os.path.join(root, "child.parquet"))
    return Tables(spark, root)


def test_fk_orphans_counts(spark, planted):
    from sqlweave.sources.star import fk_orphans
    fks = spark.createDataFrame([("child", "pid", "parent", "pid")],
                                "from_table string, from_column string, to_table string, "
                                "to_column string")
    r = fk_orphans(planted, fks).collect()[0]
    assert (r.n_rows, r.orphans) == (908, 5)


def test_lookup_domains_are_whole(planted):
    from sqlweave.sources.star import lookup_domains
    small = lookup_domains(planted, {("child", "flag"): "FLAG"}).collect()[0]
    assert list(small.allowed_values) == ["A", "B", "C"]
    large = lookup_domains(planted, {("parent", "name"): "NAME"}).collect()[0]
    assert len(large.allowed_values) == 100


def test_null_profile(planted):
    from sqlweave.sources.star import null_profile
    got = {(r.column_name, r.n_rows, r.n_nulls)
           for r in null_profile(planted, ["child"]).collect()}
    assert got == {("pid", 908, 3), ("flag", 908, 0)}


def test_lookup_domains_add_nothing_to_the_rows(spark, planted):
    """Several columns of a table, nulls, numbers and an empty domain; no row is copied per lookup column."""
    from sqlweave.sources.star import lookup_domains
    from sqlweave.sources.tables import Tables
    root = tempfile.mkdtemp(prefix="sqlweave-domains-")
    spark.createDataFrame([("x", 1, None), ("x", 1, None), (None, 2, None), ("y", None, None)],
                          "a string, b int, c string").write.parquet(os.path.join(root, "t.parquet"))
    found = lookup_domains(Tables(spark, root), {("t", "a"): "A", ("t", "b"): "B", ("t", "c"): "C"})
    assert {(r.table_name, r.column_name, r.lookup_type, tuple(r.allowed_values)) for r in found.collect()} == {
        ("t", "a", "A", ("x", "y")), ("t", "b", "B", ("1", "2")), ("t", "c", "C", ())}
    assert "Generate" not in found._jdf.queryExecution().toString()
