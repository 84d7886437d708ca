"""Query shapes and registered jobs against DuckDB twins (the driver's gate, locally)."""

import pytest

from oracle_check import compare, duck

from conftest import SF_SMALL

SHAPE_KEYS = ["scan_table", "l1_list", "agg_group", "agg_sum", "agg_avg", "agg_max", "agg_min",
              "agg_count", "agg_global", "join_fk_1hop", "join_fk_2hop", "having", "top_n",
              "above_average", "semi_join", "filter_subquery", "win_rank", "win_dense_rank",
              "win_row_number", "win_rank_global", "filter_year", "filter_org", "filter_lookup",
              "filter_compare", "filter_and", "literal", "date_part", "row_cap"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", SHAPE_KEYS)
def test_shape_matches_duckdb(spark, con, key):
    import __spark_entry__ as E
    msg = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF_SMALL)
    assert ": OK " in msg, msg


@pytest.mark.parametrize("key", ["extract_catalog", "infer_fks", "join_path", "components",
                                 "pretokens", "content_tokens", "link_score", "link_tables",
                                 "synth_rows", "multiset_equal"])
def test_job_matches_duckdb(spark, con, key):
    import __spark_entry__ as E
    msg = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF_SMALL)
    assert ": OK " in msg, msg


def test_entry_returns_rows(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["n_name", "sum_o_totalprice"]
    assert df.count() > 0


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_year_filter_reaches_parquet(spark, small):
    from sqlweave.operators.shapes import l1_list
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = l1_list(small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "LessThan(o_orderdate" in plan


def test_registry_imports_without_spark():
    import subprocess
    import sys
    code = ("import __spark_entry__ as E; q = E.queries(); s = E.oracle_sql(); "
            "assert set(s) <= set(q); print(len(q))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         cwd=__import__("os").path.dirname(__import__("os").path.dirname(
                             __import__("os").path.abspath(__file__))), timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
