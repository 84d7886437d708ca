"""Spec enumeration and the corpus: validity, paraphrase invariants, splits, frames."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def built(small):
    from sqlweave.plans.corpus_jobs import corpus
    return corpus(small)


def test_every_spec_valid_and_every_level_present(built):
    _, _, _, specs, ex = built
    assert ex.filter(~F.col("valid")).count() == 0
    assert {r.level for r in specs.select("level").distinct().collect()} == {1, 2, 3, 4, 5}


def test_rendered_sql_passes_catalyst(small, built):
    from sqlweave.operators.compare import sql_gate
    small.register_views()
    rows = built[4].filter(F.col("schema_id") == "star0").select("sql").collect()
    bad = [r.sql for r in rows if not sql_gate(small.spark, r.sql)[0]]
    assert bad == []


def test_paraphrases_keep_sql_and_are_distinct(built):
    ex = built[4]
    rows = ex.select("question", "paraphrases", "sql").collect()
    assert all(len(set(r.paraphrases)) == len(r.paraphrases) for r in rows)
    texts = {p for r in rows for p in r.paraphrases}
    assert len(texts) > 60


def test_split_by_schema_is_disjoint(small, built):
    from sqlweave.operators.corpus import serialize_catalog, split_by_schema
    _, cols, fks, _, ex = built
    train, val = split_by_schema(ex, serialize_catalog(cols, fks), val_fraction=0.5)
    a = {r.schema_id for r in train.select("schema_id").distinct().collect()}
    b = {r.schema_id for r in val.select("schema_id").distinct().collect()}
    assert a and b and not (a & b)
    # val keeps only the plain question
    assert val.groupBy("schema_id", "spec_id").count().filter("count > 1").count() == 0


def test_sample_runs_like_shape(small, built):
    from sqlweave.operators.compare import execution_match
    small.register_views()
    rows = built[4].filter((F.col("schema_id") == "star0") & (F.col("shape") == "agg")).limit(3) \
        .select("sql").collect()
    for r in rows:
        assert execution_match(small.spark, r.sql, r.sql)["matched"]


def test_pad_batches(spark):
    from sqlweave.operators.corpus import pad_batches
    df = spark.createDataFrame([("s", i, 0, list(range(i + 1)), [1] * (i + 2), [2] * (i + 2), 9)
                                for i in range(10)],
                               "schema_id string, spec_id int, q_pos int, src array<int>, "
                               "tgt_in array<int>, labels array<int>, pad_id int")
    out = pad_batches(df, batch_size=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.batch_id, set()).add(len(r.src))
        assert len(r.src_keep) == len(r.src) and sum(r.src_keep) <= len(r.src)
    assert all(len(v) == 1 for v in by.values())


def test_paraphrase_hook(spark):
    from sqlweave.plans.render import paraphrase_hook
    df = spark.createDataFrame([("total sales",), ("boom",)], "question string")

    def fn(q, k):
        if q == "boom":
            raise RuntimeError("flaky")
        return ["  ", "sales overall", "sum of sales", "all sales", "x"]

    rows = {r.question: r.hook_paraphrases for r in paraphrase_hook(df, fn, k=2).collect()}
    assert rows == {"total sales": ["sales overall", "sum of sales"], "boom": []}
    off = paraphrase_hook(df).collect()
    assert all(r.hook_paraphrases == [] for r in off)


def test_ids_are_unique_without_facts(spark):
    from sqlweave.operators.specs import enumerate_specs
    schema = ("schema_id string, table_name string, table_pos int, col_pos int, column_name string, type string, "
              "nullable boolean, is_pk boolean, role string, business_label string, lookup_type string, allowed_values array<string>")
    cols = spark.createDataFrame([("s", "t", 1, 1, "t_id", "NUMBER", False, True, "id", None, None, []),
                                  ("s", "t", 1, 2, "t_name", "VARCHAR2", True, False, "name", None, None, [])], schema)
    tabs = spark.createDataFrame([("s", "t", 1, False)], "schema_id string, table_name string, table_pos int, is_multi_org boolean")
    fks = spark.createDataFrame([], "schema_id string, fk_pos long, from_table string, from_column string, "
                                    "to_table string, to_column string, declared boolean")
    rows = enumerate_specs(tabs, cols, fks, n_per_level=4).collect()
    assert len(rows) == 20 == len({r.spec_id for r in rows}) and {r.level for r in rows} == {1}


def test_fallback_group_is_drawn_from_lookups_then_codes(spark):
    from sqlweave.operators.specs import enumerate_specs
    schema = ("schema_id string, table_name string, table_pos int, col_pos int, column_name string, type string, "
              "nullable boolean, is_pk boolean, role string, business_label string, lookup_type string, allowed_values array<string>")
    base = lambda s: [(s, "t", 1, 1, "t_id", "NUMBER", False, True, "id", None, None, []),
                      (s, "t", 1, 2, "t_amount", "NUMBER", True, False, "amount", None, None, [])]
    code = lambda s, i: (s, "t", 1, 3 + i, f"c{i}_code", "VARCHAR2", True, False, "code", None, None, [])
    look = lambda s, i: (s, "t", 1, 6 + i, f"l{i}", "VARCHAR2", True, False, "lookup", None, "L", ["A", "B"])
    cols = spark.createDataFrame([*base("a"), *base("b"), *base("c"), *[code(s, i) for s in "bc" for i in range(3)],
                                  *[look("c", i) for i in range(2)]], schema)
    tabs = spark.createDataFrame([(s, "t", 1, False) for s in "abc"],
                                 "schema_id string, table_name string, table_pos int, is_multi_org boolean")
    fks = spark.createDataFrame([], "schema_id string, fk_pos long, from_table string, from_column string, "
                                    "to_table string, to_column string, declared boolean")
    rows = enumerate_specs(tabs, cols, fks, n_per_level=40, levels=(3,)).collect()
    got = {s: {r.group_col.col for r in rows if r.schema_id == s} for s in "abc"}
    assert got == {"a": {"t_id"}, "b": {"c0_code", "c1_code", "c2_code"}, "c": {"l0", "l1"}}


def test_draws_spread(spark):
    from sqlweave.operators.specs import DRAWS, draw
    d = spark.range(6000).withColumnRenamed("id", "spec_id")
    for name in list(DRAWS)[::4]:
        n = [r["count"] for r in d.groupBy(draw(name, 6)).count().collect()]
        assert len(n) == 6 and min(n) > 800


def test_one_catalog_uses_many_tasks(spark, built):
    from sqlweave.operators.specs import enumerate_specs
    tabs, cols, fks, _, _ = built
    one = [df.filter("schema_id = 'star0'") for df in (tabs, cols, fks)]
    specs = enumerate_specs(*one, n_per_level=20_000)
    rows = specs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("spec_id").alias("d")).collect()
    assert sum(r.n for r in rows) == sum(r.d for r in rows) == 100_000
    assert len(rows) > 1 and max(r.n for r in rows) < 60_000
