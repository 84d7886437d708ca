"""Leakage-free splits, splits of different catalogs, keys and foreign keys found in data, repair by an index."""

from pyspark.sql import functions as F


def test_no_text_on_two_sides(small):
    from sqlweave.operators.corpus import normalised, serialize_catalog, split_by_query
    from sqlweave.plans.corpus_jobs import corpus
    _, cols, fks, _, ex = corpus(small)
    train, val = split_by_query(ex, serialize_catalog(cols, fks))
    for c in ("sql", "question"):
        side = lambda df: df.select(normalised(F.col(c)).alias("k")).distinct()
        assert side(train).join(side(val), "k").count() == 0
    # val keeps the plain question only, but no paraphrase of it is left in train either
    n = {s: df.select("schema_id", "spec_id").distinct().count() for s, df in (("train", train), ("val", val))}
    assert sum(n.values()) == ex.count() and 0.1 < n["val"] / ex.count() < 0.4


def test_groups_over_shared_keys(spark):
    from sqlweave.operators.corpus import leakage_groups
    rows = [("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("e", None), ("a", "x"), ("f", "w")]
    rows += [(f"h{i}", "hot") for i in range(200)]
    got = {r.item: r.group for r in leakage_groups(spark.createDataFrame(rows, "item string, key string")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "h"} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    assert {v for k, v in got.items() if k[0] == "h"} == {"h0"} and len(got) == 206


def test_catalogs_on_both_sides_share_few_names(small):
    from sqlweave.plans.module_jobs import catalog_names, q_vocab_overlap, schema_split
    split = schema_split(small)
    n = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert 0 < n["val"] <= 0.25 * sum(n.values()) and n["val"] >= 8
    assert split.groupBy("component").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    names = catalog_names(small).join(split, "schema_id")
    both = names.groupBy("name").agg(F.countDistinct("split").alias("n")).filter("n = 2")
    assert {r.name for r in both.collect()} == {"org_id", "segment1", "segment2"}
    r = q_vocab_overlap(small).first()
    assert r.n_shared <= 5 < r.n_val_names < r.n_train_names


def test_keys_and_links_come_out_of_the_data(spark, tmp_path):
    from sqlweave.sources.discover import discover
    from sqlweave.sources.tables import Tables
    make = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make([(i, f"n{i % 7}", i % 3) for i in range(50)], "c_custkey long, c_name string, c_nationkey int", "customer")
    make([(i, 1 if i % 3 else i % 50, None if i % 5 else i % 50) for i in range(600)],
         "o_orderkey long, o_custkey long, o_orderstatus long", "orders")
    make([(i % 4, i % 3) for i in range(9)], "n_nationkey int, n_regionkey int", "nation")
    make([], "r_regionkey int, r_name string", "region")
    make([(None, "x" * 100), (None, "x" * 100)], "p_partkey long, p_name string", "part")
    facts, fks = discover(Tables(spark, str(tmp_path)), ("customer", "orders", "nation", "region", "part"))
    keys = {(r.table_name, r.column_name) for r in facts.filter("is_key").collect()}
    assert keys == {("customer", "c_custkey"), ("orders", "o_orderkey")}
    assert [(r.from_column, r.to_table) for r in fks.collect()] == [("o_custkey", "customer")]
    part = {r.column_name: (r.n_rows, r.n_nulls, r.n_values) for r in facts.filter("table_name = 'part'").collect()}
    assert part == {"p_partkey": (2, 2, 0), "p_name": (2, 0, 1)}


def test_many_columns_fill_several_words(spark):
    from sqlweave.sources.discover import inclusions
    # column i holds the values 0..i, so i is included in every later one
    values = spark.createDataFrame([(i, f"n:{v}", 1) for i in range(130) for v in range(i + 1)], "col_no int, v string, n long")
    got = {(r.col_no, r.in_no) for r in inclusions(values, 130).collect()}
    assert got == {(i, j) for i in range(130) for j in range(i + 1, 130)}


def test_numbers_stay_numbers_and_sets_are_hashed(spark, tmp_path):
    from sqlweave.sources.discover import discover, discovered_columns, inclusions, value_table
    from sqlweave.sources.tables import Tables
    spark.createDataFrame([(1, "1"), (2, None), (None, "1")], "part_id long, code string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "1"), (2, "x"), (3, "1")], "part_id int, code string").write.parquet(str(tmp_path / "orders.parquet"))
    t, names = Tables(spark, str(tmp_path)), ("part", "orders")
    columns = discovered_columns(t, names)
    numbers, texts = value_table(t, columns, "n"), value_table(t, columns, "s")
    assert dict(numbers.dtypes)["v"] == "bigint" and dict(texts.dtypes)["v"] == "string"
    assert {(r.col_no, r.v, r.n) for r in numbers.collect()} == {(0, 1, 1), (0, 2, 1), (0, None, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)}
    assert {(r.col_no, r.v, r.n) for r in texts.collect()} == {(1, "1", 2), (1, None, 1), (3, "1", 2), (3, "x", 1)}
    # a list of columns per value would be aggregated by sorting all values
    plan = inclusions(numbers, 4)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert {(r.col_no, r.in_no) for r in inclusions(numbers, 4).collect()} == {(0, 2)}
    assert [tuple(r)[1:] for r in discover(t, names)[1].collect()] == [("part", "part_id", "orders", "part_id")]


def test_declared_keys_do_not_depend_on_the_readers_order(spark, demo_catalog):
    from sqlweave.operators.catalog import infer_fks
    _, cols, _ = demo_catalog
    rows = [("po_orders_all", "vendor_id", "po_vendors", "vendor_id"), ("po_order_lines_all", "order_id", "po_orders_all", "order_id"),
            ("po_orders_all", "vendor_id", "gl_account_combos", "account_combo_id")]
    got = [[(r.from_table, r.to_table, r.fk_pos) for r in infer_fks(cols, spark.createDataFrame(
        x, "from_table string, from_column string, to_table string, to_column string")).orderBy("fk_pos").collect()]
        for x in (rows, rows[::-1])]
    assert got[0] == got[1] and [x[:2] for x in got[0][:3]] == [
        ("po_orders_all", "gl_account_combos"), ("po_orders_all", "po_vendors"), ("po_order_lines_all", "po_orders_all")]


def test_one_canonical_name_per_table(spark):
    from sqlweave.operators.catalog import catalog_synonyms
    tables = spark.createDataFrame([("PO", "T1"), ("PO", "T2"), ("PO", "T3")], "owner string, table_name string")
    syn = spark.createDataFrame([("ZED", "PO", "T1"), ("ALPHA", "PO", "T1"), ("T2", "PO", "T2"), ("A2", "PO", "T2")],
                                "synonym_name string, table_owner string, table_name string")
    got = {r.table_name: (r.canonical, r.table_pos) for r in catalog_synonyms(tables, syn).collect()}
    assert got == {"T1": ("alpha", 1), "T2": ("t2", 3), "T3": ("po.t3", 2)}


def test_no_constraint_views_gives_no_declared_keys(spark):
    from sqlweave.sources.dictionary import dictionary_catalog
    f = {"installs": spark.createDataFrame([(1, "I")], "oracle_id int, status string"),
         "users": spark.createDataFrame([(1, "PO")], "oracle_id int, oracle_username string"),
         "tables": spark.createDataFrame([("PO", "T")], "owner string, table_name string"),
         "synonyms": spark.createDataFrame([], "synonym_name string, table_owner string, table_name string"),
         "columns": spark.createDataFrame([("PO", "T", "T_ID", "NUMBER", "N", 1)], "owner string, table_name string, "
                                          "column_name string, data_type string, nullable string, column_id int")}
    _, cols, fks = dictionary_catalog(f)
    assert not cols.first().is_pk and fks.count() == 0


def test_repair_from_a_large_domain(spark, demo_catalog):
    from sqlweave.operators.lint import repair_lookup
    _, cols, _ = demo_catalog
    domain = spark.range(1_000_000).select(
        F.lit("demo").alias("schema_id"), F.lit("po_orders_all").alias("table_name"), F.lit("order_type_code").alias("column_name"),
        F.concat(F.lit("KIND "), F.col("id").cast("string")).alias("value"))
    sql = "SELECT o.order_id FROM po_orders_all o WHERE o.order_type_code = 'X'"
    rows = [("demo", 1, "orders of kind 77123, please", sql), ("demo", 2, "kind 5 or kind 6", sql),
            ("demo", 3, "kind 9", sql.replace("'X'", "'KIND 8'")), ("demo", 4, "kind 1000000", sql), ("demo", 5, "kind-7", sql)]
    q = spark.createDataFrame(rows, "schema_id string, sql_id int, question string, sql string")
    got = {r.sql_id: r.sql_repaired for r in repair_lookup(q, cols, domains=domain).collect()}
    assert got == {1: sql.replace("'X'", "'KIND 77123'"), 2: sql, 3: rows[2][3], 4: sql, 5: sql}


def test_wrong_repairs_are_reported_apart(spark):
    from sqlweave.operators.compare import repair_report
    rows = spark.createDataFrame([(False, True, True), (False, False, True), (True, True, False), (False, False, False)],
                                 "matched_before boolean, matched_after boolean, changed boolean")
    r = repair_report(rows).first()
    assert (r.n, r.match_before, r.match_after, r.right_repairs, r.wrong_repairs) == (4, 0.25, 0.5, 1, 1)
