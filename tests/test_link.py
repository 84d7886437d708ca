"""Schema linking: phrase weights, no-match fallback, module narrowing."""


def test_business_label_phrase_counts_four(spark, demo_catalog):
    from sqlweave.operators.link import link_score
    _, cols, _ = demo_catalog
    q = spark.createDataFrame([(1, "spend by product line")], "qid int, text string")
    s = {r.table_name: r.score for r in link_score(q, cols).collect()}
    # 'product' + 'line' words (2) + the phrase as label and as business label (2 + 2)
    assert s["gl_account_combos"] == 6


def test_no_match_links_everything(spark, demo_catalog):
    from sqlweave.operators.link import link_tables
    tabs, cols, fks = demo_catalog
    q = spark.createDataFrame([(1, "zzz qqq")], "qid int, text string")
    r = link_tables(q, tabs, cols, fks).collect()[0]
    assert r.link_all and r.tables is None


def test_small_module_kept_whole_and_distractors_dropped(spark, demo_catalog):
    from sqlweave.operators.catalog import merge_catalogs
    from sqlweave.operators.link import link_tables
    tabs, cols, fks = demo_catalog
    mt, mc, mf = merge_catalogs([("a_", tabs, cols, fks)])
    q = spark.createDataFrame([(1, "total order amount per vendor")], "qid int, text string")
    r = link_tables(q, mt, mc, mf).collect()[0]
    assert not r.link_all
    assert r.tables == sorted(["a_po_vendors", "a_po_orders_all", "a_po_order_lines_all",
                               "a_gl_account_combos"])


def test_large_module_narrowed(spark):
    from sqlweave.operators.link import link_tables
    # chain t0 - t1 - ... - t11 (12 tables, one module > 8)
    names = [f"t{i}" for i in range(12)]
    tabs = spark.createDataFrame([(n, i + 1, False, "s") for i, n in enumerate(names)],
                                 "table_name string, table_pos int, is_multi_org boolean, "
                                 "schema_id string")
    cols = spark.createDataFrame(
        [("s", n, i + 1, 1, f"{n}_id", "NUMBER", False, True, "id", None, None, [])
         for i, n in enumerate(names)] +
        [("s", "t5", 6, 2, "widget_name", "VARCHAR2", True, False, "name", None, None, [])],
        "schema_id string, table_name string, table_pos int, col_pos int, column_name string, "
        "type string, nullable boolean, is_pk boolean, role string, business_label string, "
        "lookup_type string, allowed_values array<string>")
    fks = spark.createDataFrame(
        [(i + 1, names[i + 1], f"{names[i]}_id", names[i], f"{names[i]}_id", False, "s")
         for i in range(11)],
        "fk_pos long, from_table string, from_column string, to_table string, to_column string, "
        "declared boolean, schema_id string")
    q = spark.createDataFrame([(1, "list every widget")], "qid int, text string")
    r = link_tables(q, tabs, cols, fks).collect()[0]
    assert r.tables == ["t4", "t5", "t6"]


def test_catalogs_in_one_frame_stay_apart(spark, demo_catalog):
    from pyspark.sql import functions as F
    from sqlweave.operators.link import link_tables
    from sqlweave.operators.paths import bfs, components, join_paths, reachable
    tabs, cols, fks = (df.drop("schema_id").withColumn("schema_id", F.explode(F.array(F.lit("x"), F.lit("y"))))
                       for df in demo_catalog)
    fks = fks.filter("schema_id = 'x' or from_table != 'po_orders_all'")  # y lacks orders -> vendors
    comp = {(r.schema_id, r.table_name): r.component for r in components(tabs, fks).collect()}
    assert comp["x", "po_vendors"] == "gl_account_combos" and comp["y", "po_vendors"] == "po_vendors"
    src = spark.createDataFrame([("x", "po_vendors"), ("y", "po_vendors")], "schema_id string, src string")
    assert {r.schema_id: r.n for r in bfs(fks, src).groupBy("schema_id").agg(F.count("*").alias("n")).collect()} == {"x": 4, "y": 1}
    assert reachable(fks, src).filter("schema_id = 'y'").count() == 0
    req = src.withColumn("dst", F.lit("gl_account_combos"))
    assert {r.schema_id: r.path is None for r in join_paths(fks, req).collect()} == {"x": False, "y": True}
    q = spark.createDataFrame([("x", 1, "vendor number"), ("y", 1, "vendor number")], "schema_id string, qid int, text string")
    got = {r.schema_id: r.tables for r in link_tables(q, tabs, cols, fks).collect()}
    assert len(got["x"]) == 4 and got["y"] == ["po_vendors"]


def test_phrases_are_found_like_contains(spark):
    import random
    from sqlweave.operators.link import phrase_hits
    r = random.Random(4)
    text = lambda n: "".join(r.choice("ab c\n") for _ in range(n))
    phrases = sorted({p for p in (text(r.randint(2, 9)) for _ in range(120)) if " " in p} | {" ", "a ", "  b"})
    qs = [(i, text(r.randint(0, 60)).upper() if i % 2 else text(40)) for i in range(60)] + [(99, None)]
    q = spark.createDataFrame([("s", *x) for x in qs], "schema_id string, qid int, text string")
    p = spark.createDataFrame([("s", x) for x in phrases], "schema_id string, phrase string")
    want = {(i, x) for i, t in qs for x in phrases if t is not None and x in t.lower()}
    assert {(x.qid, x.phrase) for x in phrase_hits(q, p).collect()} == want and len(want) > 100


def test_linking_at_catalog_size(small):
    from pyspark.sql import functions as F
    from sqlweave.operators.paths import components
    from sqlweave.plans.module_jobs import linked_corpus, module_catalogs, q_link_report
    from sqlweave.sources.modules import N_MODULES
    tabs, _, fks = module_catalogs(small)
    assert tabs.select("schema_id").distinct().count() == N_MODULES >= 40
    sizes = components(tabs, fks).groupBy("schema_id", "component").count()
    assert sizes.filter("count > 8").count() == N_MODULES // 3
    r = q_link_report(small).first()
    assert r.n_questions == N_MODULES * 50 and r.recall >= 0.9 and r.mean_tables_after <= 12
    assert r.mean_tables_before == tabs.count() and r.mean_tokens_after * 20 < r.mean_tokens_before
    assert r.within_limit == 1.0
    # large modules are narrowed: some of their questions get fewer than their ten tables
    large = linked_corpus(small)[0].filter(F.regexp_extract("qid", r"m(\d+)", 1).cast("int") % 3 == 0)
    assert large.filter("size(tables) < 10").count() > 0


def test_module_names_are_disjoint(small):
    from pyspark.sql import functions as F
    from sqlweave.plans.module_jobs import module_catalogs
    tabs, cols, fks = module_catalogs(small)
    assert tabs.select("table_name").distinct().count() == tabs.count()
    shared = cols.groupBy("column_name").agg(F.countDistinct("schema_id").alias("n")).filter("n > 1")
    assert {r.column_name for r in shared.collect()} == {"org_id", "segment1", "segment2"}
    # FK ends are of one module
    ends = fks.join(tabs.select(F.col("schema_id").alias("s"), F.col("table_name").alias("to_table")), "to_table")
    assert ends.filter("s != schema_id").count() == 0 and ends.count() == fks.count()


def test_token_costs_add_up(small):
    from pyspark.sql import functions as F
    from sqlweave.functions.text import pretokens
    from sqlweave.operators.corpus import column_costs, serialize_catalog
    from sqlweave.plans.module_jobs import module_catalogs
    _, cols, fks = module_catalogs(small)
    n = F.size(F.filter(pretokens("schema_text"), lambda x: F.trim(x) != ""))
    whole = {r.schema_id: r.n for r in serialize_catalog(cols, fks).select("schema_id", n.alias("n")).collect()}
    costs = {r.schema_id: r.n for r in column_costs(cols, fks).groupBy("schema_id").agg(F.sum("tokens").alias("n")).collect()}
    assert {k: v + 1 for k, v in whole.items()} == costs  # one separator more than the text has
