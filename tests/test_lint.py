"""Regex lint against the catalog and the two repairs."""


def _lint(spark, cat, sql):
    from sqlweave.operators.lint import lint_sql
    _, cols, fks = cat
    st = spark.createDataFrame([("demo", 1, sql)], "schema_id string, sql_id int, sql string")
    return sorted((r.kind, r.detail) for r in lint_sql(st, cols, fks).collect())


GOOD = ("SELECT v.vendor_name, SUM(o.order_amount) AS s FROM po_orders_all o "
        "JOIN po_vendors v ON o.vendor_id = v.vendor_id "
        "WHERE EXTRACT(YEAR FROM o.order_date) = 2024 AND o.approval_flag = 'it''s FROM x.y' "
        "GROUP BY v.vendor_name")


def test_gold_is_clean(spark, demo_catalog):
    assert _lint(spark, demo_catalog, GOOD) == []


def test_unknown_column(spark, demo_catalog):
    bad = GOOD.replace("v.vendor_name,", "v.vendor_nam,")
    assert _lint(spark, demo_catalog, bad) == [("unknown_column", "po_vendors.vendor_nam")]


def test_wrong_join_key(spark, demo_catalog):
    bad = GOOD.replace("o.vendor_id = v.vendor_id", "o.order_id = v.vendor_id")
    assert _lint(spark, demo_catalog, bad) == [
        ("join_wrong_key", "po_orders_all.order_id=po_vendors.vendor_id")]


def test_unknown_table_and_non_fk_join(spark, demo_catalog):
    bad = ("SELECT x.a FROM ghost_table x JOIN po_vendors v ON x.a = v.vendor_id "
           "JOIN gl_account_combos g ON g.account_combo_id = v.vendor_id")
    kinds = _lint(spark, demo_catalog, bad)
    assert ("unknown_table", "ghost_table") in kinds
    assert ("join_not_fk", "gl_account_combos with po_vendors") in kinds


def test_subquery_alias_and_extract_are_handled(spark, demo_catalog):
    sql = ("SELECT v.vendor_name FROM po_vendors v WHERE v.vendor_id IN "
           "(SELECT o.vendor_id FROM po_orders_all o WHERE EXTRACT(YEAR FROM o.order_date) = 2024)")
    assert _lint(spark, demo_catalog, sql) == []


def _repair(spark, cat, fn, question, sql):
    _, cols, _ = cat
    p = spark.createDataFrame([("demo", 1, question, sql)],
                              "schema_id string, sql_id int, question string, sql string")
    return fn(p, cols).collect()[0].sql_repaired


def test_flexfield_repair(spark, demo_catalog):
    from sqlweave.operators.lint import repair_flexfield
    sql = "SELECT g.segment5, SUM(l.amount) FROM po_order_lines_all l JOIN gl_account_combos g " \
          "ON l.account_combo_id = g.account_combo_id GROUP BY g.segment5"
    out = _repair(spark, demo_catalog, repair_flexfield, "spend by department", sql)
    assert out == sql.replace("segment5", "segment2")
    # no label in the question: unchanged
    assert _repair(spark, demo_catalog, repair_flexfield, "spend by thing", sql) == sql


def test_lookup_repair(spark, demo_catalog):
    from sqlweave.operators.lint import repair_lookup
    sql = "SELECT COUNT(o.order_id) FROM po_orders_all o WHERE o.order_type_code = 'PAID'"
    out = _repair(spark, demo_catalog, repair_lookup, "how many blanket orders", sql)
    assert out == sql.replace("'PAID'", "'BLANKET'")
    ok = sql.replace("'PAID'", "'STANDARD'")
    assert _repair(spark, demo_catalog, repair_lookup, "how many blanket orders", ok) == ok


def test_comma_join_function_in_on_and_garbage(spark, demo_catalog):
    assert ("unknown_table", "ghost") in _lint(spark, demo_catalog, "SELECT o.order_id FROM po_orders_all o, ghost g")
    bad = "SELECT o.order_id FROM po_orders_all o, po_vendors v WHERE v.vendor_zz = o.vendor_id"
    assert ("unknown_column", "po_vendors.vendor_zz") in _lint(spark, demo_catalog, bad)
    assert ("join_wrong_key", "po_orders_all.order_id=po_vendors.vendor_id") in _lint(
        spark, demo_catalog, "SELECT o.order_id FROM po_orders_all o JOIN po_vendors v "
                             "ON UPPER(v.vendor_name) = 'X' AND o.order_id = v.vendor_id")
    for text in ("hello there", "SELECT FROM po_vendors", "SELECT (v.vendor_id FROM po_vendors v", "DROP TABLE x"):
        assert "not_a_query" in {k for k, _ in _lint(spark, demo_catalog, text)}


def test_lookup_repair_touches_only_its_alias(spark, demo_catalog):
    from sqlweave.operators.lint import repair_lookup
    sql = ("SELECT po.vendor_id FROM po_orders_all o JOIN po_vendors po ON o.vendor_id = po.vendor_id "
           "WHERE o.order_type_code = 'ZZ' AND po.order_type_code = 'ZZ'")
    out = _repair(spark, demo_catalog, repair_lookup, "blanket orders", sql)
    assert out == sql.replace("o.order_type_code = 'ZZ' AND", "o.order_type_code = 'BLANKET' AND")
    one = "SELECT o.order_id FROM po_orders_all o WHERE o.approval_flag = 'ZZ'"
    assert _repair(spark, demo_catalog, repair_lookup, "any pending orders", one) == one
    assert _repair(spark, demo_catalog, repair_lookup, "orders with flag P", one) == one.replace("ZZ", "P")


def test_scopes_comments_and_reused_aliases(spark, demo_catalog):
    lint = lambda sql: _lint(spark, demo_catalog, sql)
    # the same alias names another table in each scope
    sql = ("SELECT x.vendor_name FROM po_vendors x WHERE x.vendor_id IN "
           "(SELECT x.vendor_id FROM po_orders_all x WHERE x.order_amount > 5) AND x.vendor_number = '7'")
    assert lint(sql) == []
    assert lint(sql.replace("x.vendor_number", "x.order_amount")) == [("unknown_column", "po_vendors.order_amount")]
    # an inner scope sees the outer aliases, not the other way round
    inner = ("SELECT v.vendor_name FROM po_vendors v WHERE EXISTS "
             "(SELECT 1 FROM po_orders_all o WHERE o.vendor_id = v.vendor_id AND o.order_amount > v.{})")
    assert lint(inner.format("vendor_id")) == []
    assert lint(inner.format("zz")) == [("unknown_column", "po_vendors.zz")]
    assert lint("SELECT v.vendor_name FROM po_vendors v WHERE v.vendor_id IN (SELECT o.vendor_id FROM po_orders_all o) "
                "AND o.zz = 1") == []  # o is unknown out there, and let pass
    # both sides of a union are apart
    assert lint("SELECT a.vendor_id FROM po_vendors a UNION ALL SELECT a.order_amount FROM po_orders_all a") == []
    assert lint("SELECT a.order_amount FROM po_vendors a UNION SELECT a.order_amount FROM po_orders_all a") == [
        ("unknown_column", "po_vendors.order_amount")]
    # comments and literals are no SQL
    assert lint("SELECT v.vendor_id -- FROM ghost g, v.zz\n FROM po_vendors v /* JOIN ghost ON v.q = g.r ( */ "
                "WHERE v.vendor_name = 'x -- FROM ghost ('") == []
    # common table expressions and derived tables have columns of their own
    assert lint("WITH big AS (SELECT o.vendor_id AS k FROM po_orders_all o), po2 AS (SELECT 1 AS z) "
                "SELECT b.k, po2.z FROM big b JOIN po2 ON b.k = po2.z") == []
    assert lint("SELECT d.k FROM (SELECT o.vendor_id AS k, o.zz FROM po_orders_all o) d JOIN po_vendors v "
                "ON d.k = v.vendor_id") == [("unknown_column", "po_orders_all.zz")]
    # a bracketed join is of the same scope
    assert lint("SELECT o.zz FROM (po_orders_all o JOIN po_vendors v ON o.vendor_id = v.vendor_id)") == [
        ("unknown_column", "po_orders_all.zz")]
    # functions with their own FROM
    assert lint("SELECT TRIM(BOTH 'x' FROM v.vendor_name), EXTRACT(DAY FROM v.created_on) FROM po_vendors v") == []
    assert lint("SELECT v.vendor_id FROM po_vendors AS v CROSS JOIN gl_account_combos, ghost WHERE v.q = 1") == [
        ("unknown_column", "po_vendors.q"), ("unknown_table", "ghost")]


def test_text_that_does_not_close_is_no_query(spark, demo_catalog):
    for text in ("SELECT v.vendor_id FROM po_vendors v WHERE v.vendor_name = 'open", "SELECT (1", "SELECT 1)(", "", "-- x",
                 "((SELECT", "SELECT"):
        assert [k for k, _ in _lint(spark, demo_catalog, text)] == ["not_a_query"], text
    for text in ("SELECT 1", "((SELECT v.vendor_id FROM po_vendors v))", "/* a */ SELECT 1 -- b"):
        assert _lint(spark, demo_catalog, text) == []


def test_statements_of_one_task_are_folded_by_all(spark):
    from sqlweave.operators.lint import parsed
    sql = "SELECT a.x FROM t a JOIN u b ON a.k = b.k WHERE a.y = 'FROM (' AND a.z IN (SELECT a.z FROM v a)"
    rows = spark.createDataFrame([("s", i, sql) for i in range(400)] + [("s", 400, None), (None, None, "('")],
                                 "schema_id string, sql_id long, sql string").coalesce(1)
    out = parsed(rows)
    assert len(out.inputFiles()) > 1 and out.count() == 402
    found = {r.sql_id: r.found for r in out.filter("sql_id in (0, 400)").collect()}
    assert [(e.pos, e.kind, e.name, e.tab, e.path) for e in found[0].events] == [
        (1, "ref", "a.x", None, [0]), (3, "table", "t", None, [0]), (4, "alias", "a", "t", [0]), (6, "table", "u", None, [0]),
        (7, "alias", "b", "u", [0]), (9, "pair", "a.k", "b.k", [0]), (11, "ref", "b.k", None, [0]), (13, "ref", "a.y", None, [0]),
        (17, "ref", "a.z", None, [0]), (21, "ref", "a.z", None, [0, 20]), (23, "table", "v", None, [0, 20]),
        (24, "alias", "a", "v", [0, 20])]
    assert found[400].events == [] and not found[400].bad
    assert out.filter("sql_id is null").first().found.bad
