"""Catalog rules on our purchasing fixture and raw dictionary rows."""

from pyspark.sql import functions as F


def _roles(cols):
    return {(r.table_name, r.column_name): r.role for r in cols.collect()}


def test_roles_in_rule_order(demo_catalog):
    _, cols, _ = demo_catalog
    r = _roles(cols)
    assert r[("gl_account_combos", "segment2")] == "flexfield_segment"
    assert r[("po_orders_all", "order_type_code")] == "lookup"      # lookup beats code suffix
    assert r[("po_orders_all", "org_id")] == "org_id"               # org beats *_id
    assert r[("po_orders_all", "vendor_id")] == "id"
    assert r[("po_orders_all", "order_date")] == "date"
    assert r[("po_orders_all", "order_amount")] == "amount"
    assert r[("po_vendors", "vendor_name")] == "name"
    assert r[("po_vendors", "vendor_number")] == "code"
    assert r[("po_order_lines_all", "line_num")] == "code"
    assert r[("po_order_lines_all", "amount")] == "amount"


def test_inferred_fks_never_org(demo_catalog):
    _, _, fks = demo_catalog
    got = {(r.from_table, r.from_column, r.to_table, r.to_column) for r in fks.collect()}
    assert got == {
        ("po_orders_all", "vendor_id", "po_vendors", "vendor_id"),
        ("po_order_lines_all", "order_id", "po_orders_all", "order_id"),
        ("po_order_lines_all", "account_combo_id", "gl_account_combos", "account_combo_id"),
    }


def test_multi_org_needs_suffix_and_org_column(demo_catalog):
    tabs, _, _ = demo_catalog
    m = {r.table_name: r.is_multi_org for r in tabs.collect()}
    assert m == {"po_vendors": False, "po_orders_all": True, "po_order_lines_all": True,
                 "gl_account_combos": False}


def test_fk_hint_has_no_fallback(spark, demo_catalog):
    from sqlweave.operators.catalog import RoleRules, infer_fks
    _, cols, _ = demo_catalog
    empty = spark.createDataFrame([], "from_table string, from_column string, to_table string, "
                                      "to_column string")
    rules = RoleRules(fk_hints={"vendor_id": ("ap_missing", "vendor_id")})
    got = {(r.from_table, r.from_column) for r in infer_fks(cols, empty, rules).collect()}
    assert ("po_orders_all", "vendor_id") not in got


def test_star_catalog_fks_and_domains(small):
    from sqlweave.plans.catalog_jobs import EXPECTED_FKS
    from sqlweave.sources.star import star_catalog
    _, cols, fks = star_catalog(small)
    got = {(r.from_table, r.from_column, r.to_table, r.to_column) for r in fks.collect()}
    assert got == set(EXPECTED_FKS)
    dom = {r.column_name: list(r.allowed_values)
           for r in cols.filter(F.col("role") == "lookup").collect()}
    assert dom["o_orderstatus"] == ["F", "O", "P"]
    assert dom["l_linestatus"] == ["F", "O"]


def test_dictionary_scope_synonyms_skips(spark):
    from sqlweave.operators.catalog import (catalog_columns, catalog_scope, catalog_synonyms,
                                            catalog_tables)
    installs = spark.createDataFrame([(1, "I"), (2, "S"), (3, "N")], "oracle_id int, status string")
    users = spark.createDataFrame([(1, "AP"), (2, "GL"), (3, "XX")],
                                  "oracle_id int, oracle_username string")
    scope = catalog_scope(installs, users, extra_owners=["cust'; drop--"])
    owners = {r.owner for r in scope.collect()}
    assert owners == {"AP", "GL", "CUSTDROP"}
    tables = spark.createDataFrame(
        [("AP", "AP_INVOICES_ALL"), ("AP", "AP_CHECKS"), ("GL", "GL_LEDGERS"),
         ("GL", "BIN$ABC"), ("GL", "GL_LEDGERS_BAK"), ("XX", "XX_T")],
        "owner string, table_name string")
    kept = catalog_tables(tables, scope)
    assert {r.table_name for r in kept.collect()} == {"AP_INVOICES_ALL", "AP_CHECKS", "GL_LEDGERS"}
    syn = spark.createDataFrame([("AP_INVOICES_ALL", "AP", "AP_INVOICES_ALL"),
                                 ("GL_BOOKS", "GL", "GL_LEDGERS")],
                                "synonym_name string, table_owner string, table_name string")
    canon = catalog_synonyms(kept, syn)
    names = {r.canonical for r in canon.collect()}
    assert names == {"ap_invoices_all", "gl_books", "ap.ap_checks"}
    raw = spark.createDataFrame(
        [("AP", "AP_CHECKS", "CHECK_ID", "NUMBER", "N", 1),
         ("AP", "AP_CHECKS", "AMOUNT", "NUMBER", "Y", 2),
         ("GL", "GL_LEDGERS_BAK", "LEDGER_ID", "NUMBER", "N", 1)],
        "owner string, table_name string, column_name string, data_type string, "
        "nullable string, column_id int")
    c = catalog_columns(raw, canon).collect()
    assert [(r.table_name, r.column_name, r.nullable) for r in sorted(c, key=lambda r: r.col_pos)] \
        == [("ap.ap_checks", "check_id", False), ("ap.ap_checks", "amount", True)]


def test_declared_fks_match_by_position(spark):
    from sqlweave.operators.catalog import catalog_declared_fks, catalog_pks
    canon = spark.createDataFrame([("AP", "INV", "inv", 1), ("AP", "LINES", "lines", 2)],
                                  "owner string, table_name string, canonical string, table_pos int")
    cons = spark.createDataFrame(
        [("AP", "INV_PK", "INV", "P", None, None), ("AP", "LINES_FK", "LINES", "R", "AP", "INV_PK")],
        "owner string, constraint_name string, table_name string, constraint_type string, "
        "r_owner string, r_constraint_name string")
    cc = spark.createDataFrame([("AP", "INV_PK", "INV_ID", 1), ("AP", "LINES_FK", "INV_ID", 1)],
                               "owner string, constraint_name string, column_name string, "
                               "position int")
    assert [(r.table_name, r.column_name) for r in catalog_pks(cons, cc, canon).collect()] == \
        [("inv", "inv_id")]
    fk = catalog_declared_fks(cons, cc, canon).collect()
    assert [(r.from_table, r.from_column, r.to_table, r.to_column) for r in fk] == \
        [("lines", "inv_id", "inv", "inv_id")]


def test_schema_json_round_trip(demo_catalog):
    from sqlweave.operators.catalog import schema_load, schema_save
    tabs, cols, fks = demo_catalog
    docs = schema_save(tabs, cols, fks)
    t2, c2, f2 = schema_load(docs)
    key = ["table_name", "column_name", "role", "business_label", "lookup_type", "is_pk"]
    assert sorted(map(tuple, c2.select(*key).collect()), key=repr) == \
        sorted(map(tuple, cols.select(*key).collect()), key=repr)
    assert f2.count() == fks.count() and t2.count() == tabs.count()
