import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("sqlweave-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from sqlweave.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def small(spark):
    from sqlweave.sources.tables import Tables
    return Tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def demo_catalog(spark):
    """Our purchasing fixture: four tables, no declared FKs, three to infer."""
    from sqlweave.operators.catalog import RoleRules, extract_catalog
    cols = [
        ("po_vendors", 1, 1, "vendor_id", "NUMBER", False),
        ("po_vendors", 1, 2, "vendor_name", "VARCHAR2", True),
        ("po_vendors", 1, 3, "vendor_number", "VARCHAR2", True),
        ("po_vendors", 1, 4, "created_on", "DATE", True),
        ("po_orders_all", 2, 1, "order_id", "NUMBER", False),
        ("po_orders_all", 2, 2, "vendor_id", "NUMBER", True),
        ("po_orders_all", 2, 3, "org_id", "NUMBER", True),
        ("po_orders_all", 2, 4, "order_num", "VARCHAR2", True),
        ("po_orders_all", 2, 5, "order_date", "DATE", True),
        ("po_orders_all", 2, 6, "order_amount", "NUMBER", True),
        ("po_orders_all", 2, 7, "order_type_code", "VARCHAR2", True),
        ("po_orders_all", 2, 8, "approval_flag", "VARCHAR2", True),
        ("po_order_lines_all", 3, 1, "line_id", "NUMBER", False),
        ("po_order_lines_all", 3, 2, "order_id", "NUMBER", True),
        ("po_order_lines_all", 3, 3, "line_num", "NUMBER", True),
        ("po_order_lines_all", 3, 4, "amount", "NUMBER", True),
        ("po_order_lines_all", 3, 5, "account_combo_id", "NUMBER", True),
        ("po_order_lines_all", 3, 6, "org_id", "NUMBER", True),
        ("gl_account_combos", 4, 1, "account_combo_id", "NUMBER", False),
    ] + [("gl_account_combos", 4, i + 1, f"segment{i}", "VARCHAR2", True) for i in range(1, 6)]
    columns = spark.createDataFrame(cols, "table_name string, table_pos int, col_pos int, "
                                          "column_name string, data_type string, nullable boolean")
    pks = spark.createDataFrame([("po_vendors", "vendor_id"), ("po_orders_all", "order_id"),
                                 ("po_order_lines_all", "line_id"),
                                 ("gl_account_combos", "account_combo_id")],
                                "table_name string, column_name string")
    labels = ["business unit", "department", "ledger account", "product line", "partner"]
    flex = spark.createDataFrame([("gl_account_combos", f"segment{i + 1}", lab)
                                  for i, lab in enumerate(labels)],
                                 "table_name string, column_name string, business_label string")
    lookups = spark.createDataFrame(
        [("po_orders_all", "order_type_code", "ORDER TYPE", ["BLANKET", "STANDARD", "CONTRACT"]),
         ("po_orders_all", "approval_flag", "APPROVAL", ["Y", "N", "P"])],
        "table_name string, column_name string, lookup_type string, allowed_values array<string>")
    return extract_catalog(columns, pks, flex, lookups, None, RoleRules(), schema_id="demo")
