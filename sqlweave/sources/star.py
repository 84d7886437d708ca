"""The driver's tables as a catalog source.

Parquet declares no keys, flexfield labels or lookup domains, so those come
from the stand-in configuration below; everything else is read: column names
and types from the parquet schemas, nullability and lookup domains from the
data itself (a whole-table profile, one aggregate pass per table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlweave.operators.catalog import RoleRules, extract_catalog, tables_and_fks
from sqlweave.session import ensure_checkpoint_dir
from sqlweave.session import materialize

# -- fixed values of the stand-in configuration -----------------------------------
CATALOG_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                  "documents", "labels", "events")
PRIMARY_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",),
    "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "documents": ("doc_id",), "events": ("event_id",),
}
FLEX_LABELS = {("part", "p_brand"): "brand", ("part", "p_type"): "product line"}
LOOKUPS = {
    ("orders", "o_orderstatus"): "ORDER_STATUS",
    ("lineitem", "l_returnflag"): "RETURN_FLAG",
    ("lineitem", "l_linestatus"): "LINE_STATUS",
    ("customer", "c_mktsegment"): "MARKET_SEGMENT",
    ("events", "event_type"): "EVENT_TYPE",
}
ORG_COLUMNS = ("l_linenumber",)
# Expected columns (name, raw dictionary type) of the catalog tables; the job
# reads the real schemas, this list feeds the independent DuckDB twins.
STAR_COLUMNS = {
    "region": (("r_regionkey", "INTEGER"), ("r_name", "VARCHAR2")),
    "nation": (("n_nationkey", "INTEGER"), ("n_name", "VARCHAR2"), ("n_regionkey", "INTEGER")),
    "customer": (("c_custkey", "NUMBER"), ("c_name", "VARCHAR2"), ("c_nationkey", "INTEGER"),
                 ("c_acctbal", "FLOAT"), ("c_mktsegment", "VARCHAR2")),
    "supplier": (("s_suppkey", "NUMBER"), ("s_name", "VARCHAR2"), ("s_nationkey", "INTEGER"),
                 ("s_acctbal", "FLOAT")),
    "part": (("p_partkey", "NUMBER"), ("p_name", "VARCHAR2"), ("p_brand", "VARCHAR2"),
             ("p_type", "VARCHAR2"), ("p_size", "INTEGER"), ("p_retailprice", "FLOAT")),
    "orders": (("o_orderkey", "NUMBER"), ("o_custkey", "NUMBER"), ("o_orderstatus", "VARCHAR2"),
               ("o_totalprice", "FLOAT"), ("o_orderdate", "TIMESTAMP(6)"),
               ("o_orderpriority", "VARCHAR2")),
    "lineitem": (("l_orderkey", "NUMBER"), ("l_partkey", "NUMBER"), ("l_suppkey", "NUMBER"),
                 ("l_linenumber", "INTEGER"), ("l_quantity", "FLOAT"),
                 ("l_extendedprice", "FLOAT"), ("l_discount", "FLOAT"), ("l_tax", "FLOAT"),
                 ("l_returnflag", "VARCHAR2"), ("l_linestatus", "VARCHAR2"),
                 ("l_shipdate", "TIMESTAMP(6)")),
    "documents": (("doc_id", "NUMBER"), ("text", "VARCHAR2"), ("lang", "VARCHAR2"),
                  ("source", "VARCHAR2"), ("n_chars", "NUMBER")),
    "labels": (("doc_id", "NUMBER"), ("quality", "INTEGER"), ("toxic", "INTEGER")),
    "events": (("event_id", "NUMBER"), ("ts", "TIMESTAMP(6)"), ("user_id", "NUMBER"),
               ("event_type", "VARCHAR2"), ("value", "FLOAT"), ("props", "VARCHAR2")),
}
# ---------------------------------------------------------------------------------


def raw_type(dt: T.DataType) -> str:
    """Spark type -> raw dictionary type name, as a relational dictionary spells it."""
    if isinstance(dt, (T.LongType, T.DecimalType)):
        return "NUMBER"
    if isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
        return "INTEGER"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "FLOAT"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP(6)"
    if isinstance(dt, T.DateType):
        return "DATE"
    if isinstance(dt, T.StringType):
        return "VARCHAR2"
    return dt.simpleString().upper()


def raw_columns(t, names=CATALOG_TABLES) -> DataFrame:
    """Dictionary rows (table_name, table_pos, col_pos, column_name, data_type) from schemas."""
    rows = []
    for tp, name in enumerate(names, start=1):
        for cp, f in enumerate(t.get(name).schema.fields, start=1):
            rows.append((name, tp, cp, f.name, raw_type(f.dataType)))
    return t.spark.createDataFrame(
        rows, "table_name string, table_pos int, col_pos int, column_name string, data_type string")


def null_profile(t, names=CATALOG_TABLES) -> DataFrame:
    """(table_name, column_name, n_rows, n_nulls) from one aggregate pass per table."""
    parts = []
    for name in names:
        df = t.get(name)
        cols = df.columns
        agg = df.agg(F.count(F.lit(1)).alias("__n"),
                     *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(f"__z{i}")
                       for i, c in enumerate(cols)])
        stack = ", ".join(f"'{c}', `__z{i}`" for i, c in enumerate(cols))
        parts.append(agg.select(F.lit(name).alias("table_name"), F.col("__n").alias("n_rows"),
                                F.expr(f"stack({len(cols)}, {stack}) AS (column_name, n_nulls)")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup_domains(t, lookups=LOOKUPS) -> DataFrame:
    """(table_name, column_name, lookup_type, allowed_values) from the data.

    Each column is read by itself and its values are made distinct before anything is
    added to them (map-side combined, so a low cardinality column shuffles a handful
    of rows per task). Every lookup column named by the caller gets its whole domain.
    """
    parts = []
    for (tbl, col), ltype in lookups.items():
        v = t.get(tbl).select(F.col(col).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
        parts.append(v.select(F.lit(tbl).alias("table_name"), F.lit(col).alias("column_name"),
                              F.lit(ltype).alias("lookup_type"), "v"))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    domains = (values.groupBy("table_name", "column_name", "lookup_type")
               .agg(F.sort_array(F.collect_list("v")).alias("allowed_values")))
    keys = t.spark.createDataFrame([(a, b, c) for (a, b), c in lookups.items()],
                                   "table_name string, column_name string, lookup_type string")
    return (keys.join(domains, ["table_name", "column_name", "lookup_type"], "left")
            .withColumn("allowed_values",
                        F.coalesce("allowed_values", F.array().cast("array<string>"))))


def star_catalog(t, schema_id: str = "star"):
    """(cat_tables, cat_columns, cat_fks) of the driver's tables, built once per
    session and folder (see :mod:`sqlweave.memo`)."""
    from sqlweave.memo import memo
    return memo(t.spark, t.root, f"star_catalog:{schema_id}", lambda: _star_catalog(t, schema_id))


def _star_catalog(t, schema_id: str):
    """(cat_tables, cat_columns, cat_fks) of the driver's tables.

    The profiled dictionary (the only part that scans data) is checkpointed
    once, so the metadata joins after it never rescan the tables.
    """
    spark = t.spark
    ensure_checkpoint_dir(spark)
    cols = (raw_columns(t)
            .join(null_profile(t).select("table_name", "column_name",
                                         (F.col("n_nulls") > 0).alias("nullable")),
                  ["table_name", "column_name"], "left")
            .withColumn("nullable", F.coalesce("nullable", F.lit(True))))
    cols = materialize(cols, "profiled_columns")
    domains = materialize(lookup_domains(t), "lookup_domains")
    pks = spark.createDataFrame([(tb, c) for tb, cs in PRIMARY_KEYS.items() for c in cs],
                                "table_name string, column_name string")
    flex = spark.createDataFrame([(a, b, c) for (a, b), c in FLEX_LABELS.items()],
                                 "table_name string, column_name string, business_label string")
    rules = RoleRules(org_columns=ORG_COLUMNS)
    _, cat_cols, _ = extract_catalog(cols, pks, flex, domains, None, rules, schema_id)
    # metadata-sized results, written once so every consumer reads them cheaply
    cat_cols = materialize(cat_cols, "cat_columns")
    tabs, fks = tables_and_fks(cat_cols, rules, schema_id)
    return materialize(tabs, "cat_tables"), cat_cols, materialize(fks, "cat_fks")


def fk_orphans(t, cat_fks: DataFrame) -> DataFrame:
    """Per FK: child rows and rows whose non-null key has no parent.

    One plan for all FKs: each child table is scanned once with its FK columns
    stacked as (fk_id, key); keys are counted per (fk_id, key) with map-side
    combining (a hot FK value is one row before the shuffle); parent keys are
    stacked the same way and de-duplicated; one join decides the orphans. The
    FK list is catalog metadata (a few rows) read to build the stacks.
    """
    fks = cat_fks.select("from_table", "from_column", "to_table", "to_column").collect()
    integral = all(isinstance(t.get(f.from_table).schema[f.from_column].dataType,
                              (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for f in fks)
    ktype = "bigint" if integral else "string"

    def stacked(side_table, cols_by_table):
        parts = []
        for tbl, items in cols_by_table.items():
            pairs = ", ".join(f"{i}, CAST(`{c}` AS {ktype})" for i, c in items)
            parts.append(t.get(tbl).select(F.expr(f"stack({len(items)}, {pairs}) AS (fk_id, k)")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    child_cols: dict = {}
    parent_cols: dict = {}
    for i, f in enumerate(fks):
        child_cols.setdefault(f.from_table, []).append((i, f.from_column))
        parent_cols.setdefault(f.to_table, []).append((i, f.to_column))
    per_key = stacked("child", child_cols).groupBy("fk_id", "k").agg(F.count(F.lit(1)).alias("c"))
    parents = (stacked("parent", parent_cols).filter(F.col("k").isNotNull()).distinct()
               .withColumn("hit", F.lit(True)))
    counts = per_key.join(parents, ["fk_id", "k"], "left").groupBy("fk_id").agg(
        F.sum("c").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull() & F.col("hit").isNull(), F.col("c"))),
                   F.lit(0)).alias("orphans"))
    meta = t.spark.createDataFrame(
        [(i, f.from_table, f.from_column, f.to_table, f.to_column) for i, f in enumerate(fks)],
        "fk_id int, from_table string, from_column string, to_table string, to_column string")
    return meta.join(counts, "fk_id").drop("fk_id")
