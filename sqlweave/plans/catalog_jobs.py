"""Registered catalog jobs over the driver's tables, with DuckDB twins.

The twins restate the dictionary (expected columns and raw types) as a VALUES
list and redo the rules in SQL: type folding, role order, FK targets are
written independently; nullability, lookup domains, row counts and FK orphans
are computed from the data in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlweave.functions.columns import sql_literal
from sqlweave.operators.catalog import (AMOUNT_HINTS, CODE_SUFFIXES, NAME_SUFFIXES, QTY_HINTS,
                                        catalog_summary, columns_by_role)
from sqlweave.sources import star
from sqlweave.sources.star import fk_orphans, null_profile, star_catalog


def _csv(col):
    return F.array_join(col, ",")


def q_extract_catalog(t):
    _, cols, _ = star_catalog(t)
    return cols.select("table_name", "table_pos", "col_pos", "column_name", "type", "nullable",
                       "is_pk", "role", "business_label", "lookup_type",
                       _csv("allowed_values").alias("allowed_values"))


def q_norm_type(t):
    _, cols, _ = star_catalog(t)
    raw = star.raw_columns(t).select("table_name", "column_name", "data_type")
    return cols.join(raw, ["table_name", "column_name"]).select(
        "table_name", "column_name", "data_type", "type")


def q_infer_role(t):
    _, cols, _ = star_catalog(t)
    return cols.select("table_name", "column_name", "role")


def q_columns_by_role(t):
    _, cols, _ = star_catalog(t)
    ref = F.concat_ws(".", "table_name", "column_name")
    return (columns_by_role(cols).groupBy("role")
            .agg(F.count("column_name").alias("n_columns"),
                 _csv(F.sort_array(F.collect_list(ref))).alias("columns")))


def q_infer_fks(t):
    _, _, fks = star_catalog(t)
    orphans = fk_orphans(t, fks)
    key = ["from_table", "from_column", "to_table", "to_column"]
    return fks.join(orphans, key).select(*key, "declared", "n_rows", "orphans")


def q_catalog_summary(t):
    _, cols, fks = star_catalog(t)
    rows = null_profile(t).groupBy("table_name").agg(F.max("n_rows").alias("n_rows"))
    return catalog_summary(cols, fks).join(rows, "table_name").select(
        "table_name", "n_rows", "n_columns", "n_labelled", "n_fk_out", "n_fk_in")


def q_catalog_flex_lookups(t):
    _, cols, _ = star_catalog(t)
    return (cols.filter(F.col("role").isin("lookup", "flexfield_segment"))
            .select("table_name", "column_name", "role", "business_label", "lookup_type",
                    F.size("allowed_values").cast("long").alias("n_values"),
                    _csv("allowed_values").alias("allowed_values")))


QUERIES = {
    "extract_catalog": q_extract_catalog,
    "norm_type": q_norm_type,
    "infer_role": q_infer_role,
    "columns_by_role": q_columns_by_role,
    "infer_fks": q_infer_fks,
    "catalog_summary": q_catalog_summary,
    "catalog_flex_lookups": q_catalog_flex_lookups,
}


# -- DuckDB twins --------------------------------------------------------------------
# Foreign keys the rules must find on the driver's tables (stated, not derived).
EXPECTED_FKS = (
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


def _dict_values() -> str:
    rows = []
    for tp, tbl in enumerate(star.CATALOG_TABLES, start=1):
        for cp, (col, raw) in enumerate(star.STAR_COLUMNS[tbl], start=1):
            is_pk = "TRUE" if col in star.PRIMARY_KEYS.get(tbl, ()) else "FALSE"
            lbl = star.FLEX_LABELS.get((tbl, col))
            lt = star.LOOKUPS.get((tbl, col))
            rows.append(f"('{tbl}', {tp}, {cp}, '{col}', '{raw}', {is_pk}, "
                        f"{sql_literal(lbl) if lbl else 'NULL'}, {sql_literal(lt) if lt else 'NULL'})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(table_name, table_pos, col_pos, "
            "column_name, data_type, is_pk, business_label, lookup_type)")


def _any(fn: str, col: str, words) -> str:
    return "(" + " OR ".join(f"{fn}({col}, '{w}')" for w in words) + ")"


def _nulls_sql() -> str:
    parts = []
    for tbl in star.CATALOG_TABLES:
        for col, _ in star.STAR_COLUMNS[tbl]:
            parts.append(f"SELECT '{tbl}' AS table_name, '{col}' AS column_name, "
                         f"COUNT(*) - COUNT({col}) AS n_nulls, COUNT(*) AS n_rows FROM {tbl}")
    return " UNION ALL ".join(parts)


def _domains_sql() -> str:
    parts = []
    for (tbl, col), _ in star.LOOKUPS.items():
        v = f"CAST({col} AS VARCHAR)"
        parts.append(f"SELECT '{tbl}' AS table_name, '{col}' AS column_name, "
                     f"COUNT(DISTINCT {v}) AS n_values, "
                     f"string_agg(DISTINCT {v}, ',' ORDER BY {v}) AS vals FROM {tbl}")
    return " UNION ALL ".join(parts)


def _catalog_cte() -> str:
    org = ", ".join(f"'{c}'" for c in star.ORG_COLUMNS)
    name_sfx = _any("ends_with", "column_name", NAME_SUFFIXES)
    return f"""
WITH d AS ({_dict_values()}),
typed AS (
  SELECT *, CASE WHEN upper(data_type) IN ('NUMBER', 'INTEGER', 'FLOAT', 'DECIMAL') THEN 'NUMBER'
                 WHEN upper(data_type) LIKE 'DATE%' OR upper(data_type) LIKE 'TIMESTAMP%' THEN 'DATE'
                 ELSE 'VARCHAR2' END AS type
  FROM d),
roled AS (
  SELECT *, CASE
      WHEN business_label IS NOT NULL THEN 'flexfield_segment'
      WHEN lookup_type IS NOT NULL THEN 'lookup'
      WHEN column_name IN ({org}) THEN 'org_id'
      WHEN is_pk OR ends_with(column_name, '_id') OR ends_with(column_name, 'key') THEN 'id'
      WHEN type = 'DATE' THEN 'date'
      WHEN type = 'NUMBER' AND {_any('contains', 'column_name', QTY_HINTS)} THEN 'quantity'
      WHEN type = 'NUMBER' AND {_any('contains', 'column_name', AMOUNT_HINTS)} THEN 'amount'
      WHEN column_name = 'name' OR {name_sfx} THEN 'name'
      WHEN {_any('ends_with', 'column_name', CODE_SUFFIXES)} THEN 'code'
    END AS role
  FROM typed),
nulls AS ({_nulls_sql()}),
doms AS ({_domains_sql()}),
cols AS (
  SELECT r.table_name, r.table_pos, r.col_pos, r.column_name, r.data_type, r.type,
         n.n_nulls > 0 AS nullable, r.is_pk, r.role, r.business_label,
         CASE WHEN r.business_label IS NULL THEN r.lookup_type END AS lookup_type,
         CASE WHEN r.role = 'lookup' THEN coalesce(dm.vals, '') ELSE '' END AS allowed_values,
         CASE WHEN r.role = 'lookup' THEN coalesce(dm.n_values, 0) ELSE 0 END AS n_values,
         n.n_rows
  FROM roled r
  JOIN nulls n ON n.table_name = r.table_name AND n.column_name = r.column_name
  LEFT JOIN doms dm ON dm.table_name = r.table_name AND dm.column_name = r.column_name),
fks(from_table, from_column, to_table, to_column) AS (
  SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in EXPECTED_FKS)})
    AS f(from_table, from_column, to_table, to_column))
"""


def _orphans_sql() -> str:
    parts = []
    for a, b, c, d in EXPECTED_FKS:
        parts.append(
            f"SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, "
            f"'{d}' AS to_column, FALSE AS declared, COUNT(*) AS n_rows, "
            f"COUNT(*) FILTER (WHERE x.{b} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {c} y WHERE y.{d} = x.{b})) AS orphans FROM {a} x")
    return " UNION ALL ".join(parts)


SQL = {
    "extract_catalog": _catalog_cte() + """
SELECT table_name, table_pos, col_pos, column_name, type, nullable, is_pk, role, business_label,
       lookup_type, allowed_values FROM cols""",
    "norm_type": _catalog_cte() + "SELECT table_name, column_name, data_type, type FROM cols",
    "infer_role": _catalog_cte() + "SELECT table_name, column_name, role FROM cols",
    "columns_by_role": _catalog_cte() + """
SELECT role, COUNT(*) AS n_columns,
       string_agg(table_name || '.' || column_name, ',' ORDER BY table_name || '.' || column_name)
         AS columns
FROM cols WHERE role IS NOT NULL GROUP BY role""",
    "infer_fks": _orphans_sql(),
    "catalog_summary": _catalog_cte() + """
SELECT c.table_name, MAX(c.n_rows) AS n_rows, COUNT(*) AS n_columns,
       COUNT(c.business_label) AS n_labelled,
       (SELECT COUNT(*) FROM fks f WHERE f.from_table = c.table_name) AS n_fk_out,
       (SELECT COUNT(*) FROM fks f WHERE f.to_table = c.table_name) AS n_fk_in
FROM cols c GROUP BY c.table_name""",
    "catalog_flex_lookups": _catalog_cte() + """
SELECT table_name, column_name, role, business_label, lookup_type, n_values, allowed_values
FROM cols WHERE role IN ('lookup', 'flexfield_segment')""",
}


def q_schema_save(t):
    """One JSON document per catalog with every annotation kept."""
    from sqlweave.operators.catalog import schema_save
    tabs, cols, fks = star_catalog(t)
    docs = schema_save(tabs, cols, fks)
    tables = F.from_json(F.get_json_object("json", "$.tables"), "array<string>")
    fk_list = F.from_json(F.get_json_object("json", "$.foreign_keys"), "array<string>")
    return docs.select("schema_id", F.length("json").alias("json_chars"),
                       F.size(tables).alias("n_tables"), F.size(fk_list).alias("n_fks"))


def q_schema_load(t):
    """Round trip: columns lost or changed by save + load (expected none)."""
    from sqlweave.operators.catalog import schema_load, schema_save
    tabs, cols, fks = star_catalog(t)
    _, c2, f2 = schema_load(schema_save(tabs, cols, fks))
    key = ["table_name", "column_name", "type", "nullable", "is_pk", "role", "business_label",
           "lookup_type"]
    a = cols.select(*key, F.array_join("allowed_values", ",").alias("v"))
    b = c2.select(*key, F.array_join("allowed_values", ",").alias("v"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).groupBy().agg(
        F.count(F.lit(1)).alias("n_changed")).withColumn("n_fks", F.lit(f2.count()))


QUERIES.update({"schema_save": q_schema_save, "schema_load": q_schema_load})
# nothing is lost or changed on the way; the FKs are those of the catalog
SQL["schema_load"] = _catalog_cte() + "SELECT 0 AS n_changed, COUNT(*) AS n_fks FROM fks"
