"""Registered join-graph jobs over the inferred FKs of the driver's tables.

DuckDB twins walk simple paths with a recursive CTE (bounded depth) and keep,
per (source, node), the fewest hops and then the smallest list of FK
positions, the order a breadth-first search in FK order yields.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlweave.operators import paths
from sqlweave.plans.catalog_jobs import EXPECTED_FKS, _catalog_cte
from sqlweave.sources.star import star_catalog


def _facts(cols):
    return cols.filter(F.col("role") == "amount").select("schema_id", "table_name").distinct()


def q_join_path(t):
    tabs, cols, fks = star_catalog(t)
    facts = _facts(cols).select("schema_id", F.col("table_name").alias("src"))
    wanted = facts.join(tabs.select("schema_id", F.col("table_name").alias("dst")), "schema_id")
    found = paths.join_paths(fks, wanted).filter(F.col("path").isNotNull())
    return found.select("src", "dst", "hops", paths.render_path(F.col("path")).alias("path"))


def q_reachable(t):
    tabs, _, fks = star_catalog(t)
    src = tabs.select("schema_id", F.col("table_name").alias("src"))
    return paths.reachable(fks, src, max_hops=2).drop("schema_id")


def q_components(t):
    tabs, _, fks = star_catalog(t)
    return paths.components(tabs, fks).drop("schema_id")


def q_neighbors(t):
    _, _, fks = star_catalog(t)
    return paths.neighbors(fks).drop("schema_id")


def q_fk_between(t):
    _, _, fks = star_catalog(t)
    return paths.fk_between(fks).drop("schema_id")


def q_join_tree(t):
    tabs, cols, fks = star_catalog(t)
    per = tabs.groupBy("schema_id").agg(
        F.sort_array(F.collect_list(F.struct("table_pos", "table_name"))).alias("ts"))
    req = _facts(cols).join(per, "schema_id").select(
        "schema_id", F.col("table_name").alias("tree_id"), F.col("table_name").alias("anchor"),
        F.filter(F.transform("ts", lambda x: x["table_name"]),
                 lambda n: n != F.col("table_name")).alias("targets"))
    tree = paths.join_tree(fks, req)
    return tree.select("tree_id", "from_table", "from_column", "to_table", "to_column",
                       "unreachable")


QUERIES = {
    "join_path": q_join_path,
    "reachable": q_reachable,
    "components": q_components,
    "neighbors": q_neighbors,
    "fk_between": q_fk_between,
    "join_tree": q_join_tree,
}


def _walk_cte(sources_sql: str, max_hops: int = 12) -> str:
    fk_rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in EXPECTED_FKS)
    return _catalog_cte() + f""",
fk AS (
  SELECT f.*, c.table_pos * 1000000 + c.col_pos AS ord,
         f.from_table || '.' || f.from_column || '=' || f.to_table || '.' || f.to_column AS txt
  FROM (VALUES {fk_rows}) AS f(from_table, from_column, to_table, to_column)
  JOIN cols c ON c.table_name = f.from_table AND c.column_name = f.from_column),
e AS (SELECT from_table AS a, to_table AS b, ord, txt FROM fk
      UNION ALL SELECT to_table AS a, from_table AS b, ord, txt FROM fk),
srcs AS ({sources_sql}),
walk AS (SELECT * FROM (
  WITH RECURSIVE w(src, node, hops, path, txts, seen) AS (
    SELECT src, src, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), [src] FROM srcs
    UNION ALL
    SELECT w.src, e.b, w.hops + 1, list_append(w.path, e.ord), list_append(w.txts, e.txt),
           list_append(w.seen, e.b)
    FROM w JOIN e ON e.a = w.node
    WHERE NOT list_contains(w.seen, e.b) AND w.hops < {max_hops})
  SELECT * FROM w)),
best AS (
  SELECT src, node, hops, path, txts FROM (
    SELECT *, row_number() OVER (PARTITION BY src, node ORDER BY hops, path) AS rn FROM walk)
  WHERE rn = 1)
"""


_FACTS = "SELECT DISTINCT table_name AS src FROM cols WHERE role = 'amount'"
_ALL = "SELECT DISTINCT table_name AS src FROM cols"

SQL = {
    "join_path": _walk_cte(_FACTS) + """
SELECT src, node AS dst, hops, array_to_string(txts, ' > ') AS path FROM best""",
    "reachable": _walk_cte(_ALL, 2) + """
SELECT src, node AS table_name, hops FROM best WHERE hops > 0""",
    "components": _walk_cte(_ALL) + """
SELECT src AS table_name, MIN(node) AS component FROM best GROUP BY src""",
    "neighbors": _walk_cte(_ALL, 1) + """
SELECT a AS table_name, b AS neighbor, COUNT(*) AS n_fks FROM e GROUP BY a, b""",
    "fk_between": _walk_cte(_ALL, 1) + """
SELECT t1, t2, from_table, from_column, to_table, to_column FROM (
  SELECT least(from_table, to_table) AS t1, greatest(from_table, to_table) AS t2, *,
         row_number() OVER (PARTITION BY least(from_table, to_table),
                            greatest(from_table, to_table) ORDER BY ord) AS rn FROM fk)
WHERE rn = 1""",
    "join_tree": _walk_cte(_FACTS) + """,
tables AS (SELECT DISTINCT table_name, table_pos FROM cols),
req AS (SELECT s.src AS anchor, t.table_name AS dst, t.table_pos
        FROM srcs s JOIN tables t ON t.table_name <> s.src),
unr AS (SELECT r.anchor, arg_min(r.dst, r.table_pos) AS unreachable FROM req r
        LEFT JOIN best b ON b.src = r.anchor AND b.node = r.dst
        WHERE b.node IS NULL GROUP BY r.anchor),
edges AS (SELECT DISTINCT b.src AS anchor, f.from_table, f.from_column, f.to_table, f.to_column
          FROM best b, unnest(b.path) AS u(o) JOIN fk f ON f.ord = u.o
          WHERE b.src <> b.node)
SELECT ed.anchor AS tree_id, ed.from_table, ed.from_column, ed.to_table, ed.to_column,
       u.unreachable
FROM edges ed LEFT JOIN unr u ON u.anchor = ed.anchor""",
}
