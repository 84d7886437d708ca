"""Registered synthetic-data jobs: shadow tables as large as the real ones.

Row counts come from the driver's tables, so the generated work grows with
them; DuckDB twins repeat the hash formula row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlweave.operators.synth import catalog_layout, lcg_sql, salt_of, synth_table
from sqlweave.plans.catalog_jobs import EXPECTED_FKS
from sqlweave.sources import star
from sqlweave.sources.star import star_catalog


def _setup(t, tables):
    _, cols, fks = star_catalog(t)
    layout = catalog_layout(cols, fks)
    need = set(tables) | {c["fk_to"] for x in tables for c in layout[x]["columns"] if c["fk_to"]}
    n_rows = {x: t.get(x).count() for x in need}
    return layout, n_rows


def q_synth_rows(t):
    layout, n = _setup(t, ["orders"])
    return synth_table(t.spark, layout, "orders", n)


def q_synth_fk_orphans(t):
    """Synthetic lineitem and orders against the key columns of their synthetic parents."""
    children = ["lineitem", "orders"]
    layout, n = _setup(t, children)
    fks = {(r.from_table, r.from_column): r.to_column for r in star_catalog(t)[2].collect()}
    parts = []
    for child in children:
        df = synth_table(t.spark, layout, child, n)
        for c in layout[child]["columns"]:
            if not c["fk_to"]:
                continue
            key = fks[child, c["column_name"]]
            to = layout[c["fk_to"]]
            to = {**to, "columns": [x for x in to["columns"] if x["column_name"] == key]}
            parent = synth_table(t.spark, {c["fk_to"]: to}, c["fk_to"], n).select(F.col(key).alias("k")).distinct()
            kids = df.groupBy(F.col(c["column_name"]).alias("k")).agg(F.count(F.lit(1)).alias("c"))
            parts.append(kids.join(parent.withColumn("hit", F.lit(True)), "k", "left").agg(
                F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("k").isNotNull() & F.col("hit").isNull(), F.col("c"))),
                           F.lit(0)).alias("orphans")).select(
                F.lit(child).alias("from_table"), F.lit(c["column_name"]).alias("from_column"),
                F.lit(c["fk_to"]).alias("to_table"), "n_rows", "orphans"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {"synth_rows": q_synth_rows, "synth_fk_orphans": q_synth_fk_orphans}

_TP = {name: i for i, name in enumerate(star.CATALOG_TABLES, start=1)}


def _h(col_pos, k=0, table="orders"):
    return lcg_sql("id", salt_of(_TP[table], col_pos) + k)


_SYNTH_ORDERS = f"""
WITH ids AS (SELECT unnest(range(1, (SELECT COUNT(*) FROM orders) + 1)) AS id),
st AS (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS v FROM orders)
SELECT id AS o_orderkey,
       1 + {_h(2)} % (SELECT COUNT(*) FROM customer) AS o_custkey,
       (SELECT v FROM st)[1 + {_h(3)} % len((SELECT v FROM st))] AS o_orderstatus,
       CAST(10 + {_h(4)} % 99991 AS DOUBLE) AS o_totalprice,
       make_date(CAST([1996, 1997, 2000][1 + {_h(5)} % 3] AS INTEGER),
                 CAST(1 + {_h(5, 1)} % 12 AS INTEGER), CAST(1 + {_h(5, 2)} % 28 AS INTEGER))
         AS o_orderdate,
       'ORD-' || printf('%04d', id) AS o_orderpriority
FROM ids
"""


def _orphans_sql() -> str:
    parts = []
    pos = {t: {c: i for i, (c, _) in enumerate(star.STAR_COLUMNS[t], start=1)}
           for t in star.CATALOG_TABLES}
    for a, b, c, _ in EXPECTED_FKS:
        if a not in ("lineitem", "orders"):
            continue
        h = lcg_sql("id", salt_of(_TP[a], pos[a][b]))
        parts.append(
            f"SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, "
            f"COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE NOT (1 + {h} % (SELECT COUNT(*) FROM {c}) "
            f"BETWEEN 1 AND (SELECT COUNT(*) FROM {c}))) AS orphans "
            f"FROM (SELECT unnest(range(1, (SELECT COUNT(*) FROM {a}) + 1)) AS id)")
    return " UNION ALL ".join(parts)


SQL = {"synth_rows": _SYNTH_ORDERS, "synth_fk_orphans": _orphans_sql()}
