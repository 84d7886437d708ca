"""Keys, foreign keys and the dictionary readers over all tables, found in the data.

The twins compute uniqueness with COUNT(DISTINCT) and every inclusion with NOT EXISTS, column by
column; they share nothing with the jobs but the list of columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlweave.operators import catalog
from sqlweave.sources.dictionary import dictionary_catalog
from sqlweave.sources.discover import OWNER, discover, dictionary_frames
from sqlweave.sources.star import STAR_COLUMNS
from sqlweave.sources.tables import TABLE_NAMES


def q_column_facts(t):
    facts, _ = discover(t)
    return facts.filter("n_rows is not null").select("table_name", "column_name", "n_rows", "n_nulls", "n_values",
                                                     "is_unique", "is_key")


def q_discover_fks(t):
    _, fks = discover(t)
    return fks.drop("from_no")


def _canon(t):
    f = dictionary_frames(t)
    kept = catalog.catalog_tables(f["tables"], catalog.catalog_scope(f["installs"], f["users"]))
    return f, kept, catalog.catalog_synonyms(kept, f["synonyms"])


def q_catalog_scope(t):
    f = dictionary_frames(t)
    scope = catalog.catalog_scope(f["installs"], f["users"])
    return f["tables"].join(scope, "owner", "left_semi").groupBy("owner").agg(F.count(F.lit(1)).alias("n_tables"))


def q_catalog_tables(t):
    return _canon(t)[1].select("owner", "table_name")


def q_catalog_synonyms(t):
    return _canon(t)[2].select("owner", "table_name", "canonical", "table_pos")


def q_catalog_columns(t):
    f, _, canon = _canon(t)
    return catalog.catalog_columns(f["columns"], canon)


def q_catalog_pks(t):
    f, _, canon = _canon(t)
    return catalog.catalog_pks(f["constraints"], f["cons_columns"], canon)


def q_catalog_declared_fks(t):
    f, _, canon = _canon(t)
    return catalog.catalog_declared_fks(f["constraints"], f["cons_columns"], canon)


def q_dictionary_catalog(t):
    """The catalog that the dictionary rows give: per table its columns, keys and FKs."""
    _, cols, fks = dictionary_catalog(dictionary_frames(t))
    keys = cols.groupBy("table_name").agg(F.max(F.when(F.col("is_pk"), F.col("column_name"))).alias("pk"))
    return catalog.catalog_summary(cols, fks).join(keys, "table_name").select(
        "table_name", "pk", "n_columns", "n_fk_out", "n_fk_in")


QUERIES = {
    "column_facts": q_column_facts, "discover_fks": q_discover_fks, "catalog_scope": q_catalog_scope,
    "catalog_tables": q_catalog_tables, "catalog_synonyms": q_catalog_synonyms, "catalog_columns": q_catalog_columns,
    "catalog_pks": q_catalog_pks, "catalog_declared_fks": q_catalog_declared_fks,
    "dictionary_catalog": q_dictionary_catalog,
}

# -- DuckDB twins: the columns as TESTDATA and the schemas have them -------------------------
ALL_COLUMNS = STAR_COLUMNS | {
    "embeddings": (("vec_id", "NUMBER"), ("embedding", "ARRAY<FLOAT>"), ("label", "INTEGER")),
    "pages": (("page_id", "NUMBER"), ("url", "VARCHAR2"), ("html", "VARCHAR2")),
    "benchmark": (("item_id", "NUMBER"), ("text", "VARCHAR2")),
    "conversations": (("conv_id", "NUMBER"), ("turn", "NUMBER"), ("role", "VARCHAR2"), ("text", "VARCHAR2")),
}


def _columns():
    """(table, position, column, raw type, kind) of every column, in order."""
    for name in TABLE_NAMES:
        for i, (col, raw) in enumerate(ALL_COLUMNS[name], start=1):
            yield name, i, col, raw, {"NUMBER": "n", "INTEGER": "n", "VARCHAR2": "s"}.get(raw)


def _facts_cte() -> str:
    parts = [f"SELECT '{tb}' AS table_name, {TABLE_NAMES.index(tb)} AS table_pos, {i} AS col_pos, '{c}' AS column_name, "
             f"COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_nulls, COUNT(DISTINCT {c}) AS n_values, "
             f"COUNT(*) = COUNT(DISTINCT {c}) AS is_unique FROM {tb}" for tb, i, c, _, kind in _columns() if kind]
    return f"""
WITH facts AS ({' UNION ALL '.join(parts)}),
keys AS (SELECT *, is_unique AND col_pos = MIN(col_pos) FILTER (WHERE is_unique) OVER (PARTITION BY table_name)
                AS is_key FROM facts)"""


def _fks_cte() -> str:
    cols = [x for x in _columns() if x[4]]
    bare = lambda c: c[2:] if len(c) > 1 and c[1] == "_" else c
    parts = [f"SELECT '{a}' AS from_table, '{x}' AS from_column, '{b}' AS to_table, '{y}' AS to_column WHERE NOT EXISTS "
             f"(SELECT 1 FROM {a} p WHERE p.{x} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} q WHERE q.{y} = p.{x})) "
             f"AND EXISTS (SELECT 1 FROM {a} p WHERE p.{x} IS NOT NULL)"
             for a, _, x, _, k in cols for b, _, y, _, m in cols if a != b and k == m and bare(x) == bare(y)]
    return _facts_cte() + f""",
inside AS ({' UNION ALL '.join(parts)}),
fks AS (SELECT i.* FROM inside i JOIN keys k ON k.table_name = i.to_table AND k.column_name = i.to_column AND k.is_key)"""


def _names() -> str:
    return ", ".join(f"('{n}', {i})" for i, n in enumerate(sorted(TABLE_NAMES), start=1))


_NAMES = f"SELECT * FROM (VALUES {_names()}) AS v(canonical, table_pos)"
_ALL = ", ".join(f"('{tb}', {i}, '{c}', '{raw}')" for tb, i, c, raw, _ in _columns())

SQL = {
    "column_facts": _facts_cte() + """
SELECT table_name, column_name, n_rows, n_nulls, n_values, is_unique, is_key FROM keys""",
    "discover_fks": _fks_cte() + " SELECT * FROM fks",
    "catalog_scope": f"SELECT '{OWNER}' AS owner, {len(TABLE_NAMES)} AS n_tables",
    "catalog_tables": f"SELECT '{OWNER}' AS owner, upper(canonical) AS table_name FROM ({_NAMES})",
    "catalog_synonyms": f"SELECT '{OWNER}' AS owner, upper(canonical) AS table_name, canonical, table_pos FROM ({_NAMES})",
    "catalog_columns": _facts_cte() + f"""
SELECT c.table_name, n.table_pos, c.col_pos, c.column_name, c.data_type, coalesce(f.n_nulls, 1) > 0 AS nullable
FROM (VALUES {_ALL}) AS c(table_name, col_pos, column_name, data_type)
JOIN ({_NAMES}) n ON n.canonical = c.table_name
LEFT JOIN facts f ON f.table_name = c.table_name AND f.column_name = c.column_name""",
    "catalog_pks": _facts_cte() + " SELECT table_name, column_name FROM keys WHERE is_key",
    "catalog_declared_fks": _fks_cte() + " SELECT from_table, from_column, to_table, to_column FROM fks",
    "dictionary_catalog": _fks_cte() + f"""
SELECT n.canonical AS table_name,
       (SELECT MAX(column_name) FROM keys k WHERE k.is_key AND k.table_name = n.canonical) AS pk,
       (SELECT COUNT(*) FROM (VALUES {_ALL}) AS c(tb, i, c, r) WHERE tb = n.canonical) AS n_columns,
       (SELECT COUNT(*) FROM fks f WHERE f.from_table = n.canonical) AS n_fk_out,
       (SELECT COUNT(*) FROM fks f WHERE f.to_table = n.canonical) AS n_fk_in
FROM ({_NAMES}) n""",
}
