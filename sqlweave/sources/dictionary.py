"""Raw dictionary rows over JDBC (the swappable catalog source).

Any provider of these DataFrames works: the dictionary views of a live
relational database read with ``spark.read.jdbc``, parquet extracts, or test
fixtures. ``dictionary_catalog`` turns them into catalog tables. A live read
cannot be exercised in this repository (no database may be started here).
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from sqlweave.operators.catalog import (RoleRules, catalog_columns, catalog_declared_fks,
                                        catalog_pks, catalog_scope, catalog_synonyms,
                                        catalog_tables, extract_catalog)

# Dictionary queries (public dictionary views); scope filtering is done by joins.
DICTIONARY_SQL = {
    "installs": "SELECT oracle_id, status FROM fnd_product_installations",
    "users": "SELECT oracle_id, oracle_username FROM fnd_oracle_userid",
    "tables": "SELECT owner, table_name FROM all_tables",
    "synonyms": ("SELECT synonym_name, table_owner, table_name FROM all_synonyms "
                 "WHERE owner = 'APPS'"),
    "columns": ("SELECT owner, table_name, column_name, data_type, nullable, column_id "
                "FROM all_tab_columns"),
    "constraints": ("SELECT owner, constraint_name, table_name, constraint_type, r_owner, "
                    "r_constraint_name FROM all_constraints WHERE constraint_type IN ('P', 'R')"),
    "cons_columns": "SELECT owner, constraint_name, column_name, position FROM all_cons_columns",
}


def read_dictionary(spark: SparkSession, url: str, properties: dict) -> dict[str, DataFrame]:
    """One DataFrame per dictionary query, read in bulk (not one call per table).

    The constraint views are left out where the database refuses them.
    """
    out = {}
    for k, q in DICTIONARY_SQL.items():
        try:
            out[k] = spark.read.jdbc(url, f"({q}) d", properties=properties)
        except PySparkException:
            if k not in ("constraints", "cons_columns"):
                raise
    return out


def dictionary_catalog(frames: dict[str, DataFrame], extra_owners=(), flex: DataFrame | None = None,
                       lookups: DataFrame | None = None, rules: RoleRules | None = None,
                       schema_id: str = "catalog"):
    """Scope -> tables -> canonical names -> columns, keys, declared FKs -> catalog.

    Where the constraint views aren't among the frames (they may not be readable), there are no
    declared keys and foreign keys, and foreign keys are inferred from names alone.
    """
    scope = catalog_scope(frames["installs"], frames["users"], extra_owners)
    kept = catalog_tables(frames["tables"], scope)
    canon = catalog_synonyms(kept, frames["synonyms"])
    cols = catalog_columns(frames["columns"], canon)
    declared = None
    pks = cols.select("table_name", "column_name").limit(0)
    if "constraints" in frames and "cons_columns" in frames:
        pks = catalog_pks(frames["constraints"], frames["cons_columns"], canon)
        declared = catalog_declared_fks(frames["constraints"], frames["cons_columns"], canon)
    return extract_catalog(cols, pks, flex, lookups, declared, rules, schema_id)
