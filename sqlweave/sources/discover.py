"""Keys and foreign keys found in the tables themselves.

Every scalar column of whole numbers or text is stacked as (column, value), numbers and texts apart, and
counted once per distinct pair, so a value that fills a third of a table is one row before the shuffle.
From these two tables come both kinds of evidence:

* a column is a key if its values are all there and all different;
* grouping by value gives the set of columns that hold it, kept as bits in longs; the
  intersection of these sets over a column's values is the set of columns that include it.

A foreign key is a column included in the key of another table under the same name (or
the same name behind a one-letter prefix, as in ``o_custkey`` and ``c_custkey``). The results are
dictionary rows, as a relational database would list them, for ``dictionary_catalog``.

Nulls are no values; a column without values is no key and no foreign key. Long texts are
compared by their SHA-256. Empty tables have no keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlweave.session import write_table
from sqlweave.sources.star import raw_type
from sqlweave.sources.tables import TABLE_NAMES

OWNER = "DATA"
WORD = 62       # columns in one long of a column set
LONG_TEXT = 64  # characters from which a text stands by its hash


def discovered_columns(t, names=TABLE_NAMES) -> DataFrame:
    """(col_no, table_name, table_pos, col_pos, column_name, data_type, kind): kind n or s, null where not compared."""
    rows = []
    for tp, name in enumerate(names, start=1):
        for cp, f in enumerate(t.get(name).schema.fields, start=1):
            kind = ("n" if isinstance(f.dataType, T.IntegralType) else "s" if isinstance(f.dataType, T.StringType) else None)
            rows.append((len(rows), name, tp, cp, f.name, raw_type(f.dataType), kind))
    return t.spark.createDataFrame(rows, "col_no int, table_name string, table_pos int, col_pos int, column_name string, "
                                         "data_type string, kind string")


def value_table(t, columns: DataFrame, kind: str) -> DataFrame:
    """(col_no, v, n): how often each column of a kind holds each value; a null v counts the nulls.

    Whole numbers are compared as longs (n), texts as strings (s).
    """
    by_table: dict[str, list] = {}
    for r in columns.filter(F.col("kind") == kind).orderBy("col_no").collect():  # metadata: one row a column
        value = f"CAST(`{r.column_name}` AS {'BIGINT' if kind == 'n' else 'STRING'})"
        if kind == "s":
            value = f"IF(length({value}) < {LONG_TEXT}, {value}, sha2({value}, 256))"
        by_table.setdefault(r.table_name, []).append(f"{r.col_no}, {value}")
    parts = [t.get(name).select(F.expr(f"stack({len(items)}, {', '.join(items)}) AS (col_no, v)"))
             for name, items in by_table.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy("col_no", "v").agg(F.count(F.lit(1)).alias("n"))


def column_facts(values: DataFrame) -> DataFrame:
    """(col_no, n_rows, n_nulls, n_values, is_unique)."""
    there = F.col("v").isNotNull()
    return values.groupBy("col_no").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count("v").alias("n_values"), F.coalesce(F.max(F.when(there, F.col("n"))) == 1, F.lit(False)).alias("_once")
    ).select("col_no", "n_rows", "n_nulls", "n_values", (F.col("_once") & (F.col("n_nulls") == 0)).alias("is_unique"))


def inclusions(values: DataFrame, n_columns: int) -> DataFrame:
    """(col_no, in_no): every value of the first column is one of the second."""
    words = [f"w{w}" for w in range(-(-n_columns // WORD))]
    bit = F.expr(f"shiftleft(1L, col_no % {WORD})")
    per_value = values.filter("v is not null").groupBy("v").agg(
        *[F.bit_or(F.when(F.floor(F.col("col_no") / WORD) == i, bit).otherwise(F.lit(0).cast("long"))).alias(w)
          for i, w in enumerate(words)])
    # many values have the same set of columns: each set is kept once before it is taken apart
    sets = F.array(*words)
    held = F.filter(F.sequence(F.lit(0), F.lit(n_columns - 1)), lambda i: F.call_function(
        "getbit", F.element_at(sets, (F.floor(i / WORD) + 1).cast("int")), i % WORD) == 1)
    per_column = per_value.select(*words).distinct().select(F.explode(held).alias("col_no"), *words).groupBy("col_no").agg(
        *[F.bit_and(w).alias(w) for w in words])
    return per_column.select("col_no", F.explode(held).alias("in_no")).filter("col_no != in_no")


def discover(t, names=TABLE_NAMES):
    """(columns with their facts and ``is_key``, foreign keys), built once per session and folder."""
    from sqlweave.memo import memo
    return memo(t.spark, t.root, f"discover:{','.join(names)}", lambda: _discover(t, names))


def _discover(t, names):
    columns = discovered_columns(t, names)
    kinds = [r.kind for r in columns.filter("kind is not null").select("kind").distinct().collect()]
    values = [write_table(value_table(t, columns, kind), "values") for kind in sorted(kinds)]
    facts = columns.join(reduce(DataFrame.unionByName, map(column_facts, values)), "col_no", "left")
    # a table's key is its first unique column
    first = facts.filter("is_unique").groupBy("table_name").agg(F.min("col_no").alias("_key"))
    facts = facts.join(first, "table_name", "left").withColumn("is_key", F.coalesce(F.col("_key") == F.col("col_no"), F.lit(False)))
    facts = write_table(facts.drop("_key"), "facts")
    n_columns = columns.count()
    inside = write_table(reduce(DataFrame.unionByName, [inclusions(v, n_columns) for v in values]), "inclusions")
    bare = F.regexp_replace("column_name", "^[a-z]_", "")
    side = lambda p: facts.select(F.col("col_no").alias(f"{p}_no"), F.col("table_name").alias(f"{p}_table"),
                                  F.col("column_name").alias(f"{p}_column"), bare.alias(f"{p}_bare"), F.col("is_key").alias(f"{p}_key"))
    fks = (inside.join(side("from"), F.col("col_no") == F.col("from_no")).join(side("to"), F.col("in_no") == F.col("to_no"))
           .filter(F.col("to_key") & (F.col("from_table") != F.col("to_table")) & (F.col("from_bare") == F.col("to_bare"))))
    return facts, write_table(fks.select("from_no", "from_table", "from_column", "to_table", "to_column"), "fks")


def dictionary_frames(t, names=TABLE_NAMES) -> dict[str, DataFrame]:
    """What a relational dictionary would list for the tables, keys and foreign keys as found."""
    spark = t.spark
    facts, fks = discover(t, names)
    owner, none = F.lit(OWNER).alias("owner"), F.lit(None).cast("string")
    tables = facts.select(F.upper("table_name").alias("table_name")).distinct()
    key_name = lambda table: F.concat(F.lit("PK_"), F.upper(table))
    fk_name = F.concat_ws("_", F.lit("FK"), F.upper("from_table"), F.upper("from_column"), F.upper("to_table"))
    keys = facts.filter("is_key")
    return {
        "installs": spark.createDataFrame([(1, "I")], "oracle_id int, status string"),
        "users": spark.createDataFrame([(1, OWNER)], "oracle_id int, oracle_username string"),
        "tables": tables.select(owner, "table_name"),
        "synonyms": tables.select(F.col("table_name").alias("synonym_name"), F.lit(OWNER).alias("table_owner"), "table_name"),
        "columns": facts.select(owner, F.upper("table_name").alias("table_name"), F.upper("column_name").alias("column_name"),
                                "data_type", F.when(F.coalesce("n_nulls", F.lit(1)) == 0, "N").otherwise("Y").alias("nullable"),
                                F.col("col_pos").alias("column_id")),
        "constraints": keys.select(owner, key_name("table_name").alias("constraint_name"),
                                   F.upper("table_name").alias("table_name"), F.lit("P").alias("constraint_type"),
                                   none.alias("r_owner"), none.alias("r_constraint_name")).unionByName(
            fks.select(owner, fk_name.alias("constraint_name"), F.upper("from_table").alias("table_name"),
                       F.lit("R").alias("constraint_type"), F.lit(OWNER).alias("r_owner"),
                       key_name("to_table").alias("r_constraint_name"))),
        "cons_columns": keys.select(owner, key_name("table_name").alias("constraint_name"),
                                    F.upper("column_name").alias("column_name"), F.lit(1).alias("position")).unionByName(
            fks.select(owner, fk_name.alias("constraint_name"), F.upper("from_column").alias("column_name"),
                       F.lit(1).alias("position"))),
    }
