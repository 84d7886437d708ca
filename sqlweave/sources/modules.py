"""Many different catalogs, one per module, named with words of the documents.

The most frequent long words of ``documents.text`` are dealt out in order, SHARE words a
module, so no two modules share a name beyond the suffixes. Every third module is a large
one (ten tables in one FK component), the others have five tables. Words, and with
them the catalogs, follow the data; the layout is a fixed blueprint. The positions are
those of one catalog that holds all modules, so merging them changes names only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.functions.text import stop_words
from sqlweave.operators.catalog import RoleRules, extract_catalog
from sqlweave.session import write_table

N_MODULES = 48
SHARE = 16          # words a module
WORD_PATTERN = "[a-z]{5,}"
LARGE_EVERY = 3
SLOTS = 100         # table positions a module

# -- the blueprint: (word, suffix) of the table, then its columns --------------------------
# column: (word, suffix, raw type, is key, label words, lookup words)
_KEY, _ID = ("NUMBER", True, (), ()), ("NUMBER", False, (), ())
_NAME, _DATE, _NUMBER = ("VARCHAR2", False, (), ()), ("DATE", False, (), ()), ("NUMBER", False, (), ())
COMMON = (
    ((0, ""), ((0, "_id", *_KEY), (0, "_name", *_NAME), (0, "_code", *_NAME))),
    ((1, ""), ((1, "_id", *_KEY), (1, "_name", *_NAME))),
    ((2, "_headers_all"), ((2, "_id", *_KEY), (0, "_id", *_ID), (1, "_id", *_ID), (None, "org_id", *_ID),
                           (3, "_date", *_DATE), (4, "_amount", *_NUMBER),
                           (5, "_code", "VARCHAR2", False, (), (9, 10, 11)))),
    ((2, "_lines_all"), ((2, "_line_id", *_KEY), (2, "_id", *_ID), (6, "_id", *_ID), (None, "org_id", *_ID),
                         (7, "_amount", *_NUMBER), (8, "_quantity", *_NUMBER))),
    ((6, "_combinations"), ((6, "_id", *_KEY), (None, "segment1", "VARCHAR2", False, (9, 10), ()),
                            (None, "segment2", "VARCHAR2", False, (11,), ()))),
)
#: Added to the large modules: a chain of tables behind the first one, and a second fact.
FURTHER = (
    ((12, ""), ((12, "_id", *_KEY), (12, "_name", *_NAME), (0, "_id", *_ID))),
    ((13, ""), ((13, "_id", *_KEY), (13, "_name", *_NAME), (12, "_id", *_ID))),
    ((14, ""), ((14, "_id", *_KEY), (14, "_name", *_NAME), (13, "_id", *_ID))),
    ((15, ""), ((15, "_id", *_KEY), (15, "_name", *_NAME), (14, "_id", *_ID))),
    ((3, "_events_all"), ((3, "_event_id", *_KEY), (2, "_id", *_ID), (None, "org_id", *_ID), (5, "_date", *_DATE),
                          (15, "_amount", *_NUMBER))),
)
# -------------------------------------------------------------------------------------------


def layout_rows() -> list[tuple]:
    """(large, table_no, table_word, table_suffix, col_pos, word, suffix, type, key, label, lookup), large ones twice."""
    out = []
    for large in (False, True):
        for n, ((tw, ts), cols) in enumerate(COMMON + (FURTHER if large else ()), start=1):
            for c, (w, s, kind, key, label, lookup) in enumerate(cols, start=1):
                out.append((large, n, tw, ts, c, w, s, kind, key, list(label), list(lookup)))
    return out


def module_words(texts: DataFrame, text: str = "text", n_modules: int = N_MODULES) -> DataFrame:
    """(module, w ARRAY): the share of words of each module; fewer modules where words run out."""
    words = texts.select(F.explode(F.array_except(F.array_distinct(F.regexp_extract_all(
        F.lower(text), F.lit(WORD_PATTERN), 0)), stop_words())).alias("word"))
    top = (words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "word").limit(n_modules * SHARE))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1  # at most n_modules * SHARE rows
    top = top.withColumn("place", place).withColumn("module", F.floor(F.col("place") / SHARE))
    return (top.groupBy("module").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))),
                                                  lambda x: x["word"]).alias("w"))
            .filter(F.size("w") == SHARE))


def module_catalogs(texts: DataFrame, text: str = "text", n_modules: int = N_MODULES):
    """(cat_tables, cat_columns, cat_fks), one ``schema_id`` per module."""
    spark = texts.sparkSession
    layout = spark.createDataFrame(layout_rows(), (
        "large boolean, table_no int, tw int, ts string, col_pos int, cw int, cs string, data_type string, "
        "is_key boolean, label array<int>, lookup array<int>"))
    words = module_words(texts, text, n_modules).withColumn("large", F.col("module") % LARGE_EVERY == 0)
    at = lambda i: F.element_at("w", i + 1)
    cols = write_table(words.join(layout, "large").select(
        F.format_string("m%02d", F.col("module")).alias("module_id"),
        F.concat(at(F.col("tw")), "ts").alias("table_name"),
        (F.col("module") * SLOTS + F.col("table_no")).cast("int").alias("table_pos"), "col_pos",
        F.concat(F.coalesce(at(F.col("cw")), F.lit("")), "cs").alias("column_name"), "data_type", "is_key",
        F.when(F.size("label") > 0, F.array_join(F.transform("label", at), " ")).alias("business_label"),
        F.transform("lookup", at).alias("allowed_values")), "module_columns")
    pks = cols.filter("is_key").select("table_name", "column_name")
    flex = cols.filter("business_label is not null").select("table_name", "column_name", "business_label")
    lookups = cols.filter(F.size("allowed_values") > 0).select(
        "table_name", "column_name", F.upper("column_name").alias("lookup_type"),
        F.sort_array("allowed_values").alias("allowed_values"))
    raw = cols.select("table_name", "table_pos", "col_pos", "column_name", "data_type", (~F.col("is_key")).alias("nullable"))
    # names are unique over all modules, so one extraction serves them together
    tabs, columns, fks = extract_catalog(raw, pks, flex, lookups, None, RoleRules())
    owner = cols.select("table_name", "module_id").distinct()

    def own(df, name, label):
        own = owner.withColumnRenamed("table_name", name).withColumnRenamed("module_id", "schema_id")
        return write_table(df.drop("schema_id").join(own, name), label)
    return own(tabs, "table_name", "module_tables"), own(columns, "table_name", "module_columns"), \
        own(fks, "from_table", "module_fks")


def merged(cat_tables: DataFrame, cat_columns: DataFrame, cat_fks: DataFrame, schema_id: str = "merged"):
    """All modules as one catalog: every table's name gets its module as a prefix."""
    def prefixed(df, *names):
        return df.withColumns({n: F.concat("schema_id", F.lit("_"), n) for n in names}).withColumn(
            "schema_id", F.lit(schema_id))
    return prefixed(cat_tables, "table_name"), prefixed(cat_columns, "table_name"), \
        prefixed(cat_fks, "from_table", "to_table")
