"""Spec rows -> SQL text, a plain question, and k paraphrases (Spark expressions only).

The SQL is Spark SQL: ``EXTRACT(YEAR FROM a.c) = y`` for year filters and
``LIMIT n`` for top-N, so every rendered query can be analysed by Catalyst.
Question wording and paraphrase frames are our own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlweave.functions.phrases import FRAMES, MEASURE_VARIANTS, MEASURE_WORDS, YEAR_VARIANTS
from sqlweave.functions.text import alias_base, clean_question, entity_label, group_label, pluralize


def _at(arr, idx):
    """NULL-tolerant element access (ANSI mode raises on a missing index or key)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.try_element_at(arr, idx if isinstance(idx, Column) else F.lit(idx))

_SHORT_KEYWORDS: list[str] = []


def short_keywords() -> list[str]:
    """Spark's SQL keywords of up to four letters: never a bare table alias."""
    if not _SHORT_KEYWORDS:
        spark = SparkSession.active()
        _SHORT_KEYWORDS.extend(sorted(r[0] for r in spark.sql(
            "SELECT DISTINCT lower(keyword) FROM sql_keywords() WHERE length(keyword) <= 4").collect()))
    return _SHORT_KEYWORDS


def alias_map(tables: Column) -> Column:
    """table -> alias for tables in order: initials (max 3), numbered on clash or reserved."""
    reserved = F.array(*[F.lit(w) for w in short_keywords()])
    empty = F.array().cast("array<struct<t:string,a:string>>")

    def step(acc, t):
        base = alias_base(t)
        cands = F.transform(F.sequence(F.lit(1), F.size(acc) + 2),
                            lambda i: F.when(i == 1, base).otherwise(F.concat(base, i.cast("string"))))
        used = F.transform(acc, lambda y: y["a"])
        free = F.filter(cands, lambda x: ~F.array_contains(used, x) & ~F.array_contains(reserved, x))
        return F.concat(acc, F.array(F.struct(t.alias("t"), _at(free, 1).alias("a"))))

    return F.map_from_entries(F.aggregate(tables, empty, step))


def _ref(amap: Column, tbl: Column, col: Column) -> Column:
    return F.concat(_at(amap, tbl), F.lit("."), col)


def _lit(val: Column, is_str: Column) -> Column:
    return F.when(is_str, F.concat(F.lit("'"), F.replace(val, F.lit("'"), F.lit("''")), F.lit("'"))
                  ).otherwise(val)


def _pred(amap: Column, p: Column) -> Column:
    col = _ref(amap, p["tbl"], p["col"])
    return F.when(p["op"] == "YEAR_EQ", F.concat(F.lit("EXTRACT(YEAR FROM "), col, F.lit(") = "),
                                                 p["val"])) \
        .otherwise(F.concat(col, F.lit(" "), p["op"], F.lit(" "), _lit(p["val"], p["is_str"])))


def with_sql(specs: DataFrame) -> DataFrame:
    """Add ``aliases`` and ``sql``."""
    outer_tables = F.concat(F.array("query_table"), F.transform("joins", lambda j: j["new_tbl"]))
    s = specs.withColumn("aliases", alias_map(outer_tables))
    s = s.withColumn("_ia", F.when(F.col("inner").isNotNull(),
                                   alias_map(F.array(F.col("inner.from_table")))))
    a, ia = F.col("aliases"), F.col("_ia")
    sh = F.col("shape")
    agg_call = F.concat(F.col("agg.func"), F.lit("("), _ref(a, F.col("agg.tbl"), F.col("agg.col")),
                        F.lit(")"))
    agg_item = F.concat(agg_call, F.lit(" AS "), F.lower("agg.func"), F.lit("_"), F.col("agg.col"))
    sel = F.transform("select_cols", lambda c: _ref(a, c["tbl"], c["col"]))
    win = F.concat(
        F.col("window.func"), F.lit("() OVER ("),
        F.when(F.col("window.part_col").isNotNull(), F.concat(
            F.lit("PARTITION BY "), _ref(a, F.col("from_table"), F.col("window.part_col")),
            F.lit(" "))).otherwise(F.lit("")),
        F.lit("ORDER BY "), _ref(a, F.col("from_table"), F.col("window.ord_col")),
        F.lit(" DESC) AS rnk"))
    items = (F.when(sh.isin("agg", "having", "top_n"), F.concat(sel, F.array(agg_item)))
             .when(sh == "agg_global", F.array(agg_item))
             .when(sh == "window", F.concat(sel, F.array(win)))
             .otherwise(sel))
    inner_sel = F.when(F.col("inner.func").isNotNull(), F.concat(
        F.col("inner.func"), F.lit("("), _ref(ia, F.col("inner.from_table"), F.col("inner.col")),
        F.lit(")"))).otherwise(_ref(ia, F.col("inner.from_table"), F.col("inner.col")))
    inner_where = F.when(F.size("inner.preds") > 0, F.concat(
        F.lit(" WHERE "), F.array_join(F.transform("inner.preds", lambda p: _pred(ia, p)), " AND ")
    )).otherwise(F.lit(""))
    inner_sql = F.concat(F.lit("SELECT "), inner_sel, F.lit(" FROM "), F.col("inner.from_table"),
                         F.lit(" "), _at(ia, F.col("inner.from_table")), inner_where)
    sub_pred = F.concat(_ref(a, F.col("query_table"), F.col("inner.outer_col")), F.lit(" "),
                        F.col("inner.op"), F.lit(" ("), inner_sql, F.lit(")"))
    preds = F.concat(F.transform("preds", lambda p: _pred(a, p)),
                     F.when(F.col("inner").isNotNull(), F.array(sub_pred))
                     .otherwise(F.array().cast("array<string>")))
    parts = F.concat(
        F.array(F.concat(F.lit("SELECT "), F.array_join(items, ", ")),
                F.concat(F.lit("FROM "), F.col("query_table"), F.lit(" "),
                         _at(a, F.col("query_table")))),
        F.transform("joins", lambda j: F.concat(
            F.lit("JOIN "), j["new_tbl"], F.lit(" "), _at(a, j["new_tbl"]), F.lit(" ON "),
            _ref(a, j["l_tbl"], j["l_col"]), F.lit(" = "), _ref(a, j["r_tbl"], j["r_col"]))),
        F.when(F.size(preds) > 0, F.array(F.concat(F.lit("WHERE "),
                                                   F.array_join(preds, "\n  AND "))))
        .otherwise(F.array().cast("array<string>")),
        F.when(F.col("group_col").isNotNull(), F.array(F.concat(
            F.lit("GROUP BY "), _ref(a, F.col("group_col.tbl"), F.col("group_col.col")))))
        .otherwise(F.array().cast("array<string>")),
        F.when(sh == "having", F.array(F.concat(F.lit("HAVING "), agg_call, F.lit(" > "),
                                                F.col("having_val").cast("string"))))
        .otherwise(F.array().cast("array<string>")),
        F.when(sh == "top_n", F.array(F.concat(F.lit("ORDER BY "), agg_call, F.lit(" DESC")),
                                      F.concat(F.lit("LIMIT "), F.col("top_n").cast("string"))))
        .otherwise(F.array().cast("array<string>")))
    return s.withColumn("sql", F.array_join(parts, "\n")).drop("_ia")


# -- questions ------------------------------------------------------------------------------
def _entity(tbl) -> Column:
    return pluralize(entity_label(tbl))


def _measure(variant: Column | None = None) -> Column:
    lbl = F.col("agg.label")
    d = _entity(F.col("from_table"))
    if variant is None:
        word = F.create_map(*[x for k, v in MEASURE_WORDS.items() for x in (F.lit(k), F.lit(v))])
        return F.when(F.col("agg.func") == "COUNT", F.concat(F.lit("number of "), d)) \
            .otherwise(F.concat(_at(word, F.col("agg.func")), F.lit(" "), lbl))
    return F.replace(F.replace(variant, F.lit("{l}"), lbl), F.lit("{d}"), d)


def _filters(preds: Column, year_variant: Column | None = None) -> Column:
    def one(p):
        yr = (F.concat(F.lit(" in "), p["val"]) if year_variant is None
              else F.replace(year_variant, F.lit("{v}"), p["val"]))
        return (F.when(p["op"] == "YEAR_EQ", yr)
                .when(p["is_str"], F.concat(F.lit(" with "), p["label"], F.lit(" "), F.lower(p["val"])))
                .otherwise(F.concat(F.lit(" limited to "), p["label"], F.lit(" "), p["val"])))
    return F.array_join(F.transform(preds, one), "")


def _slots(measure: Column, filters: Column) -> dict:
    grp = group_label(F.col("group_col.label"))
    part = F.when(F.col("window.part_label").isNotNull(),
                  F.concat(F.lit(", separately for every "), F.col("window.part_label"))).otherwise(F.lit(""))
    inner_f = F.coalesce(F.col("inner.preds"), F.array().cast(
        "array<struct<tbl:string,col:string,label:string,op:string,val:string,is_str:boolean>>"))
    return {
        "{m}": measure, "{gp}": pluralize(grp), "{g}": grp,
        "{d}": _entity(F.col("query_table")),
        "{c}": F.array_join(F.transform("select_cols", lambda c: c["label"]), ", "),
        "{l}": F.coalesce(F.col("inner.label"), F.col("window.ord_label")),
        "{n}": F.col("top_n").cast("string"), "{v}": F.col("having_val").cast("string"),
        "{x}": _entity(F.col("query_table")), "{y}": entity_label(F.col("from_table")),
        "{p}": part,
        "{f}": F.when(F.col("shape") == "semijoin", _filters(inner_f)).otherwise(filters),
    }


def _fill(frame: Column, slots: dict) -> Column:
    out = frame
    for k, v in slots.items():
        out = F.replace(out, F.lit(k), F.coalesce(v, F.lit("")))
    return clean_question(out)


CANONICAL = {
    "list": "show {c} for {d}{f}", "agg": "{m} per {g}{f}", "agg_global": "{m}{f}",
    "having": "{m} per {g} where the {m} is above {v}{f}",
    "top_n": "which {n} {gp} have the highest {m}{f}",
    "above_avg": "{d} with {l} above the average",
    "semijoin": "{x} that have at least one {y}{f}", "window": "sort {d} by falling {l}{p}",
}


def with_question(specs: DataFrame) -> DataFrame:
    """Add ``question``: the plain wording of the spec."""
    frame = _at(F.create_map(*[x for k, v in CANONICAL.items()
                                        for x in (F.lit(k), F.lit(v))]), F.col("shape"))
    return specs.withColumn("question", _fill(frame, _slots(_measure(), _filters(F.col("preds")))))


def frames_table(spark) -> DataFrame:
    rows = [(shape, i, f) for shape, fs in FRAMES.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "shape string, frame_id int, frame string")


def with_paraphrases(specs: DataFrame, k: int = 3) -> DataFrame:
    """Add ``paraphrases``: up to k distinct rewordings (SQL unchanged).

    Candidates are every frame of the shape x every measure wording x one
    hash-chosen year wording; distinct texts are ranked by a hash of the spec
    and the text, and the first k kept. The frame table is a fixed, small
    broadcast.
    """
    spark = specs.sparkSession
    mv = F.create_map(*[x for fn, vs in MEASURE_VARIANTS.items()
                        for x in (F.lit(fn), F.array(*[F.lit(v) for v in vs]))])
    yv = F.array(*[F.lit(v) for v in YEAR_VARIANTS])
    key = ["schema_id", "spec_id"]
    c = (specs.join(F.broadcast(frames_table(spark)), "shape")
         .withColumn("_mv", F.explode_outer(_at(mv, F.col("agg.func")))))
    yr = _at(yv, (F.pmod(F.xxhash64("spec_id", "frame_id", "_mv"), F.lit(len(YEAR_VARIANTS)))
                           + 1).cast("int"))
    c = c.withColumn("_text", _fill(F.col("frame"), _slots(
        F.when(F.col("_mv").isNotNull(), _measure(F.col("_mv"))).otherwise(_measure()),
        _filters(F.col("preds"), yr))))
    ranked = (c.select(*key, "_text").distinct()
              .withColumn("_r", F.xxhash64("spec_id", "_text")))
    top = (ranked.groupBy(*key)
           .agg(F.slice(F.sort_array(F.collect_list(F.struct("_r", "_text"))), 1, k).alias("_p")))
    return specs.join(top.select(*key, F.transform("_p", lambda x: x["_text"]).alias("paraphrases")),
                      key, "left").withColumn(
        "paraphrases", F.coalesce("paraphrases", F.array().cast("array<string>")))


def paraphrase_hook(df: DataFrame, fn=None, k: int = 3, col: str = "question",
                    out: str = "hook_paraphrases") -> DataFrame:
    """Up to ``k`` phrasings that a caller's function ``fn(question, k)`` offers for each question.

    Without a function the column holds empty arrays. Empty phrasings don't count;
    a question on which the function raises gets none.
    """
    if fn is None or k <= 0:
        return df.withColumn(out, F.array().cast("array<string>"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(qs: pd.Series) -> pd.Series:
        out = []
        for question in qs:
            try:
                offered = list(fn(question, k))
            except Exception:  # the caller's function may fail in any way
                offered = []
            filled = [text for text in offered if (text or "").strip()]
            out.append(filled[:k])
        return pd.Series(out)

    return df.withColumn(out, run(F.col(col)))
