"""Query-spec enumeration (levels L1-L5), validation and table lists.

A spec is one row: the parts of one SELECT as columns (arrays of structs for
the select list, joins and predicates; structs for the aggregate, group
column, subquery and window). Specs are numbered by one ``spark.range``, so a single catalog's specs
spread over all tasks. Each choice is an integer draw on (spec_id, salt) that any SQL
engine can compute, and gives a position: tables, group candidates (with their join paths, within
two FK hops), name links and lookup values are rows with gapless positions, joined on
(schema_id, ..., position), so no row carries a catalog's lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.functions.text import label
from sqlweave.operators.synth import lcg, lcg_sql
from sqlweave.session import write_table


def _at(arr, idx):
    """NULL-tolerant element access (ANSI mode raises on a missing index or key)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.try_element_at(arr, idx if isinstance(idx, Column) else F.lit(idx))

# -- fixed values of the draws ---------------------------------------------------------
AGG_WEIGHTS = (("SUM", 5), ("AVG", 2), ("COUNT", 2), ("MAX", 1), ("MIN", 1))
HAVING_VALUES = (1_000, 10_000, 50_000, 100_000)
TOP_N = (3, 5, 10)
YEARS = (1996, 1997, 2000)          # order years present in the driver's data
ORG_VALUES = (1, 2, 3)              # values of the org-striping stand-in column
P_DATE, P_ORG, P_LOOKUP, P_NO_GROUP, P_HAVING, P_SEMI, P_INNER_DATE = (
    0.6, 0.7, 0.6, 0.3, 0.5, 0.5, 0.7)
# ------------------------------------------------------------------------------------

_COL = "struct<tbl:string,col:string,label:string>"
_PRED = "struct<tbl:string,col:string,label:string,op:string,val:string,is_str:boolean>"


#: The draws by number; a draw's salt is a multiple of its number.
DRAWS = {name: i for i, name in enumerate((
    "table", "fact", "agg", "amount", "no_group", "group", "fallback", "having", "having_val", "top_n_val", "semi",
    "name_fk", "dim_name", "p_date", "date_col", "year", "p_org", "org_val", "p_lookup", "lookup_col", "lookup_val",
    "inner_date"), start=1)}
SALT, HALF = 104_729, 65_536


def draw(name: str, n) -> Column:
    """A whole number below ``n``: 30 bits from the upper halves of two chained integer hashes of spec_id."""
    salt = DRAWS[name] * SALT
    one = lcg(F.col("spec_id"), salt)
    two = lcg(one, salt + 1)
    return F.pmod(F.floor(one / HALF) * 32_768 + F.floor(two / HALF), n if isinstance(n, Column) else F.lit(n))


def draw_sql(name: str, n, spec_id: str = "spec_id") -> str:
    salt = DRAWS[name] * SALT
    one = lcg_sql(spec_id, salt)
    two = lcg_sql(f"({one})", salt + 1)
    return f"((({one}) // {HALF}) * 32768 + ({two}) // {HALF}) % ({n})"


def _pick(arr, name: str) -> Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.when(F.size(arr) > 0, _at(arr, (draw(name, F.size(arr)) + 1).cast("int")))


def _chance(name: str, p: float) -> Column:
    return draw(name, 1000) < int(p * 1000)


def _colref(tbl, col, lbl) -> Column:
    return F.struct(tbl.alias("tbl"), col.alias("col"), lbl.alias("label"))


def table_info(cat_columns: DataFrame) -> DataFrame:
    """Per (schema_id, table_name): the role columns the draws choose from."""
    c = cat_columns.withColumn("label", label("column_name", "business_label"))
    ref = F.struct("col_pos", "column_name", "label", "role", "is_pk", "allowed_values")
    g = c.groupBy("schema_id", "table_name", "table_pos").agg(
        F.sort_array(F.collect_list(ref)).alias("cols"))

    def of(role):
        return F.filter("cols", lambda x: x["role"] == role)

    def names(arr):
        return F.transform(arr, lambda x: F.struct(x["column_name"].alias("col"),
                                                  x["label"].alias("label")))

    pk = F.filter("cols", lambda x: x["is_pk"])
    list_cols = F.concat(names(pk), names(of("name")), names(of("code")), names(of("amount")),
                         names(of("date")))
    first = names(F.slice("cols", 1, 1))
    return g.select(
        "schema_id", "table_name", "table_pos",
        _at(names(pk), 1).alias("pk"),
        _at(first, 1).alias("first_col"),
        names(of("amount")).alias("amounts"),
        names(of("date")).alias("dates"),
        _at(names(of("org_id")), 1).alias("org"),
        F.transform(F.filter(of("lookup"), lambda x: F.size(x["allowed_values"]) > 0),
                    lambda x: F.struct(x["column_name"].alias("col"), x["label"].alias("label"),
                                       F.size(x["allowed_values"]).alias("n"))).alias("lookups"),
        names(of("name")).alias("names"),
        F.when(F.size(list_cols) > 0, F.slice(list_cols, 1, 4)).otherwise(first).alias("list_cols"),
        F.when(F.size(of("lookup")) > 0, names(of("lookup"))).when(F.size(of("code")) > 0, names(of("code")))
        .otherwise(F.slice(names(pk), 1, 1)).alias("fallbacks"),
        _at(names(F.filter("cols", lambda x: (x["role"] == "id") & ~x["is_pk"])), 1)
        .alias("first_nonpk_id"),
    )


def group_candidates(info: DataFrame, cat_fks: DataFrame, facts: DataFrame, flex: DataFrame,
                     max_hops: int = 2) -> DataFrame:
    """(schema_id, fact, pos, tbl, col, ..., path): NAME / flexfield columns on the fact and on tables
    within ``max_hops`` FK hops, each with the FK path from the fact and its position."""
    from sqlweave.operators.paths import bfs
    key = ["schema_id", "src", "node", "hops"]
    reach = bfs(cat_fks, facts.select("schema_id", F.col("table_name").alias("src")), max_hops=max_hops)
    fk = cat_fks.select("schema_id", "fk_pos", F.struct("from_table", "from_column", "to_table", "to_column").alias("fk"))
    walked = (reach.select(*key, F.posexplode_outer("path").alias("step", "fk_pos"))
              .join(fk, ["schema_id", "fk_pos"], "left").groupBy(*key)
              .agg(F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "fk")))).alias("s"))
              .select("schema_id", F.col("src").alias("fact"), F.col("node").alias("table_name"), "hops",
                      F.transform("s", lambda x: x["fk"]).alias("path")))
    cand_cols = info.select("schema_id", "table_name", "table_pos", F.explode(
        F.transform("names", lambda x: F.struct(F.lit(0).alias("r"), x["col"].alias("col"),
                                                x["label"].alias("label")))).alias("c"))
    cc = cand_cols.unionByName(flex.select("schema_id", "table_name", "table_pos", "c"))
    j = walked.join(cc, ["schema_id", "table_name"])
    j = j.select("schema_id", "fact", "hops", "table_pos", F.col("c.r").alias("r"), F.col("table_name").alias("tbl"),
                 F.col("c.col").alias("col"), F.col("c.label").alias("label"), (F.col("c.r") == 1).alias("is_flex"), "path")
    return j.withColumn("pos", _position(["schema_id", "fact"], ["hops", "table_pos", "r", "tbl", "col"]))


def _position(keys: list[str], order: list[str]) -> Column:
    """Gapless positions from 0 within a catalog's (or table's) rows."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")


def name_fks(cat_fks: DataFrame, info: DataFrame) -> DataFrame:
    """(schema_id, fact, pos, from_column, to_table, to_column, to_names): outgoing FKs whose target has a NAME column."""
    tgt = info.filter(F.size("names") > 0).select("schema_id", F.col("table_name").alias("to_table"),
                                                  F.col("names").alias("to_names"))
    j = cat_fks.join(tgt, ["schema_id", "to_table"]).withColumn("fact", F.col("from_table"))
    return j.withColumn("pos", _position(["schema_id", "fact"], ["fk_pos"])).select(
        "schema_id", "fact", "pos", "from_column", "to_table", "to_column", "to_names")


def _by_position(s: DataFrame, rows: DataFrame, keys: list[str], name: str, at: Column, out: str) -> DataFrame:
    """``s`` with ``out``: the row of ``rows`` (keys, pos, item) at the drawn position; null where there is none.

    ``name``_count of ``s`` says how many positions there are.
    """
    s = s.withColumn("_pos", F.when(F.col(f"{name}_count") > 0, at))
    picked = rows.withColumnRenamed("pos", "_pos").withColumnRenamed("item", out)
    return s.join(picked, [*keys, "_pos"], "left").drop("_pos")


def enumerate_specs(cat_tables: DataFrame, cat_columns: DataFrame, cat_fks: DataFrame,
                    n_per_level: int = 20, levels=(1, 2, 3, 4, 5)) -> DataFrame:
    """``n_per_level`` specs per (schema_id, level), numbered through all catalogs in order of schema_id.

    A catalog without facts gives specs of level 1 in place of the higher levels.
    """
    spark = cat_columns.sparkSession
    info = write_table(table_info(cat_columns), "table_info")
    flex = cat_columns.filter(F.col("role") == "flexfield_segment").select(
        "schema_id", "table_name", "table_pos", F.struct(
            F.lit(1).alias("r"), F.col("column_name").alias("col"),
            label("column_name", "business_label").alias("label")).alias("c"))
    facts = info.filter(F.size("amounts") > 0).select("schema_id", "table_name", "table_pos")
    cands = write_table(group_candidates(info, cat_fks, facts, flex), "candidates")
    nfk = write_table(name_fks(cat_fks, info), "name_fks")

    catalogs = info.groupBy("schema_id").agg(
        F.count(F.lit(1)).alias("table_count"), F.count(F.when(F.size("amounts") > 0, 1)).alias("fact_count"))
    # catalogs by number, without a single-task window
    from sqlweave.operators.ranking import rank_over
    catalogs = rank_over(catalogs, "schema_id", [], func="row_number", out="catalog_no", ascending=True)
    per_catalog = len(levels) * n_per_level
    slot = F.floor(F.col("spec_id") / n_per_level)
    base = spark.range(catalogs.count() * per_catalog).withColumnRenamed("id", "spec_id").select(
        "spec_id", (F.floor(F.col("spec_id") / per_catalog) + 1).alias("catalog_no"),
        F.element_at(F.array(*map(F.lit, levels)), (F.pmod(slot, F.lit(len(levels))) + 1).cast("int")).alias("level"),
        F.pmod("spec_id", F.lit(n_per_level)).cast("int").alias("spec_no"))
    base = base.join(catalogs, "catalog_no").withColumn("is_fact", (F.col("level") >= 2) & (F.col("fact_count") > 0))
    base = base.withColumn("level", F.when(F.col("is_fact"), F.col("level")).otherwise(1))
    base = base.withColumn("_pos", F.when(F.col("is_fact"), draw("fact", F.col("fact_count")))
                           .otherwise(draw("table", F.col("table_count"))))
    placed = lambda df, is_fact: df.select("schema_id", "table_name", F.lit(is_fact).alias("is_fact"),
                                           _position(["schema_id"], ["table_pos"]).alias("_pos"))
    s = base.join(placed(info, False).unionByName(placed(facts, True)), ["schema_id", "is_fact", "_pos"]).drop("_pos")
    counts = lambda df, name: df.groupBy("schema_id", F.col("fact").alias("table_name")).agg(
        F.count(F.lit(1)).alias(f"{name}_count"))
    key = ["schema_id", "table_name"]
    info = info.drop("table_pos").join(counts(cands, "group"), key, "left").join(counts(nfk, "name_fk"), key, "left")
    s = s.join(info, key).fillna(0, ["group_count", "name_fk_count"])
    item = lambda df, *cols: df.select("schema_id", F.col("fact").alias("table_name"), "pos",
                                       F.struct(*cols).alias("item"))
    s = _by_position(s, item(cands, "tbl", "col", "label", "is_flex", "path"), key, "group",
                     draw("group", F.col("group_count")), "_cand")
    s = _by_position(s, item(nfk, "from_column", "to_table", "to_column", "to_names"), key, "name_fk",
                     draw("name_fk", F.col("name_fk_count")), "_link")
    # lookup values by (column, position)
    values = cat_columns.filter("role = 'lookup'").select(
        *key, F.col("column_name").alias("_lookup_col"), F.posexplode("allowed_values").alias("pos", "item"))
    values = values.withColumn("pos", F.col("pos").cast("long"))
    s = s.withColumn("_lookup", _pick("lookups", "lookup_col")).withColumns({
        "_lookup_col": F.col("_lookup.col"), "lookup_count": F.coalesce("_lookup.n", F.lit(0))})
    s = _by_position(s, values, [*key, "_lookup_col"], "lookup", draw("lookup_val", F.col("lookup_count")), "_lookup_val")
    return _build(s.withColumnRenamed("table_name", "from_table"))


def _filters(tbl: Column) -> Column:
    date = _pick("dates", "date_col")
    lk = F.col("_lookup")
    p_date = F.when((F.size("dates") > 0) & _chance("p_date", P_DATE), F.struct(
        tbl.alias("tbl"), date["col"].alias("col"), date["label"].alias("label"),
        F.lit("YEAR_EQ").alias("op"),
        _pick(F.array(*[F.lit(str(y)) for y in YEARS]), "year").alias("val"),
        F.lit(False).alias("is_str")))
    p_org = F.when(F.col("org").isNotNull() & _chance("p_org", P_ORG), F.struct(
        tbl.alias("tbl"), F.col("org.col").alias("col"), F.col("org.label").alias("label"),
        F.lit("=").alias("op"),
        _pick(F.array(*[F.lit(str(v)) for v in ORG_VALUES]), "org_val").alias("val"),
        F.lit(False).alias("is_str")))
    p_lk = F.when((F.size("lookups") > 0) & _chance("p_lookup", P_LOOKUP), F.struct(
        tbl.alias("tbl"), lk["col"].alias("col"), lk["label"].alias("label"),
        F.lit("=").alias("op"), F.col("_lookup_val").alias("val"),
        F.lit(True).alias("is_str")))
    return F.filter(F.array(p_date, p_org, p_lk), lambda x: x.isNotNull())


def _agg_pick() -> Column:
    total = sum(w for _, w in AGG_WEIGHTS)
    r = draw("agg", total)
    expr, acc = None, 0
    for func, w in AGG_WEIGHTS:
        acc += w
        expr = (F.when(r < acc, F.lit(func)) if expr is None
                else expr.when(r < acc, F.lit(func)))
    return expr


def _build(s: DataFrame) -> DataFrame:
    lv = F.col("level")
    ft = F.col("from_table")
    s = s.withColumn("_func", _agg_pick())
    amount = _pick("amounts", "amount")
    count_col = F.coalesce(F.col("pk"), F.col("first_col"))
    agg_target = F.when(F.col("_func") == "COUNT", count_col).otherwise(amount)
    s = s.withColumn("_agg", F.struct(F.col("_func").alias("func"), ft.alias("tbl"),
                                      agg_target["col"].alias("col"),
                                      agg_target["label"].alias("label")))
    s = s.withColumn("_amount", amount)
    no_group = (lv == 2) & _chance("no_group", P_NO_GROUP)
    gc, fb = F.col("_cand"), _pick("fallbacks", "fallback")
    s = s.withColumn("_group", F.when(gc.isNotNull(), gc).otherwise(F.struct(
        ft.alias("tbl"), fb["col"].alias("col"), fb["label"].alias("label"), F.lit(False).alias("is_flex"),
        F.array().cast("array<struct<from_table:string,from_column:string,to_table:string,to_column:string>>")
        .alias("path"))))
    semi_ok = F.col("_link").isNotNull() & _chance("semi", P_SEMI)
    shape = (F.when(lv == 1, "list")
             .when((lv == 2) & no_group, "agg_global")
             .when(lv == 2, "agg")
             .when((lv == 3) & _chance("having", P_HAVING), "having")
             .when(lv == 3, "top_n")
             .when((lv == 4) & semi_ok, "semijoin")
             .when(lv == 4, "above_avg")
             .otherwise("window"))
    s = s.withColumn("shape", shape)
    sh = F.col("shape")
    grouped = sh.isin("agg", "having", "top_n")

    # joins in walking order from the fact: each adds the far end of the next FK
    joins = F.aggregate(
        F.col("_group.path"),
        F.struct(ft.alias("cur"), F.array().cast(
            "array<struct<l_tbl:string,l_col:string,r_tbl:string,r_col:string,new_tbl:string>>"
        ).alias("j")),
        lambda acc, e: F.struct(
            F.when(e["from_table"] == acc["cur"], e["to_table"]).otherwise(e["from_table"])
            .alias("cur"),
            F.concat(acc["j"], F.array(F.struct(
                e["from_table"].alias("l_tbl"), e["from_column"].alias("l_col"),
                e["to_table"].alias("r_tbl"), e["to_column"].alias("r_col"),
                F.when(e["from_table"] == acc["cur"], e["to_table"]).otherwise(e["from_table"])
                .alias("new_tbl")))).alias("j")),
        lambda acc: acc["j"])
    empty_joins = F.array().cast(
        "array<struct<l_tbl:string,l_col:string,r_tbl:string,r_col:string,new_tbl:string>>")
    s = s.withColumn("joins", F.when(grouped, joins).otherwise(empty_joins))

    s = s.withColumn("_nfk", F.when(sh == "semijoin", F.col("_link")))
    dim_name = _pick(F.coalesce(F.col("_nfk.to_names"), F.array()), "dim_name")

    pk_ref = _colref(ft, count_col["col"], count_col["label"])
    part = F.coalesce(F.col("org"), F.col("first_nonpk_id"))
    list_sel = F.transform("list_cols", lambda c: _colref(ft, c["col"], c["label"]))
    s = s.withColumn("select_cols", (
        F.when(sh == "list", list_sel)
        .when(sh.isin("agg", "having", "top_n"),
              F.array(_colref(F.col("_group.tbl"), F.col("_group.col"), F.col("_group.label"))))
        .when(sh == "above_avg", F.array(pk_ref, _colref(ft, amount["col"], amount["label"])))
        .when(sh == "semijoin", F.array(_colref(F.col("_nfk.to_table"), dim_name["col"],
                                                dim_name["label"])))
        .when(sh == "window", F.filter(F.array(
            pk_ref, F.when(part.isNotNull(), _colref(ft, part["col"], part["label"])),
            _colref(ft, amount["col"], amount["label"])), lambda x: x.isNotNull()))
        .otherwise(F.array().cast(f"array<{_COL}>"))))
    s = s.withColumn("agg", F.when(sh.isin("agg", "agg_global", "having", "top_n"), F.col("_agg")))
    s = s.withColumn("group_col", F.when(grouped, _colref(F.col("_group.tbl"), F.col("_group.col"),
                                                         F.col("_group.label"))))
    s = s.withColumn("having_val", F.when(sh == "having", _pick(
        F.array(*[F.lit(v) for v in HAVING_VALUES]), "having_val")))
    s = s.withColumn("top_n", F.when(sh == "top_n", _pick(F.array(*[F.lit(v) for v in TOP_N]),
                                                          "top_n_val")))
    filters = _filters(ft)
    s = s.withColumn("preds", F.when(sh.isin("list", "agg", "agg_global", "having", "top_n"),
                                     filters).otherwise(F.array().cast(f"array<{_PRED}>")))
    inner_date = F.when((F.size("dates") > 0) & _chance("inner_date", P_INNER_DATE), F.array(
        F.struct(ft.alias("tbl"), _pick("dates", "date_col")["col"].alias("col"),
                 _pick("dates", "date_col")["label"].alias("label"), F.lit("YEAR_EQ").alias("op"),
                 _pick(F.array(*[F.lit(str(y)) for y in YEARS]), "year").alias("val"),
                 F.lit(False).alias("is_str")))).otherwise(F.array().cast(f"array<{_PRED}>"))
    s = s.withColumn("inner", (
        F.when(sh == "above_avg", F.struct(
            ft.alias("from_table"), F.lit("AVG").alias("func"), amount["col"].alias("col"),
            amount["label"].alias("label"), F.array().cast(f"array<{_PRED}>").alias("preds"),
            amount["col"].alias("outer_col"), F.lit(">").alias("op")))
        .when(sh == "semijoin", F.struct(
            ft.alias("from_table"), F.lit(None).cast("string").alias("func"),
            F.col("_nfk.from_column").alias("col"), F.lit(None).cast("string").alias("label"),
            inner_date.alias("preds"), F.col("_nfk.to_column").alias("outer_col"),
            F.lit("IN").alias("op")))))
    s = s.withColumn("query_table", F.when(sh == "semijoin", F.col("_nfk.to_table")).otherwise(ft))
    s = s.withColumn("window", F.when(sh == "window", F.struct(
        F.lit("RANK").alias("func"), part["col"].alias("part_col"),
        part["label"].alias("part_label"), amount["col"].alias("ord_col"),
        amount["label"].alias("ord_label"))))
    feats = F.array(
        F.when(grouped | (sh == "agg_global"), F.lower(F.col("_agg.func"))),
        F.when(sh == "agg_global", F.lit("no_group")),
        F.when(grouped & (F.size("joins") > 0), F.lit("join")),
        F.when(grouped & F.col("_group.is_flex"), F.lit("flexfield")),
        F.when(F.exists("preds", lambda p: p["op"] == "YEAR_EQ")
               | F.exists(F.coalesce(F.col("inner.preds"), F.array().cast(f"array<{_PRED}>")),
                          lambda p: p["op"] == "YEAR_EQ"), F.lit("date_filter")),
        F.when(F.exists("preds", lambda p: (p["op"] == "=") & ~p["is_str"]), F.lit("multi_org")),
        F.when(F.exists("preds", lambda p: p["is_str"]), F.lit("lookup_filter")),
        F.when(sh == "having", F.lit("having")), F.when(sh == "top_n", F.lit("top_n")),
        F.when(sh == "above_avg", F.lit("above_average")),
        F.when(sh == "semijoin", F.lit("semijoin")),
        F.when(sh.isin("above_avg", "semijoin"), F.lit("subquery")),
        F.when(sh == "window", F.lit("window")),
        F.concat(F.lit("L"), lv.cast("string")))
    s = s.withColumn("features", F.filter(feats, lambda x: x.isNotNull()))
    return s.select("schema_id", "spec_id", "level", "spec_no", "shape", "query_table",
                    "from_table", "select_cols", "agg", "group_col", "joins", "preds",
                    "having_val", "top_n", "inner", "window", "features")


# -- validation ------------------------------------------------------------------------
def spec_tables(specs: DataFrame) -> DataFrame:
    """(schema_id, spec_id, tables): every table a spec uses, joins and subquery included."""
    t = F.array_distinct(F.filter(F.concat(
        F.array("query_table", "from_table"), F.transform("joins", lambda j: j["new_tbl"]),
        F.array(F.col("inner.from_table"))), lambda x: x.isNotNull()))
    return specs.select("schema_id", "spec_id", t.alias("tables"))


def spec_refs(specs: DataFrame) -> DataFrame:
    """(schema_id, spec_id, scope, tbl, col) for every column a spec names.

    scope 'outer' refs must be in the outer FROM/JOIN tables, 'inner' in the subquery's.
    """
    outer = F.concat(
        F.transform("select_cols", lambda c: F.struct(c["tbl"].alias("tbl"), c["col"].alias("col"))),
        F.when(F.col("agg").isNotNull(), F.array(F.struct(F.col("agg.tbl").alias("tbl"),
                                                          F.col("agg.col").alias("col"))))
        .otherwise(F.array().cast("array<struct<tbl:string,col:string>>")),
        F.transform("joins", lambda j: F.struct(j["l_tbl"].alias("tbl"), j["l_col"].alias("col"))),
        F.transform("joins", lambda j: F.struct(j["r_tbl"].alias("tbl"), j["r_col"].alias("col"))),
        F.transform("preds", lambda p: F.struct(p["tbl"].alias("tbl"), p["col"].alias("col"))),
        F.when(F.col("inner").isNotNull(), F.array(F.struct(
            F.col("query_table").alias("tbl"), F.col("inner.outer_col").alias("col"))))
        .otherwise(F.array().cast("array<struct<tbl:string,col:string>>")),
        F.when(F.col("window").isNotNull(), F.filter(F.array(
            F.when(F.col("window.part_col").isNotNull(), F.struct(
                F.col("from_table").alias("tbl"), F.col("window.part_col").alias("col"))),
            F.struct(F.col("from_table").alias("tbl"), F.col("window.ord_col").alias("col"))),
            lambda x: x.isNotNull()))
        .otherwise(F.array().cast("array<struct<tbl:string,col:string>>")))
    inner = F.when(F.col("inner").isNotNull(), F.concat(
        F.array(F.struct(F.col("inner.from_table").alias("tbl"), F.col("inner.col").alias("col"))),
        F.transform("inner.preds", lambda p: F.struct(p["tbl"].alias("tbl"),
                                                      p["col"].alias("col")))))
    o = specs.select("schema_id", "spec_id", F.lit("outer").alias("scope"),
                     F.array_distinct(F.concat(F.array("query_table"),
                                               F.transform("joins", lambda j: j["new_tbl"])))
                     .alias("present"), F.explode(outer).alias("r"))
    i = specs.filter(F.col("inner").isNotNull()).select(
        "schema_id", "spec_id", F.lit("inner").alias("scope"),
        F.array(F.col("inner.from_table")).alias("present"), F.explode(inner).alias("r"))
    return o.unionByName(i).select("schema_id", "spec_id", "scope", "present",
                                   F.col("r.tbl").alias("tbl"), F.col("r.col").alias("col"))


def validate_specs(specs: DataFrame, cat_tables: DataFrame, cat_columns: DataFrame,
                   cat_fks: DataFrame) -> DataFrame:
    """(schema_id, spec_id, kind, detail) for every problem; no row = valid.

    Tables exist; columns exist on their table and the table is in the scope's
    FROM/JOIN list; each join pair is an FK edge (either direction) with the
    FK's own key columns.
    """
    refs = spec_refs(specs)
    tabs = cat_tables.select("schema_id", F.col("table_name").alias("tbl"))
    cols = cat_columns.select("schema_id", F.col("table_name").alias("tbl"),
                              F.col("column_name").alias("col"))
    used = spec_tables(specs).select("schema_id", "spec_id", F.explode("tables").alias("tbl"))
    bad_table = (used.join(tabs, ["schema_id", "tbl"], "left_anti")
                 .select("schema_id", "spec_id", F.lit("unknown_table").alias("kind"),
                         F.col("tbl").alias("detail")))
    bad_col = (refs.join(tabs, ["schema_id", "tbl"], "left_semi")
               .join(cols, ["schema_id", "tbl", "col"], "left_anti")
               .select("schema_id", "spec_id", F.lit("unknown_column").alias("kind"),
                       F.concat_ws(".", "tbl", "col").alias("detail")))
    out_scope = (refs.filter(~F.array_contains("present", F.col("tbl")))
                 .select("schema_id", "spec_id", F.lit("out_of_scope").alias("kind"),
                         F.concat_ws(".", "tbl", "col").alias("detail")))
    j = specs.select("schema_id", "spec_id", F.explode("joins").alias("j")).select(
        "schema_id", "spec_id", F.col("j.l_tbl").alias("a"), F.col("j.l_col").alias("ac"),
        F.col("j.r_tbl").alias("b"), F.col("j.r_col").alias("bc"))
    f = cat_fks.select("schema_id", F.col("from_table").alias("a"), F.col("from_column").alias("ac"),
                       F.col("to_table").alias("b"), F.col("to_column").alias("bc"))
    both = f.unionByName(f.select("schema_id", F.col("b").alias("a"), F.col("bc").alias("ac"),
                                  F.col("a").alias("b"), F.col("ac").alias("bc")))
    edge = both.select("schema_id", "a", "b").distinct()
    no_edge = (j.join(edge, ["schema_id", "a", "b"], "left_anti")
               .select("schema_id", "spec_id", F.lit("join_not_fk").alias("kind"),
                       F.concat(F.col("a"), F.lit("<->"), F.col("b")).alias("detail")))
    wrong_key = (j.join(edge, ["schema_id", "a", "b"], "left_semi")
                 .join(both, ["schema_id", "a", "ac", "b", "bc"], "left_anti")
                 .select("schema_id", "spec_id", F.lit("join_wrong_key").alias("kind"),
                         F.concat(F.col("a"), F.lit("."), F.col("ac"), F.lit("="), F.col("b"),
                                  F.lit("."), F.col("bc")).alias("detail")))
    return bad_table.unionByName(bad_col).unionByName(out_scope).unionByName(no_edge) \
        .unionByName(wrong_key)
