"""Catalog jobs: raw dictionary rows -> typed, role-tagged, join-aware catalog.

Inputs are DataFrames (any reader can provide them: JDBC dictionary views,
parquet schemas, test fixtures). Outputs follow the DDL

    cat_tables (schema_id, table_name, table_pos, is_multi_org)
    cat_columns(schema_id, table_name, col_pos, column_name, type, nullable, is_pk,
                role, business_label, lookup_type, allowed_values)
    cat_fks    (schema_id, fk_pos, from_table, from_column, to_table, to_column, declared)

Positions are explicit columns because several rules are first-in-order.
Catalog tables are metadata sized (one row per column), every step is a
join or a grouped aggregate, and nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlweave.functions.text import norm_owner, norm_type
from sqlweave.operators.ranking import rank_over

# -- fixed values of the role rules --------------------------------------------
QTY_HINTS = ("quantity", "qty")
AMOUNT_HINTS = ("amount", "total", "price", "cost", "bal", "tax", "net", "gross")
NAME_SUFFIXES = ("_name", "description", "title")
CODE_SUFFIXES = ("_number", "_code", "_num", "priority")
ID_SUFFIXES = ("_id", "key")
SKIP_SUFFIXES = ("_BAK", "_BACKUP", "_BACK", "_OLD")
ROLES = ("id", "amount", "quantity", "date", "name", "code", "org_id", "lookup",
         "flexfield_segment")
# -----------------------------------------------------------------------------


@dataclass
class RoleRules:
    """Names that make a column an org-striping column, plus FK hints."""
    org_columns: tuple = ("org_id",)
    # column name -> (target table, target column); a hint has no fallback
    fk_hints: dict = field(default_factory=dict)
    # for ``*key`` names also match after the first ``_`` (l_orderkey ~ o_orderkey)
    strip_key_prefix: bool = True
    multi_org_suffix: str = "_all"


def _any_contains(col, words):
    cond = F.lit(False)
    for w in words:
        cond = cond | col.contains(w)
    return cond


def _any_endswith(col, words):
    cond = F.lit(False)
    for w in words:
        cond = cond | col.endswith(w)
    return cond


def infer_role(name, ctype, is_pk, business_label, lookup_type, org_columns=("org_id",)):
    """Role by ordered rules; the first hit wins.

    flexfield, lookup, org, PK or id suffix, DATE type, number with a quantity
    hint, number with an amount hint, name suffix, code suffix, else NULL.
    """
    n = F.lower(name)
    return (F.when(business_label.isNotNull(), F.lit("flexfield_segment"))
            .when(lookup_type.isNotNull(), F.lit("lookup"))
            .when(n.isin(*org_columns), F.lit("org_id"))
            .when(is_pk | _any_endswith(n, ID_SUFFIXES), F.lit("id"))
            .when(ctype == "DATE", F.lit("date"))
            .when((ctype == "NUMBER") & _any_contains(n, QTY_HINTS), F.lit("quantity"))
            .when((ctype == "NUMBER") & _any_contains(n, AMOUNT_HINTS), F.lit("amount"))
            .when((n == "name") | _any_endswith(n, NAME_SUFFIXES), F.lit("name"))
            .when(_any_endswith(n, CODE_SUFFIXES), F.lit("code")))


# -- raw dictionary readers (scope, tables, synonyms, columns, keys) -------------
def catalog_scope(installs: DataFrame, users: DataFrame, extra_owners=()) -> DataFrame:
    """Owners of products installed ('I') or shared ('S'), plus named extras."""
    spark = installs.sparkSession
    base = (installs.filter(F.col("status").isin("I", "S"))
            .join(users, "oracle_id").select(F.upper("oracle_username").alias("owner")))
    if extra_owners:
        extra = spark.createDataFrame([(o,) for o in extra_owners], "owner string")
        base = base.unionAll(extra.select(norm_owner("owner").alias("owner")))
    return base.distinct()


def catalog_tables(tables: DataFrame, scope: DataFrame, skip_suffixes=SKIP_SUFFIXES) -> DataFrame:
    """In-scope tables minus ``$`` names and backup suffixes."""
    u = F.upper("table_name")
    return (tables.withColumn("owner", F.upper("owner"))
            .join(scope, "owner", "left_semi")
            .filter(~u.contains("$") & ~_any_endswith(u, [s.upper() for s in skip_suffixes])))


def catalog_synonyms(tables: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Canonical name: synonym if any (of several the table's own name, else the first), else ``owner.table``; lower case.

    Returns (owner, table_name, canonical, table_pos) with positions in
    sorted canonical order, as the live reader sorts names.
    """
    syn = synonyms.select(F.upper("table_owner").alias("owner"),
                          F.upper("table_name").alias("base"),
                          F.lower("synonym_name").alias("syn"))
    # one name per table: a synonym that spells the table's name comes first
    syn = syn.groupBy("owner", "base").agg(F.min(F.struct(F.col("syn") != F.lower("base"), "syn")).alias("s")).select(
        "owner", "base", F.col("s.syn").alias("syn"))
    t = tables.select(F.upper("owner").alias("owner"), F.upper("table_name").alias("base"))
    canon = (t.join(syn, ["owner", "base"], "left")
             .select("owner", "base",
                     F.coalesce("syn", F.lower(F.concat_ws(".", "owner", "base"))).alias("canonical")))
    names = canon.select("canonical").distinct()
    # position in sorted name order, without a single-task window
    pos = rank_over(names, "canonical", [], func="row_number", out="table_pos", ascending=True)
    return canon.join(pos, "canonical").select("owner", F.col("base").alias("table_name"),
                                                "canonical", "table_pos")


def catalog_columns(columns: DataFrame, canon: DataFrame) -> DataFrame:
    """Columns of kept tables in column_id order; nullable = 'Y'."""
    c = columns.select(F.upper("owner").alias("owner"), F.upper("table_name").alias("table_name"),
                       F.lower("column_name").alias("column_name"), "data_type",
                       (F.upper("nullable") == "Y").alias("nullable"), "column_id")
    return (c.join(canon, ["owner", "table_name"])
            .select(F.col("canonical").alias("table_name"), "table_pos",
                    F.col("column_id").cast("int").alias("col_pos"),
                    "column_name", "data_type", "nullable"))


def catalog_pks(constraints: DataFrame, cons_columns: DataFrame, canon: DataFrame) -> DataFrame:
    """PK columns: constraints of type P joined to their columns."""
    p = constraints.filter(F.col("constraint_type") == "P").select("owner", "constraint_name",
                                                                   "table_name")
    cc = cons_columns.select("owner", "constraint_name", "column_name")
    return (p.join(cc, ["owner", "constraint_name"])
            .select(F.upper("owner").alias("owner"), F.upper("table_name").alias("table_name"),
                    F.lower("column_name").alias("column_name"))
            .join(canon, ["owner", "table_name"])
            .select(F.col("canonical").alias("table_name"), "column_name"))


def catalog_declared_fks(constraints: DataFrame, cons_columns: DataFrame,
                         canon: DataFrame) -> DataFrame:
    """Type R constraints: own columns matched to the target key's columns by position."""
    fc = constraints.filter(F.col("constraint_type") == "R").select(
        "owner", "constraint_name", "table_name", "r_owner", "r_constraint_name")
    cc = cons_columns.select("owner", "constraint_name", "column_name", "position")
    src = fc.join(cc, ["owner", "constraint_name"]).select(
        F.col("owner").alias("f_owner"), F.col("table_name").alias("f_table"),
        F.col("column_name").alias("f_col"), "position", "r_owner", "r_constraint_name")
    pc = constraints.select(F.col("owner").alias("p_owner"),
                            F.col("constraint_name").alias("p_cons"),
                            F.col("table_name").alias("p_table"))
    pcc = cons_columns.select(F.col("owner").alias("p_owner"),
                              F.col("constraint_name").alias("p_cons"),
                              F.col("column_name").alias("p_col"),
                              F.col("position").alias("p_position"))
    tgt = pc.join(pcc, ["p_owner", "p_cons"])
    j = src.join(tgt, (src.r_owner == tgt.p_owner) & (src.r_constraint_name == tgt.p_cons)
                 & (src.position == tgt.p_position))
    a = canon.select(F.col("owner").alias("ao"), F.col("table_name").alias("at"),
                     F.col("canonical").alias("from_table"))
    b = canon.select(F.col("owner").alias("bo"), F.col("table_name").alias("bt"),
                     F.col("canonical").alias("to_table"))
    return (j.join(a, (F.upper(j.f_owner) == a.ao) & (F.upper(j.f_table) == a.at))
            .join(b, (F.upper(j.p_owner) == b.bo) & (F.upper(j.p_table) == b.bt))
            .select("from_table", F.lower("f_col").alias("from_column"),
                    "to_table", F.lower("p_col").alias("to_column")))


# -- the extraction ---------------------------------------------------------------
def extract_catalog(columns: DataFrame, pks: DataFrame, flex: DataFrame | None = None,
                    lookups: DataFrame | None = None, declared_fks: DataFrame | None = None,
                    rules: RoleRules | None = None, schema_id: str = "catalog"):
    """Raw rows -> (cat_tables, cat_columns, cat_fks).

    ``columns``: table_name, table_pos, col_pos, column_name, data_type, nullable
    ``pks``: table_name, column_name (composite keys give several rows)
    ``flex``: table_name, column_name, business_label
    ``lookups``: table_name, column_name, lookup_type, allowed_values ARRAY<STRING>
    ``declared_fks``: from_table, from_column, to_table, to_column
    """
    rules = rules or RoleRules()
    spark = columns.sparkSession
    flex = flex if flex is not None else spark.createDataFrame(
        [], "table_name string, column_name string, business_label string")
    lookups = lookups if lookups is not None else spark.createDataFrame(
        [], "table_name string, column_name string, lookup_type string, "
            "allowed_values array<string>")
    declared_fks = declared_fks if declared_fks is not None else spark.createDataFrame(
        [], "from_table string, from_column string, to_table string, to_column string")

    pk_flag = pks.select("table_name", F.lower("column_name").alias("column_name"),
                         F.lit(True).alias("is_pk")).distinct()
    cols = (columns.withColumn("column_name", F.lower("column_name"))
            .withColumn("type", norm_type("data_type"))
            .join(pk_flag, ["table_name", "column_name"], "left")
            .withColumn("is_pk", F.coalesce("is_pk", F.lit(False)))
            .join(flex.withColumn("column_name", F.lower("column_name")),
                  ["table_name", "column_name"], "left")
            .join(lookups.withColumn("column_name", F.lower("column_name")),
                  ["table_name", "column_name"], "left"))
    # a flexfield segment wins over a lookup for the same column
    cols = (cols.withColumn("role", infer_role(F.col("column_name"), F.col("type"), F.col("is_pk"),
                                               F.col("business_label"), F.col("lookup_type"),
                                               rules.org_columns))
            .withColumn("lookup_type", F.when(F.col("business_label").isNull(), F.col("lookup_type")))
            .withColumn("allowed_values", F.when(F.col("role") == "lookup",
                                                 F.coalesce("allowed_values",
                                                            F.array().cast("array<string>")))
                        .otherwise(F.array().cast("array<string>"))))
    cat_columns = cols.select(
        F.lit(schema_id).alias("schema_id"), "table_name", "table_pos", "col_pos", "column_name",
        "type", "nullable", "is_pk", "role", "business_label", "lookup_type", "allowed_values")

    cat_tables, cat_fks = tables_and_fks(cat_columns, rules, schema_id, declared_fks)
    return cat_tables, cat_columns, cat_fks


def tables_and_fks(cat_columns: DataFrame, rules: RoleRules | None = None,
                   schema_id: str = "catalog", declared_fks: DataFrame | None = None):
    """(cat_tables, cat_fks) derived from finished cat_columns."""
    rules = rules or RoleRules()
    spark = cat_columns.sparkSession
    if declared_fks is None:
        declared_fks = spark.createDataFrame(
            [], "from_table string, from_column string, to_table string, to_column string")
    org = F.max(F.col("role") == "org_id")
    cat_tables = (cat_columns.groupBy("schema_id", "table_name", "table_pos")
                  .agg(org.alias("_has_org"))
                  .withColumn("is_multi_org",
                              F.col("table_name").endswith(rules.multi_org_suffix) & F.col("_has_org"))
                  .drop("_has_org"))
    cat_fks = infer_fks(cat_columns, declared_fks, rules)
    return cat_tables, cat_fks.withColumn("schema_id", F.lit(schema_id))


def infer_fks(cat_columns: DataFrame, declared_fks: DataFrame, rules: RoleRules | None = None
              ) -> DataFrame:
    """Declared FKs first, then one inferred FK per non-PK id-like column.

    Target: the hint for that column name if any (no fallback when the hinted
    table is absent); else the first table (by position) owning a PK column of
    that name; else, for ``*key`` names, the first table owning a PK column
    with the same name after its first ``_``. Self links are dropped and
    duplicates removed; ``fk_pos`` orders declared before inferred, then by
    table and column position.
    """
    rules = rules or RoleRules()
    spark = cat_columns.sparkSession
    tables = cat_columns.select("table_name", "table_pos").distinct()
    n = F.col("column_name")
    stripped = F.regexp_replace(n, r"^[^_]*_", "")

    pkc = cat_columns.filter("is_pk").select("table_name", "table_pos", "column_name")
    owner_full = (pkc.groupBy("column_name")
                  .agg(F.min_by(F.struct("table_name", "column_name"), "table_pos").alias("o"))
                  .select(F.col("column_name").alias("m_full"),
                          F.col("o.table_name").alias("full_table"),
                          F.col("o.column_name").alias("full_col")))
    owner_strip = (pkc.filter(n.endswith("key")).withColumn("m", stripped)
                   .groupBy("m")
                   .agg(F.min_by(F.struct("table_name", "column_name"), "table_pos").alias("o"))
                   .select(F.col("m").alias("m_strip"),
                           F.col("o.table_name").alias("strip_table"),
                           F.col("o.column_name").alias("strip_col")))
    hints = spark.createDataFrame(
        [(k, v[0], v[1]) for k, v in rules.fk_hints.items()],
        "h_col string, hint_table string, hint_col string")

    cand = cat_columns.filter(~F.col("is_pk") & ~n.isin(*rules.org_columns)
                              & _any_endswith(n, ID_SUFFIXES))
    cand = (cand.join(hints, n == hints.h_col, "left")
            .join(owner_full, n == owner_full.m_full, "left"))
    if rules.strip_key_prefix:
        cand = cand.join(owner_strip, n.endswith("key") & (stripped == owner_strip.m_strip), "left")
    else:
        cand = (cand.withColumn("strip_table", F.lit(None).cast("string"))
                .withColumn("strip_col", F.lit(None).cast("string")))
    full_ok = F.col("full_table").isNotNull() & (F.col("full_table") != F.col("table_name"))
    strip_ok = F.col("strip_table").isNotNull() & (F.col("strip_table") != F.col("table_name"))
    inferred = cand.select(
        F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"),
        F.when(F.col("hint_table").isNotNull(), F.col("hint_table"))
        .when(full_ok, F.col("full_table")).when(strip_ok, F.col("strip_table")).alias("to_table"),
        F.when(F.col("hint_table").isNotNull(), F.col("hint_col"))
        .when(full_ok, F.col("full_col")).when(strip_ok, F.col("strip_col")).alias("to_column"),
        F.lit(False).alias("declared"),
        (F.lit(1_000_000_000_000_000) + F.col("table_pos").cast("long") * 1_000_000
         + F.col("col_pos")).alias("fk_pos"),
    ).filter(F.col("to_table").isNotNull())

    declared = declared_fks.select(
        "from_table", F.lower("from_column").alias("from_column"), "to_table",
        F.lower("to_column").alias("to_column"), F.lit(True).alias("declared")).distinct()
    # in order of their columns, then their targets: the same whatever order the reader gave
    places = cat_columns.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"),
                                "table_pos", "col_pos")
    declared = declared.join(places, ["from_table", "from_column"], "left").withColumn(
        "fk_pos", F.row_number().over(Window.partitionBy("from_table", "from_column").orderBy("to_table", "to_column"))
        + (F.coalesce("table_pos", F.lit(0)).cast("long") * 1_000_000 + F.coalesce("col_pos", F.lit(0))) * 1_000).drop(
        "table_pos", "col_pos")
    both = declared.unionByName(inferred)
    # both ends must be catalog tables; no self links; first occurrence wins
    both = (both.join(tables.select(F.col("table_name").alias("to_table")), "to_table", "left_semi")
            .filter(F.col("from_table") != F.col("to_table")))
    key = ["from_table", "from_column", "to_table", "to_column"]
    return (both.groupBy(*key)
            .agg(F.min_by("declared", "fk_pos").alias("declared"), F.min("fk_pos").alias("fk_pos"))
            .select("fk_pos", *key, "declared"))


# -- derived views ---------------------------------------------------------------
def columns_by_role(cat_columns: DataFrame, roles=None) -> DataFrame:
    """Columns having one of ``roles`` (all roles if None)."""
    df = cat_columns.filter(F.col("role").isNotNull())
    if roles:
        df = df.filter(F.col("role").isin(*roles))
    return df


def catalog_summary(cat_columns: DataFrame, cat_fks: DataFrame) -> DataFrame:
    """Per table: columns, labelled columns, outgoing and incoming FKs."""
    per = (cat_columns.groupBy("table_name")
           .agg(F.count("column_name").alias("n_columns"),
                F.count("business_label").alias("n_labelled")))
    out = cat_fks.groupBy(F.col("from_table").alias("table_name")).agg(F.count("*").alias("n_fk_out"))
    inc = cat_fks.groupBy(F.col("to_table").alias("table_name")).agg(F.count("*").alias("n_fk_in"))
    return (per.join(out, "table_name", "left").join(inc, "table_name", "left")
            .fillna(0, ["n_fk_out", "n_fk_in"]))


def merge_catalogs(named) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Union catalogs, prefixing table names (columns untouched).

    ``named``: iterable of (prefix, cat_tables, cat_columns, cat_fks).
    """
    ts, cs, fs = [], [], []
    tables_before = fks_before = 0
    for prefix, t, c, f in named:
        p = F.lit(prefix)
        pos = (F.col("table_pos") + tables_before).cast("long")
        ts.append(t.withColumn("table_name", F.concat(p, "table_name")).withColumn("table_pos", pos))
        cs.append(c.withColumn("table_name", F.concat(p, "table_name")).withColumn("table_pos", pos))
        fs.append(f.withColumn("from_table", F.concat(p, "from_table"))
                  .withColumn("to_table", F.concat(p, "to_table"))
                  .withColumn("fk_pos", (F.col("fk_pos") + fks_before).cast("long")))
        # positions continue where the catalog before ended, so they stay unique
        tables_before += _span(t, "table_pos")
        fks_before += _span(f, "fk_pos")
    return _union(ts), _union(cs), _union(fs)


def _span(df: DataFrame, pos: str) -> int:
    """One more than the largest position."""
    top = df.agg(F.max(pos)).first()[0]
    return 0 if top is None else int(top) + 1


def prefix_catalog(cat_tables, cat_columns, cat_fks, prefixes, schema_id="catalog"):
    """Merge copies of one catalog, one per prefix (a list of strings).

    Each row is exploded over the prefix array, so the copies are produced in
    the tasks that hold the catalog rows. Each copy's positions are moved past those
    of the copy before, so they stay unique.
    """
    tables, fks = _span(cat_tables, "table_pos"), _span(cat_fks, "fk_pos")
    arr = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(i).alias("copy_pos"))
                    for i, p in enumerate(prefixes)])

    def rep(df):
        return df.withColumn("_p", F.explode(arr)).withColumn("prefix", F.col("_p.prefix")) \
                 .withColumn("copy_pos", F.col("_p.copy_pos").cast("long")).drop("_p")

    t = rep(cat_tables).select(
        F.lit(schema_id).alias("schema_id"), F.concat("prefix", "table_name").alias("table_name"),
        (F.col("copy_pos") * tables + F.col("table_pos")).alias("table_pos"), "is_multi_org")
    keep = [x for x in cat_columns.columns if x not in ("schema_id", "table_name", "table_pos")]
    c = rep(cat_columns).select(
        F.lit(schema_id).alias("schema_id"), F.concat("prefix", "table_name").alias("table_name"),
        (F.col("copy_pos") * tables + F.col("table_pos")).alias("table_pos"), *keep)
    f = rep(cat_fks).select(
        F.lit(schema_id).alias("schema_id"), (F.col("copy_pos") * fks + F.col("fk_pos")).alias("fk_pos"),
        F.concat("prefix", "from_table").alias("from_table"), "from_column",
        F.concat("prefix", "to_table").alias("to_table"), "to_column", "declared")
    return t, c, f


def _union(dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


# -- persistence -------------------------------------------------------------------
def schema_save(cat_tables: DataFrame, cat_columns: DataFrame, cat_fks: DataFrame) -> DataFrame:
    """One JSON document per schema_id with every annotation kept."""
    cols = (cat_columns.groupBy("schema_id", "table_name")
            .agg(F.sort_array(F.collect_list(F.struct(
                "col_pos", "column_name", "type", "nullable", "is_pk", "role",
                "business_label", "lookup_type", "allowed_values"))).alias("columns")))
    tabs = (cat_tables.join(cols, ["schema_id", "table_name"], "left")
            .groupBy("schema_id")
            .agg(F.sort_array(F.collect_list(F.struct("table_pos", "table_name", "is_multi_org",
                                                      "columns"))).alias("tables")))
    fks = (cat_fks.groupBy("schema_id")
           .agg(F.sort_array(F.collect_list(F.struct("fk_pos", "from_table", "from_column",
                                                     "to_table", "to_column", "declared")))
                .alias("foreign_keys")))
    doc = tabs.join(fks, "schema_id", "left")
    return doc.select("schema_id", F.to_json(F.struct("tables", "foreign_keys")).alias("json"))


_DOC = T.StructType([
    T.StructField("tables", T.ArrayType(T.StructType([
        T.StructField("table_pos", T.LongType()), T.StructField("table_name", T.StringType()),
        T.StructField("is_multi_org", T.BooleanType()),
        T.StructField("columns", T.ArrayType(T.StructType([
            T.StructField("col_pos", T.IntegerType()), T.StructField("column_name", T.StringType()),
            T.StructField("type", T.StringType()), T.StructField("nullable", T.BooleanType()),
            T.StructField("is_pk", T.BooleanType()), T.StructField("role", T.StringType()),
            T.StructField("business_label", T.StringType()),
            T.StructField("lookup_type", T.StringType()),
            T.StructField("allowed_values", T.ArrayType(T.StringType()))])))]))),
    T.StructField("foreign_keys", T.ArrayType(T.StructType([
        T.StructField("fk_pos", T.LongType()), T.StructField("from_table", T.StringType()),
        T.StructField("from_column", T.StringType()), T.StructField("to_table", T.StringType()),
        T.StructField("to_column", T.StringType()), T.StructField("declared", T.BooleanType())]))),
])


def schema_load(docs: DataFrame):
    """Inverse of :func:`schema_save`; missing annotations get loading defaults
    (nullable true, not a PK, no values)."""
    d = docs.select("schema_id", F.from_json("json", _DOC).alias("d"))
    t = d.select("schema_id", F.explode("d.tables").alias("t"))
    cat_tables = t.select("schema_id", "t.table_name", "t.table_pos",
                          F.coalesce("t.is_multi_org", F.lit(False)).alias("is_multi_org"))
    c = t.select("schema_id", F.col("t.table_name").alias("table_name"),
                 F.col("t.table_pos").alias("table_pos"), F.explode("t.columns").alias("c"))
    cat_columns = c.select(
        "schema_id", "table_name", "table_pos", "c.col_pos", "c.column_name", "c.type",
        F.coalesce("c.nullable", F.lit(True)).alias("nullable"),
        F.coalesce("c.is_pk", F.lit(False)).alias("is_pk"), "c.role", "c.business_label",
        "c.lookup_type",
        F.coalesce("c.allowed_values", F.array().cast("array<string>")).alias("allowed_values"))
    f = d.select("schema_id", F.explode("d.foreign_keys").alias("f"))
    cat_fks = f.select("f.fk_pos", "f.from_table", "f.from_column", "f.to_table", "f.to_column",
                       F.coalesce("f.declared", F.lit(False)).alias("declared"), "schema_id")
    return cat_tables, cat_columns, cat_fks

