"""Bulk lint and repair of SQL text against a catalog, with column expressions.

Lint recipe per statement (all JVM-side):
1. one ``regexp_extract_all`` cuts the text into tokens; comments go, quoted literals stay whole,
   so nothing inside either is read as SQL;
2. one fold over the tokens keeps a stack of brackets, each with its scope and the clause that
   it is in, and notes what each token is: a table after FROM, JOIN or a comma of a FROM list, its alias,
   a common table expression, an ``alias.column`` reference or a pair ``a.x = b.y``;
3. a reference takes the alias of the innermost scope that has it: a subquery sees those
   outside it, the outer query sees none of a subquery's, and both sides of a UNION are apart.

Issues: text that is no query (no SELECT or WITH, an empty select list, brackets or quotes
that don't close); unknown table; unknown ``alias.column`` on a known table; a join
between two tables with no FK edge; a join on columns that are not the key of
an FK between the two tables (any FK of the pair counts). An unknown alias is
let pass and unqualified columns are not checked.

Catalog-sized inputs are joined by key; the statements themselves are only
exploded into their references, so millions of statements lint in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.session import write_table

# -- fixed values -------------------------------------------------------------------
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
# words that can follow a table name and are never its alias
NOT_ALIAS = ("ON", "WHERE", "JOIN", "GROUP", "ORDER", "HAVING", "LIMIT", "INNER", "LEFT",
             "RIGHT", "FULL", "OUTER", "CROSS", "UNION", "FETCH", "USING", "NATURAL",
             "WINDOW", "QUALIFY", "INTERSECT", "EXCEPT", "MINUS", "SELECT", "AS", "FROM", "LATERAL", "TABLESAMPLE")
AFTER_FROM = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "FETCH", "WINDOW", "QUALIFY")
SET_WORDS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
# ------------------------------------------------------------------------------------

TOKEN_RE = (r"'(?:[^']|'')*'|--[^\n]*|/\*(?s:.*?)\*/|" + IDENT + r"(?:\." + IDENT + r")*|[0-9]+(?:\.[0-9]+)?|\S")
_NAME_RE, _REF_RE = "^" + IDENT + "$", "^" + IDENT + r"\." + IDENT + "$"
#: The clause that a bracket is in: nothing yet, a select list, a table is due, an alias may follow,
#: elsewhere in a FROM list, after it.
NONE, LIST, TABLE, ALIAS, JOINED, REST = "", "S", "T", "A", "J", "W"
_STACK = "array<struct<id:int,clause:string,tab:string>>"
_EVENT = "struct<pos:int,kind:string,name:string,tab:string,path:array<int>>"


def tokens(sql) -> F.Column:
    """Tokens of a statement without comments."""
    return F.filter(F.regexp_extract_all(sql, F.lit(TOKEN_RE), 0), lambda t: ~t.startswith("--") & ~t.startswith("/*"))


#: What a token can do in the fold; others (operators, literals, other keywords) change nothing and are left out.
SELECT, FROM, JOIN, ON, AFTER, SET, COMMA, OPEN, CLOSE, QUOTE, REF, NAME = range(1, 13)


def _marked(toks) -> F.Column:
    """The tokens of a token column that the fold looks at, each with its place and what it and its neighbours are."""
    at = lambda i: F.coalesce(F.get(toks, i), F.lit(""))
    seen = F.transform(toks, lambda tok, i: F.struct(
        i.cast("int").alias("pos"), tok.alias("tok"), F.upper(tok).alias("up"), F.upper(at(i + 1)).alias("nxt"),
        at(i + 2).alias("third"), F.upper(at(i - 1)).alias("before")))

    def mark(x):
        up = x["up"]
        code = (F.when(up == "SELECT", SELECT).when(up == "FROM", FROM).when(up == "JOIN", JOIN).when(up.isin("ON", "USING"), ON)
                .when(up.isin(*AFTER_FROM), AFTER).when(up.isin(*SET_WORDS), SET).when(up == ",", COMMA).when(up == "(", OPEN)
                .when(up == ")", CLOSE).when(up == "'", QUOTE).when(x["tok"].rlike(_REF_RE), REF)
                .when(x["tok"].rlike(_NAME_RE) & ~up.isin(*NOT_ALIAS), NAME).otherwise(0))
        cte = (x["nxt"] == "AS") & (x["third"] == "(") & x["before"].isin("WITH", "RECURSIVE", ",")
        return F.struct(x["pos"].alias("pos"), code.alias("code"), F.lower(x["tok"]).alias("name"), cte.alias("cte"),
                        x["nxt"].isin("SELECT", "WITH", "(").alias("subquery"),
                        F.when((x["nxt"] == "=") & x["third"].rlike(_REF_RE), F.lower(x["third"])).alias("other"))
    return F.filter(F.transform(seen, mark), lambda x: x["code"] != 0)


def _events(toks) -> F.Column:
    """struct(stack, events, bad): what the fold over a token column finds."""
    entry = lambda i, clause, tab: F.struct(i.cast("int").alias("id"), clause.alias("clause"),
                                            tab.cast("string").alias("tab"))
    nothing = F.lit(None).cast("string")

    def step(acc, x):
        code, pos = x["code"], x["pos"]
        stack, depth = acc["stack"], F.size(acc["stack"])
        top = F.element_at(stack, -1)
        clause, below = top["clause"], F.slice(stack, 1, depth - 1)
        is_table, is_alias = (code == NAME) & (clause == TABLE), (code == NAME) & (clause == ALIAS)
        qualified, ref = (code == REF) & (clause == TABLE), (code == REF) & (clause != TABLE)
        turn = (F.when(code == SELECT, LIST).when((code == FROM) & (clause != NONE), TABLE).when(code == JOIN, TABLE)
                .when(code == ON, JOINED).when(code == AFTER, REST)
                .when((code == COMMA) & clause.isin(ALIAS, JOINED), TABLE)
                .when(is_table | qualified, ALIAS).when(is_alias, JOINED).otherwise(clause))
        tab = F.when(is_table, x["name"]).when(qualified, nothing).otherwise(top["tab"])
        # a bracket where a table is due is a subquery with an alias to come, or a bracketed join of the same scope
        opened = F.when((clause == TABLE) & ~x["subquery"], F.concat(stack, F.array(entry(top["id"], F.lit(TABLE), nothing)))
                        ).otherwise(F.concat(below, F.array(entry(
                            top["id"], F.when(clause == TABLE, ALIAS).otherwise(clause),
                            F.when(clause == TABLE, nothing).otherwise(top["tab"])), entry(pos + 1, F.lit(NONE), nothing))))
        after = (F.when(code == OPEN, opened).when((code == CLOSE) & (depth > 1), below)
                 .when(code == SET, F.concat(below, F.array(entry(pos + 1, F.lit(NONE), nothing))))
                 .when(ref | code.isin(CLOSE, QUOTE), stack)
                 .otherwise(F.concat(below, F.array(entry(top["id"], turn, tab)))))
        kind = (F.when(is_table, "table").when(is_alias, "alias").when((code == NAME) & x["cte"], "cte")
                .when(ref & x["other"].isNotNull(), "pair").when(ref, "ref"))
        event = F.struct(pos.alias("pos"), kind.alias("kind"), x["name"].alias("name"),
                         F.when(is_alias, top["tab"]).when(ref, x["other"]).alias("tab"),
                         F.transform(stack, lambda x: x["id"]).alias("path"))
        events = F.when(is_table | is_alias | ref | ((code == NAME) & x["cte"]),
                        F.concat(acc["events"], F.array(event))).otherwise(acc["events"])
        return F.struct(after.alias("stack"), events.alias("events"),
                        (acc["bad"] | ((code == CLOSE) & (depth == 1)) | (code == QUOTE)).alias("bad"))
    zero = F.struct(F.array(entry(F.lit(0), F.lit(NONE), nothing)).cast(_STACK).alias("stack"),
                    F.array().cast(f"array<{_EVENT}>").alias("events"), F.lit(False).alias("bad"))
    return F.aggregate(_marked(F.col(toks)), zero, step)


def parsed(stmts: DataFrame) -> DataFrame:
    """(schema_id, sql_id, toks, found) of (schema_id, sql_id, sql) statements, folded once and written.

    The statements are dealt out to all tasks first: those of one file's row group would all be folded by one.
    """
    spark = stmts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = stmts.select("schema_id", "sql_id", "sql").repartition(parts).select(
        "schema_id", "sql_id", F.coalesce(tokens(F.col("sql")), F.array().cast("array<string>")).alias("toks"))
    return write_table(t.withColumn("found", _events("toks")), "parsed")


def references(stmts: DataFrame) -> dict:
    """Tables, aliases, references and pairs of (schema_id, sql_id, sql) statements.

    ``aliases`` are those of a whole statement (the last one wins); ``defined`` has each scope's own.
    """
    return _references(parsed(stmts))


def _references(parsed: DataFrame) -> dict:
    key = ["schema_id", "sql_id"]
    e = parsed.select(*key, F.explode("found.events").alias("e")).select(
        *key, "e.pos", "e.kind", "e.name", F.col("e.tab").alias("tab"), "e.path")
    scope = F.element_at("path", -1).alias("scope")
    ctes = e.filter("kind = 'cte'").select(*key, "name").distinct()
    tables = e.filter("kind = 'table'").join(ctes, [*key, "name"], "left_anti")
    # a table goes by its own name, too; a name of a common table expression or subquery has no table
    own = e.filter("kind = 'table'").join(ctes.withColumn("_cte", F.lit(True)), [*key, "name"], "left").select(
        *key, scope, F.col("name").alias("alias"), F.when(F.col("_cte").isNull(), F.col("name")).alias("table_name"), "pos")
    given = e.filter("kind = 'alias'").join(ctes.withColumnRenamed("name", "tab").withColumn("_cte", F.lit(True)),
                                            [*key, "tab"], "left").select(
        *key, scope, F.col("name").alias("alias"), F.when(F.col("_cte").isNull(), F.col("tab")).alias("table_name"), "pos")
    # an alias beats a table's own name wherever it stands
    defined = own.withColumn("given", F.lit(0)).unionByName(given.withColumn("given", F.lit(1)))
    part = lambda c, i: F.element_at(F.split(c, r"\."), i)
    refs = e.filter("kind in ('ref', 'pair')")
    left = refs.select(*key, "pos", "path", F.lit(0).alias("side"), F.col("name").alias("ref"))
    right = refs.filter("kind = 'pair'").select(*key, "pos", "path", F.lit(1).alias("side"), F.col("tab").alias("ref"))
    refs = left.unionByName(right).select(*key, "pos", "side", "path", part("ref", 1).alias("alias"),
                                          part("ref", 2).alias("column_name"))
    return {"tables": tables.select(*key, "pos", F.col("name").alias("table_name")),
            "aliases": defined.filter("table_name is not null").groupBy(*key, "alias").agg(
                F.max_by("table_name", F.struct("given", "pos")).alias("table_name")),
            "defined": defined, "refs": refs}


def resolve(refs: DataFrame, defined: DataFrame) -> DataFrame:
    """``refs`` with the table of the innermost scope that has their alias; others are left out."""
    key = ["schema_id", "sql_id"]
    each = refs.select(*key, "pos", "side", "alias", "column_name", F.posexplode("path").alias("depth", "scope"))
    met = each.join(defined.withColumnRenamed("pos", "def_pos"), [*key, "scope", "alias"])
    return met.groupBy(*key, "pos", "side", "alias", "column_name").agg(F.max_by(
        F.struct("table_name"), F.struct("depth", "given", "def_pos")).alias("t")).select(
        *key, "pos", "side", "alias", "column_name", "t.table_name").filter("table_name is not null")


def lint_sql(stmts: DataFrame, cat_columns: DataFrame, cat_fks: DataFrame) -> DataFrame:
    """(schema_id, sql_id, kind, detail) for every issue; no row = clean."""
    text = parsed(stmts)
    r = _references(text)
    ctabs = cat_columns.select("schema_id", F.lower("table_name").alias("table_name")).distinct()
    ccols = cat_columns.select("schema_id", F.lower("table_name").alias("table_name"),
                               F.lower("column_name").alias("column_name"))
    unknown_table = (r["tables"].select("schema_id", "sql_id", "table_name").distinct()
                     .join(ctabs, ["schema_id", "table_name"], "left_anti")
                     .select("schema_id", "sql_id", F.lit("unknown_table").alias("kind"),
                             F.col("table_name").alias("detail")))
    resolved = write_table(resolve(r["refs"], r["defined"]), "resolved")
    unknown_col = (resolved.join(ctabs, ["schema_id", "table_name"], "left_semi")
                   .join(ccols, ["schema_id", "table_name", "column_name"], "left_anti")
                   .select("schema_id", "sql_id", F.lit("unknown_column").alias("kind"),
                           F.concat_ws(".", "table_name", "column_name").alias("detail"))
                   .distinct())
    side = lambda n: resolved.filter(F.col("side") == n - 1).select(
        "schema_id", "sql_id", "pos", F.col("alias").alias(f"a{n}"), F.col("table_name").alias(f"t{n}"),
        F.col("column_name").alias(f"c{n}"))
    p = side(1).join(side(2), ["schema_id", "sql_id", "pos"]).filter("a1 != a2")
    f = cat_fks.select("schema_id", F.lower("from_table").alias("t1"),
                       F.lower("from_column").alias("c1"), F.lower("to_table").alias("t2"),
                       F.lower("to_column").alias("c2"))
    both = f.unionByName(f.select("schema_id", F.col("t2").alias("t1"), F.col("c2").alias("c1"),
                                  F.col("t1").alias("t2"), F.col("c1").alias("c2")))
    edge = both.select("schema_id", "t1", "t2").distinct()
    not_edge = (p.join(edge, ["schema_id", "t1", "t2"], "left_anti")
                .select("schema_id", "sql_id", F.lit("join_not_fk").alias("kind"),
                        F.concat(F.col("t1"), F.lit(" with "), F.col("t2")).alias("detail")))
    wrong_key = (p.join(edge, ["schema_id", "t1", "t2"], "left_semi")
                 .join(both, ["schema_id", "t1", "c1", "t2", "c2"], "left_anti")
                 .select("schema_id", "sql_id", F.lit("join_wrong_key").alias("kind"),
                         F.concat(F.col("t1"), F.lit("."), F.col("c1"), F.lit("="), F.col("t2"),
                                  F.lit("."), F.col("c2")).alias("detail")))
    words = F.filter("toks", lambda t: t != "(")
    first, second = F.upper(F.get(words, 0)), F.upper(F.get(words, 1))
    query = first.isin("SELECT", "WITH") & second.isNotNull() & ~((first == "SELECT") & (second == "FROM"))
    closed = (F.size("found.stack") == 1) & ~F.col("found.bad")
    no_query = (text.filter(~F.coalesce(query & closed, F.lit(False)))
                .select("schema_id", "sql_id", F.lit("not_a_query").alias("kind"),
                        F.substring(F.array_join("toks", " "), 1, 60).alias("detail")))
    return no_query.unionByName(unknown_table).unionByName(unknown_col).unionByName(not_edge).unionByName(wrong_key)


# -- repair ---------------------------------------------------------------------------------
def repair_flexfield(preds: DataFrame, cat_columns: DataFrame) -> DataFrame:
    """If the question names exactly one flexfield label and the SQL uses other
    flexfield columns, every flexfield ref is rewritten to that label's column.

    ``preds``: (schema_id, sql_id, question, sql). Adds ``sql_repaired``.
    """
    flex = (cat_columns.filter(F.col("role") == "flexfield_segment")
            .filter(F.col("business_label").isNotNull())
            .groupBy("schema_id")
            .agg(F.collect_set(F.struct(F.lower("business_label").alias("label"),
                                        F.col("column_name").alias("col"))).alias("flex")))
    j = preds.join(flex, "schema_id", "left")
    cols_re = F.concat(F.lit(r"(\b\w+\.)("), F.array_join(F.transform("flex", lambda x: x["col"]),
                                                          "|"), F.lit(r")\b"))
    wanted = F.array_distinct(F.transform(
        F.filter("flex", lambda x: F.lower(F.col("question")).contains(x["label"])),
        lambda x: x["col"]))
    used = F.array_distinct(F.regexp_extract_all("sql", cols_re, 2))
    fix = ((F.size(wanted) == 1) & (F.size(used) > 0)
           & ~((F.size(used) == 1) & (F.try_element_at(used, F.lit(1)) == F.try_element_at(wanted, F.lit(1)))))
    repaired = F.regexp_replace("sql", cols_re,
                                F.concat(F.lit("$1"), F.try_element_at(wanted, F.lit(1))))
    return j.withColumn("sql_repaired", F.when(F.col("flex").isNotNull() & fix, repaired)
                        .otherwise(F.col("sql"))).drop("flex")


_EQ_RE = r"(?i)\b(" + IDENT + r")\.(" + IDENT + r")(\s*=\s*')([^']*)(')"


def lookup_domains(cat_columns: DataFrame) -> DataFrame:
    """(schema_id, table_name, column_name, value): the allowed values as rows."""
    return cat_columns.filter(F.col("role") == "lookup").select(
        "schema_id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"),
        F.explode("allowed_values").alias("value"))


def _words(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), 0)


def repair_lookup(preds: DataFrame, cat_columns: DataFrame, sql_col: str = "sql",
                  domains: DataFrame | None = None) -> DataFrame:
    """A literal outside a lookup column's domain becomes the allowed value that the
    question names as a whole word, if it names exactly one; codes of one or two
    characters must match in case. The alias is resolved to its table first, so
    only that table's domain applies, and only predicates on that very alias and
    column change. Adds ``sql_repaired``.

    The domain is a table (``domains``, by default the catalog's lists as rows), looked up by the
    longest word of each value: a value named in a question has all its words there, so
    the question's words join the values that may be named, and those are checked whole.
    """
    key = ["schema_id", "table_name", "column_name"]
    stmts = preds.select("schema_id", "sql_id", F.col(sql_col).alias("sql"))
    amap = references(stmts)["aliases"]
    eqs = preds.select("schema_id", "sql_id", "question", F.explode(F.arrays_zip(
        F.regexp_extract_all(sql_col, F.lit(_EQ_RE), 0).alias("text"),
        F.regexp_extract_all(sql_col, F.lit(_EQ_RE), 1).alias("alias"),
        F.regexp_extract_all(sql_col, F.lit(_EQ_RE), 2).alias("col"),
        F.regexp_extract_all(sql_col, F.lit(_EQ_RE), 4).alias("val"))).alias("e"))
    eqs = eqs.select("schema_id", "sql_id", "question", "e.text", F.lower("e.alias").alias("alias"),
                     F.lower("e.col").alias("column_name"), F.col("e.val").alias("val"))
    values = (lookup_domains(cat_columns) if domains is None else domains).select(*key, "value").distinct()
    longest = F.element_at(F.sort_array(F.transform(_words(F.col("value")), lambda w: F.struct(
        (-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    index = values.withColumn("word", F.when(F.size(_words(F.col("value"))) > 0, longest).otherwise(""))
    # the table of each literal; those that are allowed values stay
    outside = eqs.join(amap, ["schema_id", "sql_id", "alias"]).join(
        values.withColumnRenamed("value", "val"), [*key, "val"], "left_anti")
    whole = F.concat(F.when(F.length("value") > 2, F.lit("(?i)")).otherwise(F.lit("")),
                     F.lit(r"(?<!\w)\Q"), "value", F.lit(r"\E(?!\w)"))
    asked = outside.select(*key, "sql_id", "text", "question", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), _words(F.col("question"))))).alias("word"))
    named = asked.join(index, [*key, "word"]).filter(F.regexp_like("question", whole)).groupBy(
        *key, "sql_id", "text").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n")).filter("n = 1")
    fixes = (named.select("schema_id", "sql_id", "text", F.concat(
        F.regexp_extract("text", r"^(.*')[^']*'$", 1), "value", F.lit("'")).alias("new_text"))
        .groupBy("schema_id", "sql_id").agg(F.sort_array(F.collect_list(F.struct("text", "new_text"))).alias("fixes")))
    out = preds.join(fixes, ["schema_id", "sql_id"], "left")
    applied = F.aggregate(F.coalesce("fixes", F.array().cast(
        "array<struct<text:string,new_text:string>>")), F.col(sql_col),
        lambda acc, f: F.regexp_replace(
            acc, F.concat(F.lit(r"(?<![\w.])\Q"), f["text"], F.lit(r"\E")),
            F.regexp_replace(f["new_text"], r"([\\$])", r"\\$1")))
    return out.withColumn("sql_repaired", applied).drop("fixes")


def repair(preds: DataFrame, cat_columns: DataFrame) -> DataFrame:
    """Flexfield repair, then lookup repair; (schema_id, sql_id, question, sql, sql_repaired)."""
    step1 = repair_flexfield(preds, cat_columns).withColumnRenamed("sql_repaired", "_s1")
    return repair_lookup(step1, cat_columns, "_s1").drop("_s1")
