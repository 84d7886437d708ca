"""Schema linking: score every (question, table) and keep the tables a question needs.

Score = shared content words (question vs table terms) + 2 for each label
phrase of the table found in the question. A multi-word business label is
both the column's label and its business label, so it counts 4.

A frame may hold many catalogs: where questions carry ``schema_id``, a question is
linked to the tables of its own catalog; without the column all given tables are one catalog.

Scale notes: question words are exploded and equi-joined with the term table, then
summed per (question, table) with map-side partial aggregation, so a word present in a
third of all questions costs nothing extra. A phrase is found by an equi-join too: at every
blank of a question the letters around it (up to REACH on each side) are a key, and
a phrase is looked up by those around its first blank; what meets is checked with
``contains``. Join strategies are left to the optimizer. Large modules are narrowed by one
frontier search from all anchors together, shared by the questions with the same anchor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.functions.text import content_tokens, entity_label, label
from sqlweave.operators.paths import bfs, components, neighbors, scoped
from sqlweave.session import write_table

REACH = 3  # letters on each side of a blank that look a phrase up


def table_terms(cat_columns: DataFrame) -> DataFrame:
    """(schema_id, table_name, term): words of the entity label, the name, column labels."""
    key = ["schema_id", "table_name"]
    tn = cat_columns.select(*key).distinct()
    name_terms = tn.select(*key, F.explode(F.array_union(
        content_tokens(entity_label("table_name")), content_tokens("table_name"))).alias("term"))
    col_terms = cat_columns.select(*key, F.explode(F.array_union(
        content_tokens(label("column_name", "business_label")),
        F.coalesce(content_tokens("business_label"), F.array().cast("array<string>"))))
        .alias("term"))
    return name_terms.unionByName(col_terms).distinct()


def table_phrases(cat_columns: DataFrame) -> DataFrame:
    """(schema_id, table_name, phrase, weight): every multi-word label and business label, 2 each."""
    key = ["schema_id", "table_name"]
    lbl = F.lower(label("column_name", "business_label"))
    biz = F.lower("business_label")
    a = cat_columns.select(*key, lbl.alias("phrase"))
    b = cat_columns.select(*key, biz.alias("phrase"))
    return (a.unionAll(b).filter(F.col("phrase").contains(" "))
            .groupBy(*key, "phrase").agg((2 * F.count(F.lit(1))).alias("weight")))


def _around(left, right, before, after):
    """The key of one blank: letters before and after it."""
    return F.concat(F.right(left, before), F.lit(" "), F.left(right, after))


def phrase_hits(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """(schema_id, qid, phrase) for every phrase that the question's lower-cased text contains.

    ``phrases``: (schema_id, phrase), each with a blank in it.
    """
    words = F.split("phrase", " ")
    p = phrases.select("schema_id", "phrase", words[0].alias("l"), words[1].alias("r")).withColumns({
        "before": F.least(F.length("l"), F.lit(REACH)), "after": F.least(F.length("r"), F.lit(REACH))})
    p = p.select("schema_id", "phrase", _around(F.col("l"), F.col("r"), F.col("before"), F.col("after")).alias("key"))
    q = questions.select("schema_id", "qid", F.lower("text").alias("text")).withColumn("words", F.split("text", " "))
    blanks = q.filter(F.size("words") > 1).select("schema_id", "qid", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(
            F.right(F.element_at("words", i), F.lit(REACH)).alias("l"),
            F.left(F.element_at("words", i + 1), F.lit(REACH)).alias("r"))))).alias("b"))
    sizes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for i in range(REACH + 1) for j in range(REACH + 1)])
    keys = F.transform(F.filter(sizes, lambda s: (s["i"] <= F.length("b.l")) & (s["j"] <= F.length("b.r"))),
                       lambda s: _around(F.col("b.l"), F.col("b.r"), s["i"], s["j"]))
    met = (blanks.select("schema_id", "qid", F.explode(keys).alias("key")).join(p, ["schema_id", "key"])
           .select("schema_id", "qid", "phrase").distinct())
    return met.join(q.select("schema_id", "qid", "text"), ["schema_id", "qid"]).filter(
        F.col("text").contains(F.col("phrase"))).select("schema_id", "qid", "phrase").distinct()


def link_score(questions: DataFrame, cat_columns: DataFrame) -> DataFrame:
    """(schema_id if given, qid, table_name, score) for every pair with score > 0.

    ``questions``: (schema_id if there are several catalogs, qid, text). Whole texts are scanned.
    """
    keyed = "schema_id" in questions.columns
    out = _scores(scoped(questions, keyed), scoped(cat_columns, keyed))
    return out if keyed else out.drop("schema_id")


def _scores(questions: DataFrame, cat_columns: DataFrame) -> DataFrame:
    key = ["schema_id", "qid", "table_name"]
    words = questions.select("schema_id", "qid", F.explode(content_tokens("text")).alias("term"))
    by_word = words.join(table_terms(cat_columns), ["schema_id", "term"]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("score"))
    phrases = table_phrases(cat_columns)
    by_phrase = (phrase_hits(questions, phrases.select("schema_id", "phrase").distinct())
                 .join(phrases, ["schema_id", "phrase"]).groupBy(*key).agg(F.sum("weight").alias("score")))
    return by_word.unionByName(by_phrase).groupBy(*key).agg(F.sum("score").cast("long").alias("score"))


def link_tables(questions: DataFrame, cat_tables: DataFrame, cat_columns: DataFrame,
                cat_fks: DataFrame, max_component: int = 8) -> DataFrame:
    """(schema_id if given, qid, tables ARRAY<STRING> sorted, link_all BOOLEAN).

    Anchor = best-scoring table (first by position on ties). No score at all:
    ``link_all`` is set (every table) and ``tables`` is NULL. Anchor component with
    at most ``max_component`` tables: the whole component. Otherwise the
    seeds in the component, the tables on the shortest paths from the anchor
    to them, and their FK neighbours inside the component.
    """
    keyed = "schema_id" in questions.columns
    questions, cat_tables, cat_columns, cat_fks = (
        scoped(df, keyed) for df in (questions, cat_tables, cat_columns, cat_fks))
    scores = write_table(_scores(questions, cat_columns), "scores")
    table = ["schema_id", "table_name"]
    anchors = (scores.join(cat_tables.select(*table, "table_pos"), table)
               .groupBy("schema_id", "qid")
               .agg(F.max_by("table_name", F.struct("score", -F.col("table_pos"))).alias("anchor")))
    comp = components(cat_tables, cat_fks)
    comp = comp.join(comp.groupBy("schema_id", "component").agg(F.count("*").alias("csize")),
                     ["schema_id", "component"])
    anchors = write_table(anchors.join(comp.withColumnRenamed("table_name", "anchor"), ["schema_id", "anchor"]), "anchors")
    # small module: every table of the component
    small = (anchors.filter(F.col("csize") <= max_component)
             .join(comp.select("schema_id", "component", "table_name"), ["schema_id", "component"])
             .select("schema_id", "qid", "table_name"))
    # large module: seeds + path tables + one hop
    big = anchors.filter(F.col("csize") > max_component).select("schema_id", "qid", "anchor", "component")
    seeds = (scores.join(big, ["schema_id", "qid"])
             .join(comp.select(*table, F.col("component").alias("own")), table)
             .filter(F.col("component") == F.col("own"))
             .select("schema_id", "qid", "anchor", F.col("table_name").alias("seed")))
    reach = bfs(cat_fks, big.select("schema_id", F.col("anchor").alias("src")))
    reach = reach.select("schema_id", F.col("src").alias("anchor"), F.col("node").alias("seed"), "path")
    fk_tables = cat_fks.select("schema_id", "fk_pos", "from_table", "to_table")
    on_path = (seeds.join(reach, ["schema_id", "anchor", "seed"])
               .select("schema_id", "qid", F.explode("path").alias("fk_pos"))
               .join(fk_tables, ["schema_id", "fk_pos"])
               .select("schema_id", "qid", F.explode(F.array("from_table", "to_table")).alias("table_name")))
    core = (seeds.select("schema_id", "qid", F.col("seed").alias("table_name"))
            .unionByName(big.select("schema_id", "qid", F.col("anchor").alias("table_name")))
            .unionByName(on_path).distinct())
    # FK neighbours of a component's table lie in the component
    hop = core.join(neighbors(cat_fks), table).select("schema_id", "qid", F.col("neighbor").alias("table_name"))
    chosen = small.unionByName(core).unionByName(hop).distinct()
    linked = chosen.groupBy("schema_id", "qid").agg(F.sort_array(F.collect_list("table_name")).alias("tables"))
    # no table scored: the question links to every table (flag, not a copied list)
    none = questions.select("schema_id", "qid").join(anchors.select("schema_id", "qid"), ["schema_id", "qid"], "left_anti")
    out = (linked.withColumn("link_all", F.lit(False))
           .unionByName(none.select("schema_id", "qid", F.lit(None).cast("array<string>").alias("tables"),
                                    F.lit(True).alias("link_all"))))
    return out if keyed else out.drop("schema_id")
