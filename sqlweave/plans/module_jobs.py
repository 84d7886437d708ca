"""Linking at catalog size: questions against the merged catalog of many modules.

``link_modules`` links every user turn to the merged catalog of all modules; its twin
computes words, catalogs, scores, components, paths (a recursive query) and neighbours in SQL.
``link_report`` links the rendered questions of every module's specs, whose tables are known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlweave.operators import compare
from sqlweave.operators.corpus import (balanced_split, build_examples, leakage_groups, link_costs, schema_groups,
                                       serialize_catalog, split_by_schema)
from sqlweave.operators.link import link_tables
from sqlweave.operators.lint import references
from sqlweave.operators.paths import neighbors
from sqlweave.operators.specs import enumerate_specs, spec_tables
from sqlweave.operators.synth import lcg, lcg_sql
from sqlweave.plans.catalog_jobs import EXPECTED_FKS
from sqlweave.plans.text_jobs import TWIN_STOP_WORDS, user_questions
from sqlweave.session import write_table
from sqlweave.sources import modules, star
from sqlweave.sources.star import star_catalog

N_PER_LEVEL = 10
TOKEN_LIMIT = 512


def module_catalogs(t):
    from sqlweave.memo import memo
    return memo(t.spark, t.root, "module_catalogs", lambda: modules.module_catalogs(t.documents))


def module_corpus(t):
    """(tabs, cols, fks, specs, examples) over all modules, built once per session and folder."""
    from sqlweave.memo import memo
    return memo(t.spark, t.root, "module_corpus", lambda: _module_corpus(t))


def _module_corpus(t):
    tabs, cols, fks = module_catalogs(t)
    specs = write_table(enumerate_specs(tabs, cols, fks, n_per_level=N_PER_LEVEL), "module_specs")
    return tabs, cols, fks, specs, write_table(build_examples(specs, tabs, cols, fks), "module_examples")


def q_link_modules(t):
    tabs, cols, fks = modules.merged(*module_catalogs(t))
    found = link_tables(user_questions(t), tabs, cols, fks)
    return found.select("qid", F.coalesce(F.size("tables"), F.lit(0)).cast("long").alias("n_tables"),
                        F.coalesce(F.array_join("tables", ","), F.lit("")).alias("tables"), "link_all")


def linked_corpus(t):
    """(linked, gold): every question of the module corpus against the merged catalog."""
    from sqlweave.memo import memo
    return memo(t.spark, t.root, "linked_corpus", lambda: _linked_corpus(t))


def _linked_corpus(t):
    tabs, cols, fks, specs, ex = module_corpus(t)
    qid = F.concat_ws(":", "schema_id", "spec_id").alias("qid")
    gold = spec_tables(specs).select(qid, F.transform(
        "tables", lambda x: F.concat("schema_id", F.lit("_"), x)).alias("gold_tables"))
    questions = ex.select(qid, F.col("question").alias("text"))
    return write_table(link_tables(questions, *modules.merged(tabs, cols, fks)), "linked"), write_table(gold, "gold")


def q_link_report(t):
    """Recall, mean tables and mean schema tokens before and after, share within the token limit."""
    tabs, cols, fks = modules.merged(*module_catalogs(t))
    linked, gold = linked_corpus(t)
    n_tables = gold.crossJoin(F.broadcast(tabs.agg(F.count(F.lit(1)).alias("n_tables"))))  # one row
    tables = compare.link_report(linked, n_tables, F.col("n_tables"))
    tokens = link_costs(linked, cols, fks).agg(
        F.avg("tokens_before").alias("mean_tokens_before"), F.avg("tokens_after").alias("mean_tokens_after"),
        F.avg((F.col("tokens_after") <= TOKEN_LIMIT).cast("double")).alias("within_limit"))
    return tables.crossJoin(tokens)  # one row each


def q_link_serialized(t):
    """Question -> linked tables -> text of that part of the catalog."""
    _, cols, fks = modules.merged(*module_catalogs(t))
    linked, _ = linked_corpus(t)
    chosen = linked.filter("not link_all").select("qid", F.lit("merged").alias("schema_id"),
                                                  F.explode("tables").alias("table_name"))
    return serialize_catalog(cols, fks, chosen, "qid")


def catalog_names(t):
    """(schema_id, name): tables and columns of every module, and of every given table with its FK neighbours."""
    _, cols, _ = module_catalogs(t)
    tabs, star_cols, fks = star_catalog(t)
    near = neighbors(fks).select("table_name", F.col("neighbor").alias("member"))
    around = near.unionByName(tabs.select("table_name", F.col("table_name").alias("member"))).distinct()
    own = star_cols.select(F.col("table_name").alias("member"), "column_name").join(around, "member").select(
        F.concat(F.lit("t_"), "table_name").alias("schema_id"), F.col("member").alias("table_name"), "column_name")
    both = cols.select("schema_id", "table_name", "column_name").unionByName(own)
    return both.select("schema_id", F.explode(F.array("table_name", "column_name")).alias("name")).distinct()


def schema_split(t):
    from sqlweave.memo import memo
    return memo(t.spark, t.root, "schema_split",
                lambda: write_table(balanced_split(schema_groups(catalog_names(t))), "schema_split"))


def q_schema_split(t):
    return schema_split(t)


def _split_pairs(t):
    _, cols, fks, _, ex = module_corpus(t)
    return split_by_schema(ex, serialize_catalog(cols, fks), split=schema_split(t))


def q_split_by_schema(t):
    """The module corpus on two sides of different catalogs."""
    train, val = _split_pairs(t)
    return train.unionByName(val).groupBy("split").agg(
        F.countDistinct("schema_id").alias("n_schemas"), F.countDistinct("schema_id", "spec_id").alias("n_examples"),
        F.count("*").alias("n_pairs"))


def q_vocab_overlap(t):
    """Identifiers (tables and columns) used by train SQL vs val SQL, and catalog coverage."""
    _, cols, _, _, _ = module_corpus(t)
    train, val = _split_pairs(t)

    def names(pairs, split):
        st = pairs.select("schema_id", F.col("spec_id").alias("sql_id"), "sql").distinct()
        r = references(st)
        return (r["tables"].select(F.col("table_name").alias("name"))
                .unionByName(r["refs"].select(F.col("column_name").alias("name")))
                .distinct().withColumn("split", F.lit(split)))
    n = names(train, "train").unionByName(names(val, "val"))
    vocab = cols.select(F.explode(F.array("table_name", "column_name")).alias("name")).distinct()
    per = n.groupBy("name").agg(F.collect_set("split").alias("splits"))
    return per.join(vocab.withColumn("in_catalog", F.lit(True)), "name", "full").agg(
        F.count(F.when(F.array_contains("splits", "train"), 1)).alias("n_train_names"),
        F.count(F.when(F.array_contains("splits", "val"), 1)).alias("n_val_names"),
        F.count(F.when(F.size("splits") == 2, 1)).alias("n_shared"),
        (F.count(F.when(F.array_contains("splits", "train") & F.col("in_catalog"), 1))
         / F.count(F.when(F.col("in_catalog"), 1))).alias("catalog_covered"))


VAL_SHARE, SPLIT_SALT = 250, 9_973


def q_split_groups(t):
    """Conversations that share a turn's text are one group and on one side."""
    item = F.col("conv_id").cast("string").alias("item")
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = t.conversations.select(item, F.sha2(F.concat_ws(":", "role", text), 256).alias("key"))
    g = leakage_groups(rows)
    side = F.when(F.pmod(lcg(F.col("group").cast("long"), SPLIT_SALT), F.lit(1000)) < VAL_SHARE, "val").otherwise("train")
    return g.select(F.col("item").cast("long").alias("conv_id"), F.col("group").cast("long").alias("group_id"),
                    side.alias("split"))


QUERIES = {"link_modules": q_link_modules, "link_report": q_link_report, "link_serialized": q_link_serialized,
           "schema_split": q_schema_split, "split_by_schema": q_split_by_schema, "vocab_overlap": q_vocab_overlap,
           "split_groups": q_split_groups}


# -- DuckDB twin -----------------------------------------------------------------------------
def _text(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def modules_cte() -> str:
    """Words, columns and FKs of all modules: mw, cols(table_name, ...), fk(from_table, to_table, ord, ...)."""
    rows = ", ".join(
        f"({large}, {n}, {tw}, {_text(ts)}, {c}, {'NULL' if w is None else w}, {_text(s)}, {key}, "
        f"{label[0] if label else 'NULL'}, {label[1] if len(label) > 1 else 'NULL'})"
        for large, n, tw, ts, c, w, s, _, key, label, _ in modules.layout_rows())
    return f"""
WITH counted AS (
  SELECT word, COUNT(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{modules.WORD_PATTERN}')) AS word FROM documents)
  WHERE word NOT IN ({TWIN_STOP_WORDS}) GROUP BY word),
placed AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS place FROM counted),
mw AS (SELECT place // {modules.SHARE} AS module, place % {modules.SHARE} AS k, word FROM placed
       WHERE place < {modules.N_MODULES * modules.SHARE}),
whole AS (SELECT module FROM mw GROUP BY module HAVING COUNT(*) = {modules.SHARE}),
layout AS (SELECT * FROM (VALUES {rows}) AS v(large, table_no, tw, ts, col_pos, cw, cs, is_key, l1, l2)),
cols AS (
  SELECT m.module, m.module * {modules.SLOTS} + l.table_no AS table_pos, l.col_pos, l.is_key,
         'm' || lpad(CAST(m.module AS VARCHAR), 2, '0') || '_' || t.word || l.ts AS table_name,
         coalesce(c.word, '') || l.cs AS column_name,
         CASE WHEN b.word IS NOT NULL THEN a.word || ' ' || b.word ELSE a.word END AS business_label
  FROM whole m JOIN layout l ON l.large = (m.module % {modules.LARGE_EVERY} = 0)
  JOIN mw t ON t.module = m.module AND t.k = l.tw
  LEFT JOIN mw c ON c.module = m.module AND c.k = l.cw
  LEFT JOIN mw a ON a.module = m.module AND a.k = l.l1
  LEFT JOIN mw b ON b.module = m.module AND b.k = l.l2),
fk AS (
  SELECT f.table_name AS from_table, p.table_name AS to_table, f.column_name,
         CAST(f.table_pos AS BIGINT) * 1000000 + f.col_pos AS ord
  FROM cols f JOIN cols p ON p.module = f.module AND p.is_key AND p.column_name = f.column_name
  WHERE NOT f.is_key AND ends_with(f.column_name, '_id') AND f.column_name <> 'org_id')
"""


SQL = {"link_modules": modules_cte() + f""",
tabs AS (SELECT DISTINCT table_name, table_pos FROM cols),
named AS (
  SELECT table_name, table_name AS s FROM tabs
  UNION ALL SELECT table_name, 'line' FROM tabs WHERE ends_with(table_name, '_lines_all')
  UNION ALL SELECT table_name, coalesce(business_label, replace(column_name, '_', ' ')) FROM cols),
terms AS (SELECT * FROM (SELECT DISTINCT table_name, unnest(regexp_extract_all(s, '[a-z0-9]+')) AS term FROM named)
          WHERE term NOT IN ({TWIN_STOP_WORDS})),
phr AS (
  SELECT table_name, coalesce(business_label, replace(column_name, '_', ' ')) AS phrase FROM cols
  UNION ALL SELECT table_name, business_label FROM cols),
q AS (SELECT conv_id * 1000000 + turn AS qid, text FROM conversations WHERE role = 'user'),
w AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM q),
scores AS (
  SELECT qid, table_name, SUM(score) AS score FROM (
    SELECT qid, table_name, COUNT(*) AS score FROM w JOIN terms USING (term) GROUP BY ALL
    UNION ALL
    SELECT qid, table_name, 2 * COUNT(*) FROM q JOIN phr ON contains(phrase, ' ') AND contains(lower(q.text), phrase)
    GROUP BY ALL)
  GROUP BY ALL),
e AS (SELECT from_table AS a, to_table AS b, ord, from_table, to_table FROM fk
      UNION ALL SELECT to_table, from_table, ord, from_table, to_table FROM fk),
walk AS (SELECT * FROM (
  WITH RECURSIVE r(src, node, hops, path, seen) AS (
    SELECT table_name, table_name, 0, CAST([] AS BIGINT[]), [table_name] FROM tabs
    UNION ALL
    SELECT r.src, e.b, r.hops + 1, list_append(r.path, e.ord), list_append(r.seen, e.b)
    FROM r JOIN e ON e.a = r.node WHERE NOT list_contains(r.seen, e.b))
  SELECT * FROM r)),
best AS (SELECT src, node, arg_min(path, (hops, path)) AS path FROM walk GROUP BY src, node),
comp AS (SELECT src AS table_name, MIN(node) AS component, COUNT(DISTINCT node) AS csize FROM best GROUP BY src),
anchor AS (SELECT s.qid, arg_max(s.table_name, s.score * 1000000 - t.table_pos) AS anchor
           FROM scores s JOIN tabs t USING (table_name) GROUP BY s.qid),
small AS (SELECT a.qid, b.table_name FROM anchor a JOIN comp c ON c.table_name = a.anchor
          JOIN comp b ON b.component = c.component WHERE c.csize <= 8),
seed AS (SELECT a.qid, a.anchor, s.table_name AS seed FROM anchor a JOIN comp c ON c.table_name = a.anchor
         JOIN scores s ON s.qid = a.qid JOIN comp b ON b.table_name = s.table_name
         WHERE c.csize > 8 AND b.component = c.component),
steps AS (SELECT s.qid, unnest(b.path) AS ord FROM seed s JOIN best b ON b.src = s.anchor AND b.node = s.seed),
core AS (
  SELECT qid, seed AS table_name FROM seed
  UNION SELECT qid, anchor FROM seed
  UNION SELECT s.qid, f.from_table FROM steps s JOIN fk f USING (ord)
  UNION SELECT s.qid, f.to_table FROM steps s JOIN fk f USING (ord)),
chosen AS (
  SELECT qid, table_name FROM small
  UNION SELECT qid, table_name FROM core
  UNION SELECT c.qid, e.b FROM core c JOIN e ON e.a = c.table_name)
SELECT qid, COUNT(*) AS n_tables, string_agg(table_name, ',' ORDER BY table_name) AS tables, FALSE AS link_all
FROM chosen GROUP BY qid
UNION ALL
SELECT qid, 0, '', TRUE FROM q WHERE qid NOT IN (SELECT qid FROM anchor)"""}


def _star_names() -> str:
    near = {tb: {tb} for tb in star.CATALOG_TABLES}
    for a, _, b, _ in EXPECTED_FKS:
        near[a].add(b)
        near[b].add(a)
    rows = sorted({(f"t_{tb}", x) for tb, group in near.items() for m in group
                   for x in (m, *(c for c, _ in star.STAR_COLUMNS[m]))})
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


SQL["schema_split"] = modules_cte() + f""",
names AS (
  SELECT 'm' || lpad(CAST(module AS VARCHAR), 2, '0') AS schema_id, unnest([substr(table_name, 5), column_name]) AS name
  FROM cols UNION SELECT * FROM (VALUES {_star_names()}) AS v(schema_id, name)),
specific AS (SELECT name FROM names GROUP BY name
             HAVING COUNT(*) <= 0.25 * (SELECT COUNT(DISTINCT schema_id) FROM names)),
near AS (SELECT DISTINCT a.schema_id AS a, b.schema_id AS b FROM names a JOIN names b USING (name)
         WHERE name IN (SELECT name FROM specific)),
reach AS (SELECT * FROM (
  WITH RECURSIVE r(src, node) AS (
    SELECT DISTINCT schema_id, schema_id FROM names
    UNION SELECT r.src, near.b FROM r JOIN near ON near.a = r.node)
  SELECT * FROM r)),
comp AS (SELECT src AS schema_id, MIN(node) AS component FROM reach GROUP BY src),
sized AS (SELECT component, COUNT(*) AS size FROM comp GROUP BY component),
summed AS (SELECT component, SUM(size) OVER (ORDER BY component) AS upto FROM sized)
SELECT c.schema_id, c.component,
       CASE WHEN p.upto <= 0.25 * (SELECT COUNT(*) FROM comp) THEN 'val' ELSE 'train' END AS split
FROM comp c JOIN summed p USING (component)"""

SQL["split_groups"] = f"""
WITH k AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS item,
                  role || ':' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM conversations),
near AS (SELECT DISTINCT a.item AS a, b.item AS b FROM k a JOIN k b USING (key) WHERE a.item <> b.item),
reach AS (SELECT * FROM (
  WITH RECURSIVE r(src, node) AS (
    SELECT DISTINCT item, item FROM k UNION SELECT r.src, near.b FROM r JOIN near ON near.a = r.node)
  SELECT * FROM r)),
g AS (SELECT src, CAST(MIN(node) AS BIGINT) AS group_id FROM reach GROUP BY src)
SELECT CAST(src AS BIGINT) AS conv_id, group_id,
       CASE WHEN ({lcg_sql('group_id', SPLIT_SALT)}) % 1000 < {VAL_SHARE} THEN 'val' ELSE 'train' END AS split FROM g"""
