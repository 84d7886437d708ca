"""Registered corpus jobs over catalogs profiled from the driver's tables.

The star catalog is copied under several schema ids (a multi-catalog corpus
from one extraction); specs, questions and pairs are built per copy. These
jobs are rule enumerations and have no SQL twin: the driver checks rows, and
pytest checks validity, paraphrase and split invariants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlweave.operators.catalog import prefix_catalog
from sqlweave.operators.corpus import (build_examples, corpus_texts, feature_coverage,
                                       serialize_catalog, split_by_query, split_by_schema,
                                       throughput_report, training_pairs)
from sqlweave.operators.specs import enumerate_specs, spec_tables, validate_specs
from sqlweave.sources.star import star_catalog
from sqlweave.session import ensure_checkpoint_dir
from sqlweave.session import materialize, write_table

N_COPIES = 4
N_PER_LEVEL = 10
K_PARAPHRASES = 3


def corpus_catalog(t):
    """Star catalog under N_COPIES schema ids (same table names, distinct ids)."""
    tabs, cols, fks = star_catalog(t)
    ids = [f"star{i}" for i in range(N_COPIES)]
    arr = F.array(*[F.lit(i) for i in ids])

    def rep(df):
        return df.drop("schema_id").withColumn("schema_id", F.explode(arr))
    return rep(tabs), rep(cols), rep(fks)


def corpus(t):
    """(tabs, cols, fks, specs, examples), built once per session and folder."""
    from sqlweave.memo import memo
    return memo(t.spark, t.root, "corpus", lambda: _corpus(t))


def _corpus(t):
    ensure_checkpoint_dir(t.spark)
    tabs, cols, fks = corpus_catalog(t)
    tabs, cols, fks = (materialize(tabs, "corpus_tables"), materialize(cols, "corpus_columns"),
                       materialize(fks, "corpus_fks"))
    specs = materialize(enumerate_specs(tabs, cols, fks, n_per_level=N_PER_LEVEL), "specs")
    ex = materialize(build_examples(specs, tabs, cols, fks, K_PARAPHRASES), "examples")
    return tabs, cols, fks, specs, ex


def q_enumerate_specs(t):
    specs = corpus(t)[3]
    return specs.select("schema_id", "spec_id", "level", "shape", "query_table",
                        F.array_join("features", ",").alias("features"))


def q_render_sql(t):
    return corpus(t)[4].select("schema_id", "spec_id", "sql")


def q_render_question(t):
    return corpus(t)[4].select("schema_id", "spec_id", "question")


def q_paraphrase(t):
    return corpus(t)[4].select("schema_id", "spec_id", F.explode("paraphrases").alias("paraphrase"))


def q_validate_specs(t):
    tabs, cols, fks, specs, _ = corpus(t)
    issues = validate_specs(specs, tabs, cols, fks).groupBy("schema_id").agg(
        F.countDistinct("spec_id").alias("n_invalid"))
    n = specs.groupBy("schema_id").agg(F.count("*").alias("n_specs"))
    return n.join(issues, "schema_id", "left").fillna(0, ["n_invalid"])


def q_spec_tables(t):
    specs = corpus(t)[3]
    return spec_tables(specs).select("schema_id", "spec_id",
                                     F.array_join(F.sort_array("tables"), ",").alias("tables"))


def _schema_text(t):
    _, cols, fks, _, _ = corpus(t)
    return serialize_catalog(cols, fks)


def q_serialize_catalog(t):
    return _schema_text(t)


def q_training_pairs(t):
    pairs = training_pairs(corpus(t)[4], _schema_text(t))
    return pairs.select("schema_id", "spec_id", "q_pos", "question", "sql")


def q_dedup_questions(t):
    pairs = training_pairs(corpus(t)[4], _schema_text(t))
    return pairs.groupBy("schema_id", "spec_id").agg(F.count("*").alias("n_questions"))


def _split_summary(train, val):
    both = train.unionByName(val)
    return both.groupBy("split").agg(F.countDistinct("schema_id").alias("n_schemas"),
                                     F.countDistinct("schema_id", "spec_id").alias("n_examples"),
                                     F.count("*").alias("n_pairs"))


def q_split_by_query(t):
    return _split_summary(*split_by_query(corpus(t)[4], _schema_text(t)))


def q_feature_coverage(t):
    return feature_coverage(corpus(t)[4])


def q_throughput_report(t):
    """Examples, their valid share and how many were made a second; the corpus is built anew for it."""
    import time
    tabs, cols, fks, _, _ = corpus(t)
    begin = time.perf_counter()
    specs = write_table(enumerate_specs(tabs, cols, fks, n_per_level=N_PER_LEVEL), "timed_specs")
    made = write_table(build_examples(specs, tabs, cols, fks, K_PARAPHRASES), "timed_examples")
    return throughput_report(made, time.perf_counter() - begin)


def q_corpus_texts(t):
    train, _ = split_by_schema(corpus(t)[4], _schema_text(t))
    return corpus_texts(train).groupBy().agg(F.count("*").alias("n_texts"),
                                             F.sum(F.length("text")).alias("n_chars"))


def q_merge_catalogs(t):
    tabs, cols, fks = star_catalog(t)
    mt, mc, mf = prefix_catalog(tabs, cols, fks, [f"m{i}_" for i in range(8)])
    return mt.join(mc.groupBy("table_name").agg(F.count("*").alias("n_columns")), "table_name") \
        .join(mf.groupBy(F.col("from_table").alias("table_name")).agg(
            F.count("*").alias("n_fk_out")), "table_name", "left") \
        .select("table_name", "table_pos", "n_columns", F.coalesce("n_fk_out", F.lit(0))
                .alias("n_fk_out"))


def q_frame_pair(t):
    from sqlweave.operators.bpe import bpe_train
    from sqlweave.operators.corpus import frame_pairs, pad_batches
    from sqlweave.plans.text_jobs import BPE_VOCAB
    train, _ = split_by_schema(corpus(t)[4], _schema_text(t))
    merges = bpe_train(corpus_texts(train), BPE_VOCAB)
    merges = t.spark.createDataFrame(merges.collect(), merges.schema)
    padded = pad_batches(frame_pairs(train, merges), batch_size=32)
    return padded.groupBy("batch_id").agg(
        F.count("*").alias("n_rows"), F.max(F.size("src")).alias("src_len"),
        F.min(F.size("src")).alias("src_len_min"), F.max(F.size("tgt_in")).alias("tgt_len"))


QUERIES = {
    "enumerate_specs": q_enumerate_specs,
    "render_sql": q_render_sql,
    "render_question": q_render_question,
    "paraphrase": q_paraphrase,
    "validate_specs": q_validate_specs,
    "spec_tables": q_spec_tables,
    "serialize_catalog": q_serialize_catalog,
    "training_pairs": q_training_pairs,
    "dedup_questions": q_dedup_questions,
    "split_by_query": q_split_by_query,
    "feature_coverage": q_feature_coverage,
    "throughput_report": q_throughput_report,
    "corpus_texts": q_corpus_texts,
    "merge_catalogs": q_merge_catalogs,
    "frame_pair": q_frame_pair,
}

SQL: dict = {}


def q_pick_group(t):
    """Group-by candidates per fact: NAME / flexfield columns within two FK hops."""
    from sqlweave.operators.specs import group_candidates, table_info
    from sqlweave.functions.text import label
    tabs, cols, fks = star_catalog(t)
    info = table_info(cols)
    flex = cols.filter(F.col("role") == "flexfield_segment").select(
        "schema_id", "table_name", "table_pos", F.struct(
            F.lit(1).alias("r"), F.col("column_name").alias("col"),
            label("column_name", "business_label").alias("label")).alias("c"))
    facts = info.filter(F.size("amounts") > 0).select("schema_id", "table_name")
    return group_candidates(info, fks, facts, flex).select("fact", "tbl", "col", "hops")


QUERIES.update({"pick_group": q_pick_group})


def _pick_group_sql() -> str:
    from sqlweave.plans.path_jobs import _FACTS, _walk_cte
    return _walk_cte(_FACTS, 2) + """
SELECT b.src AS fact, c.table_name AS tbl, c.column_name AS col, b.hops
FROM best b JOIN cols c ON c.table_name = b.node
WHERE c.role IN ('name', 'flexfield_segment')"""


SQL.update({"pick_group": _pick_group_sql()})


def _specs_cte() -> str:
    """The same draws in SQL: which table, shape and parts each spec gets (CTE ``specs``)."""
    from sqlweave.operators import specs as S
    from sqlweave.plans.path_jobs import _FACTS, _walk_cte
    chance = lambda name, p: f"{S.draw_sql(name, 1000)} < {int(p * 1000)}"
    total, cases = 0, ""
    for func, weight in S.AGG_WEIGHTS:
        total += weight
        cases += f" WHEN r < {total} THEN '{func.lower()}'"
    per = 5 * N_PER_LEVEL
    return _walk_cte(_FACTS, 2) + f""",
tabs AS (
  SELECT table_name, table_pos, COUNT(*) FILTER (WHERE role = 'amount') AS n_amounts,
         COUNT(*) FILTER (WHERE role = 'date') AS n_dates, COUNT(*) FILTER (WHERE role = 'org_id') AS n_orgs,
         COUNT(*) FILTER (WHERE role = 'lookup' AND n_values > 0) AS n_lookups,
         COUNT(*) FILTER (WHERE role = 'name') AS n_names
  FROM cols GROUP BY table_name, table_pos),
places AS (
  SELECT table_name, FALSE AS is_fact, row_number() OVER (ORDER BY table_pos) - 1 AS pos FROM tabs
  UNION ALL
  SELECT table_name, TRUE, row_number() OVER (ORDER BY table_pos) - 1 FROM tabs WHERE n_amounts > 0),
cands AS (
  SELECT b.src AS fact, c.role = 'flexfield_segment' AS is_flex, b.hops, b.path,
         row_number() OVER (PARTITION BY b.src ORDER BY b.hops, c.table_pos, c.role = 'flexfield_segment', c.table_name,
                            c.column_name) - 1 AS pos,
         COUNT(*) OVER (PARTITION BY b.src) AS n
  FROM best b JOIN cols c ON c.table_name = b.node WHERE c.role IN ('name', 'flexfield_segment')),
links AS (
  SELECT f.from_table AS fact, f.to_table, row_number() OVER (PARTITION BY f.from_table ORDER BY f.ord) - 1 AS pos,
         COUNT(*) OVER (PARTITION BY f.from_table) AS n
  FROM fk f JOIN tabs t ON t.table_name = f.to_table WHERE t.n_names > 0),
numbered AS (
  SELECT spec_id, 'star' || CAST(spec_id // {per} AS VARCHAR) AS schema_id, (spec_id // {N_PER_LEVEL}) % 5 + 1 AS level
  FROM (SELECT unnest(generate_series(0, {N_COPIES * per - 1})) AS spec_id)),
placed AS (
  SELECT n.*, p.table_name AS from_table
  FROM (SELECT *, CASE WHEN level >= 2 THEN {S.draw_sql('fact', "(SELECT COUNT(*) FROM places WHERE is_fact)")}
                       ELSE {S.draw_sql('table', "(SELECT COUNT(*) FROM tabs)")} END AS at FROM numbered) n
  JOIN places p ON p.is_fact = (n.level >= 2) AND p.pos = n.at),
drawn AS (
  SELECT s.*, t.n_dates, t.n_orgs, t.n_lookups, c.is_flex, c.hops, c.path, l.to_table,
         CASE WHEN level = 1 THEN 'list'
              WHEN level = 2 AND {chance('no_group', S.P_NO_GROUP)} THEN 'agg_global' WHEN level = 2 THEN 'agg'
              WHEN level = 3 AND {chance('having', S.P_HAVING)} THEN 'having' WHEN level = 3 THEN 'top_n'
              WHEN level = 4 AND l.to_table IS NOT NULL AND {chance('semi', S.P_SEMI)} THEN 'semijoin'
              WHEN level = 4 THEN 'above_avg' ELSE 'window' END AS shape,
         {S.draw_sql('agg', total)} AS r
  FROM placed s JOIN tabs t ON t.table_name = s.from_table
  LEFT JOIN cands c ON c.fact = s.from_table AND c.pos = {S.draw_sql('group', 'c.n')}
  LEFT JOIN links l ON l.fact = s.from_table AND l.pos = {S.draw_sql('name_fk', 'l.n')}),
shaped AS (
  SELECT *, shape IN ('agg', 'having', 'top_n') AS grouped,
         shape IN ('list', 'agg', 'agg_global', 'having', 'top_n') AS filtered FROM drawn),
specs AS (
SELECT schema_id, spec_id, CAST(level AS INTEGER) AS level, shape, from_table, grouped, path,
       CASE WHEN shape = 'semijoin' THEN to_table ELSE from_table END AS query_table,
       array_to_string(list_filter([
         CASE WHEN grouped OR shape = 'agg_global' THEN CASE{cases} END END,
         CASE WHEN shape = 'agg_global' THEN 'no_group' END,
         CASE WHEN grouped AND hops > 0 THEN 'join' END,
         CASE WHEN grouped AND is_flex THEN 'flexfield' END,
         CASE WHEN n_dates > 0 AND (filtered AND {chance('p_date', S.P_DATE)}
                                    OR shape = 'semijoin' AND {chance('inner_date', S.P_INNER_DATE)}) THEN 'date_filter' END,
         CASE WHEN filtered AND n_orgs > 0 AND {chance('p_org', S.P_ORG)} THEN 'multi_org' END,
         CASE WHEN filtered AND n_lookups > 0 AND {chance('p_lookup', S.P_LOOKUP)} THEN 'lookup_filter' END,
         CASE WHEN shape IN ('having', 'top_n') THEN shape END,
         CASE WHEN shape = 'above_avg' THEN 'above_average' WHEN shape = 'semijoin' THEN 'semijoin' END,
         CASE WHEN shape IN ('above_avg', 'semijoin') THEN 'subquery' END,
         CASE WHEN shape = 'window' THEN 'window' END,
         'L' || CAST(level AS VARCHAR)], lambda x: x IS NOT NULL), ',') AS features
FROM shaped)"""


def _serialized_sql() -> str:
    from sqlweave.plans.path_jobs import _ALL, _walk_cte
    return _walk_cte(_ALL, 1) + f""",
first AS (SELECT from_table, from_column, 'fk->' || arg_min(to_table || '.' || to_column, ord) AS tag
          FROM fk GROUP BY from_table, from_column),
parts AS (
  SELECT c.table_name, c.table_pos, c.table_name || ' : ' || string_agg(
           c.column_name || CASE WHEN len(tags) > 0 THEN '(' || array_to_string(tags, ',') || ')' ELSE '' END,
           ', ' ORDER BY c.col_pos) AS part
  FROM (SELECT cols.*, list_filter([CASE WHEN is_pk THEN 'pk' END, f.tag,
                                    CASE WHEN business_label IS NOT NULL THEN '=' || business_label END],
                                   lambda x: x IS NOT NULL) AS tags
        FROM cols LEFT JOIN first f ON f.from_table = cols.table_name AND f.from_column = cols.column_name) c
  GROUP BY c.table_name, c.table_pos)
SELECT s.schema_id, string_agg(p.part, ' | ' ORDER BY p.table_pos) AS schema_text
FROM parts p CROSS JOIN (SELECT 'star' || unnest(range({N_COPIES})) AS schema_id) s GROUP BY s.schema_id"""


def _merged_sql() -> str:
    from sqlweave.plans.catalog_jobs import _catalog_cte
    return _catalog_cte() + """
SELECT 'm' || m.i || '_' || c.table_name AS table_name,
       m.i * (SELECT MAX(table_pos) + 1 FROM cols) + c.table_pos AS table_pos, COUNT(*) AS n_columns,
       (SELECT COUNT(*) FROM fks f WHERE f.from_table = c.table_name) AS n_fk_out
FROM cols c CROSS JOIN (SELECT unnest(range(8)) AS i) m GROUP BY m.i, c.table_name, c.table_pos"""


SQL.update({
    "enumerate_specs": _specs_cte() + """
SELECT schema_id, spec_id, level, shape, query_table, features FROM specs""",
    "feature_coverage": _specs_cte() + """
SELECT feature, COUNT(*) AS n_examples FROM (SELECT unnest(string_split(features, ',')) AS feature FROM specs)
GROUP BY feature""",
    # every spec is valid by construction; the counts come from the draws
    "validate_specs": _specs_cte() + """
SELECT schema_id, COUNT(*) AS n_specs, 0 AS n_invalid FROM specs GROUP BY schema_id""",
    "spec_tables": _specs_cte() + """,
steps AS (SELECT schema_id, spec_id, unnest(path) AS ord FROM specs WHERE grouped),
used AS (
  SELECT schema_id, spec_id, query_table AS tb FROM specs UNION SELECT schema_id, spec_id, from_table FROM specs
  UNION SELECT s.schema_id, s.spec_id, f.from_table FROM steps s JOIN fk f USING (ord)
  UNION SELECT s.schema_id, s.spec_id, f.to_table FROM steps s JOIN fk f USING (ord))
SELECT schema_id, spec_id, string_agg(tb, ',' ORDER BY tb) AS tables FROM used GROUP BY schema_id, spec_id""",
    "serialize_catalog": _serialized_sql(),
    "merge_catalogs": _merged_sql(),
})
