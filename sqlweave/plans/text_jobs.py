"""Registered text jobs over whole texts: pre-token and word histograms, schema linking.

Questions for linking are the user turns of ``conversations`` (every turn,
whole text); the catalog is the one profiled from the driver's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sqlweave.functions.columns import sql_literal
from sqlweave.functions.text import PRETOKEN_PATTERN, WORD_PATTERN, content_tokens, pretokens
from sqlweave.operators.link import link_score, link_tables
from sqlweave.plans.catalog_jobs import EXPECTED_FKS
from sqlweave.sources import star
from sqlweave.sources.star import star_catalog

def _qid():
    return F.col("conv_id") * 1_000_000 + F.col("turn")


def user_questions(t):
    c = t.conversations.filter(F.col("role") == "user")
    return c.select(_qid().alias("qid"), "text")


def q_pretokens(t):
    d = t.documents.select(F.explode(pretokens("text")).alias("pretoken"))
    return d.groupBy("pretoken").agg(F.count("*").alias("n"))


def q_content_tokens(t):
    d = t.documents.select("doc_id", F.explode(content_tokens("text")).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("n_docs"))


def q_link_score(t):
    _, cols, _ = star_catalog(t)
    return link_score(user_questions(t), cols)


def q_link_tables(t):
    tabs, cols, fks = star_catalog(t)
    lt = link_tables(user_questions(t), tabs, cols, fks)
    return lt.select("qid", F.coalesce(F.size("tables"), F.lit(0)).cast("long").alias("n_tables"),
                     F.coalesce(F.array_join("tables", ","), F.lit("")).alias("tables"),
                     "link_all")


QUERIES = {
    "pretokens": q_pretokens,
    "content_tokens": q_content_tokens,
    "link_score": q_link_score,
    "link_tables": q_link_tables,
}


# -- DuckDB twins -------------------------------------------------------------------------
# The twins' own statement of the words that name no table, in alphabetical order.
_TWIN_STOP = """
a above all an and any are at average below by code count date do does each find for from get give has have
highest how i id in is key largest least list me mean more most name number of on only or our over per print pull rank s
show smallest status sum than that the to top total under we what where which who whose with within across you year
""".split()
TWIN_STOP_WORDS = ", ".join(sql_literal(w) for w in _TWIN_STOP)


def _py_tokens(s: str) -> set[str]:
    return {w for w in re.findall(WORD_PATTERN, s.lower()) if w not in _TWIN_STOP}


def _star_terms():
    terms, phrases = set(), []
    for tbl in star.CATALOG_TABLES:
        terms |= {(tbl, w) for w in _py_tokens(tbl.replace("_", " ")) | _py_tokens(tbl)}
        for col, _ in star.STAR_COLUMNS[tbl]:
            biz = star.FLEX_LABELS.get((tbl, col))
            lbl = biz or col.replace("_", " ")
            terms |= {(tbl, w) for w in _py_tokens(lbl) | (_py_tokens(biz) if biz else set())}
            for p in (lbl, biz):
                if p and " " in p:
                    phrases.append((tbl, p.lower()))
    return sorted(terms), phrases


def _link_ctes() -> str:
    terms, phrases = _star_terms()
    tv = ", ".join(f"('{a}', '{b}')" for a, b in terms)
    pv = ", ".join(f"('{a}', {sql_literal(b)})" for a, b in phrases)
    return f"""
WITH terms AS (SELECT * FROM (VALUES {tv}) AS v(table_name, term)),
phr AS (SELECT * FROM (VALUES {pv}) AS v(table_name, phrase)),
q AS (SELECT conv_id * 1000000 + turn AS qid, text FROM conversations WHERE role = 'user'),
w AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS term FROM q),
ws AS (SELECT w.qid, t.table_name, COUNT(*) AS score FROM w JOIN terms t ON t.term = w.term
       GROUP BY 1, 2),
ps AS (SELECT q.qid, p.table_name, 2 * COUNT(*) AS score FROM q JOIN phr p
       ON contains(lower(q.text), p.phrase) GROUP BY 1, 2),
scores AS (SELECT qid, table_name, CAST(SUM(score) AS BIGINT) AS score
           FROM (SELECT * FROM ws UNION ALL SELECT * FROM ps) GROUP BY 1, 2)
"""


def _components_sql() -> str:
    # FK-connected sets of the catalog tables by a bounded recursive walk
    fk = " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b UNION ALL SELECT '{c}', '{a}'"
                            for a, _, c, _ in EXPECTED_FKS)
    tabs = ", ".join(f"('{tb}', {i})" for i, tb in enumerate(star.CATALOG_TABLES, start=1))
    return f""",
tabs AS (SELECT * FROM (VALUES {tabs}) AS v(table_name, table_pos)),
e AS ({fk}),
reach AS (SELECT * FROM (
  WITH RECURSIVE r(src, node) AS (
    SELECT table_name, table_name FROM tabs
    UNION
    SELECT r.src, e.b FROM r JOIN e ON e.a = r.node)
  SELECT * FROM r)),
comp AS (SELECT src AS table_name, MIN(node) AS component FROM reach GROUP BY src)
"""


SQL = {
    "pretokens": f"""
SELECT pretoken, COUNT(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '{PRETOKEN_PATTERN.replace(chr(92) + 'x0B', chr(92) + 'v')}'))
    AS pretoken FROM documents)
GROUP BY pretoken""",
    "content_tokens": f"""
SELECT term, COUNT(*) AS n_docs FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS term
  FROM documents)
WHERE term NOT IN ({TWIN_STOP_WORDS})
GROUP BY term""",
    "link_score": _link_ctes() + "SELECT qid, table_name, score FROM scores",
    "link_tables": _link_ctes() + _components_sql() + """,
anchor AS (SELECT s.qid, arg_max(s.table_name, s.score * 1000 - t.table_pos) AS anchor
           FROM scores s JOIN tabs t ON t.table_name = s.table_name GROUP BY s.qid),
linked AS (SELECT a.qid, string_agg(c2.table_name, ',' ORDER BY c2.table_name) AS tables,
                  COUNT(*) AS n_tables
           FROM anchor a JOIN comp c1 ON c1.table_name = a.anchor
           JOIN comp c2 ON c2.component = c1.component GROUP BY a.qid)
SELECT qid, n_tables, tables, FALSE AS link_all FROM linked
UNION ALL
SELECT q.qid, 0 AS n_tables, '' AS tables, TRUE AS link_all FROM q
WHERE q.qid NOT IN (SELECT qid FROM anchor)""",
}


# -- byte-pair vocabulary jobs (iterative / Python helper: no SQL twin) ----------------------
BPE_VOCAB = 2048  # as the reference trains by default


def _merges(t):
    """Merges learned on documents.text, trained once per session and data folder."""
    from sqlweave.memo import memo
    from sqlweave.operators.bpe import bpe_train
    rows = memo(t.spark, t.root, "bpe_merges", lambda: bpe_train(t.documents, BPE_VOCAB).collect())
    return t.spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int")


def q_bpe_train(t):
    return _merges(t)


def q_bpe_encode(t):
    from sqlweave.operators.bpe import bpe_decode, bpe_encode
    m = _merges(t)
    enc = bpe_decode(bpe_encode(t.documents.select("doc_id", "text"), m), m)
    return enc.select("doc_id", F.octet_length("text").alias("n_bytes"),
                      F.size("ids").alias("n_tokens"),
                      (F.col("decoded") == F.col("text")).alias("round_trip"))


def q_compression_stats(t):
    from sqlweave.operators.bpe import bpe_encode, compression_stats
    m = _merges(t)
    return compression_stats(bpe_encode(t.documents.select("text"), m), m)


def q_piece_ids(t):
    """Every text by the numbers of its pre-tokens (most frequent first), joined back from the dictionary."""
    from sqlweave.operators.bpe import block_counts, coded_blocks, dictionary_join
    from sqlweave.operators.ranking import rank_over
    from sqlweave.session import ship_package
    ship_package(t.spark)
    blocks = coded_blocks(t.documents, pretokens("text"), ["doc_id"])
    ranked = rank_over(block_counts(blocks), "n", [], func="row_number", tiebreak=["piece"], out="id")
    joined = dictionary_join(blocks, ranked.select("piece", F.array("id").alias("ids")))
    part = F.transform("ids", lambda x, i: F.pmod((i + 1).cast("long") * x, F.lit(1_000_003)))
    each = joined.filter(F.size("ids") > 0).select("doc_id", F.size("ids").alias("n"), F.array_max("ids").alias("r"),
                         F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x).alias("c"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_pieces"), F.max("r").alias("rarest"), F.sum("c").alias("checksum"))


QUERIES.update({
    "piece_ids": q_piece_ids,
    "bpe_train": q_bpe_train,
    "bpe_encode": q_bpe_encode,
    "compression_stats": q_compression_stats,
})


SQL["piece_ids"] = f"""
WITH pieces AS (
  SELECT doc_id, unnest(list) AS piece, unnest(range(len(list))) AS pos FROM (
    SELECT doc_id, regexp_extract_all(text, '{PRETOKEN_PATTERN.replace(chr(92) + 'x0B', chr(92) + 'v')}') AS list
    FROM documents)),
ranked AS (SELECT piece, row_number() OVER (ORDER BY COUNT(*) DESC, piece) AS id FROM pieces GROUP BY piece)
SELECT doc_id, COUNT(*) AS n_pieces, MAX(id) AS rarest, SUM((pos + 1) * id % 1000003) AS checksum
FROM pieces JOIN ranked USING (piece) GROUP BY doc_id"""


# -- text rules over the catalog and whole conversation texts ----------------------------
def q_entity_label(t):
    from sqlweave.functions.text import alias_base, entity_label, pluralize
    tabs, _, _ = star_catalog(t)
    return tabs.select("table_name", entity_label("table_name").alias("entity"),
                       pluralize(entity_label("table_name")).alias("plural"),
                       alias_base("table_name").alias("alias"))


def q_label_phrases(t):
    from sqlweave.functions.text import group_label, label
    _, cols, _ = star_catalog(t)
    lbl = label("column_name", "business_label")
    return cols.select("table_name", "column_name", lbl.alias("label"),
                       group_label(lbl).alias("group_label"),
                       lbl.contains(" ").alias("is_phrase"))


def q_clean_question(t):
    from sqlweave.functions.text import clean_question
    c = t.conversations.filter(F.col("role") == "user")
    return c.select(_qid().alias("qid"), clean_question(F.regexp_replace(
        "text", r"[\t\n\r\f\x0B]", " ")).alias("question"))


QUERIES.update({
    "entity_label": q_entity_label,
    "label_phrases": q_label_phrases,
    "clean_question": q_clean_question,
})


def _tables_sql() -> str:
    rows = ", ".join(f"('{tb}')" for tb in star.CATALOG_TABLES)
    return f"(SELECT * FROM (VALUES {rows}) AS v(table_name))"


_ENT = ("replace(CASE WHEN regexp_matches(table_name, '(_lines_all|_lines)$') "
        "THEN regexp_replace(table_name, '(_lines_all|_lines)$', '_line') "
        "ELSE regexp_replace(table_name, '(_headers_all|_headers|_all|_vl|_tl|_v)$', '') END, "
        "'_', ' ')")

SQL.update({
    "entity_label": f"""
SELECT table_name, ent AS entity,
       CASE WHEN regexp_matches(ent, '(x|ch|sh|ss|z)$') THEN ent || 'es'
            WHEN ends_with(ent, 's') THEN ent
            WHEN regexp_matches(ent, '[^aeiou]y$') THEN regexp_replace(ent, 'y$', 'ies')
            ELSE ent || 's' END AS plural,
       array_to_string(list_transform(list_filter(string_split(table_name, '_'),
                                                  lambda x: length(x) > 0), lambda x: x[1]), '')[1:3]
         AS alias
FROM (SELECT table_name, {_ENT} AS ent FROM {_tables_sql()})""",
    "label_phrases": "SELECT table_name, column_name, label, "
                     "regexp_replace(label, ' name$', '') AS group_label, "
                     "contains(label, ' ') AS is_phrase FROM (" + f"""
SELECT v.table_name, v.column_name, COALESCE(f.business_label, replace(v.column_name, '_', ' '))
       AS label
FROM (VALUES {", ".join(f"('{tb}', '{c}')" for tb in star.CATALOG_TABLES
                        for c, _ in star.STAR_COLUMNS[tb])}) AS v(table_name, column_name)
LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in star.FLEX_LABELS.items())})
  AS f(table_name, column_name, business_label)
  ON f.table_name = v.table_name AND f.column_name = v.column_name)""",
    "clean_question": r"""
SELECT qid, CASE WHEN contains(sq, '?')
                 THEN trim(regexp_replace(replace(sq, '?', ''), '\s+', ' ', 'g')) || '?'
                 ELSE sq END AS question
FROM (SELECT conv_id * 1000000 + turn AS qid,
             trim(regexp_replace(regexp_replace(text, '[\t\n\r\f\x0B]', ' ', 'g'), '\s+', ' ', 'g'))
               AS sq
      FROM conversations WHERE role = 'user')""",
})
