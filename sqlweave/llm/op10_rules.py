"""Operator 10, quality rules with adaptive thresholds (DataFrame functions only).

Each rule's measure is an integer (per mille, or tenths of a character). A
quantile sketch per (lang, source, measure) counts unit buckets 0..4,095 and, above,
2,048 buckets for each doubling of the value, without a top: sketches merge by adding
counts, are of bounded size and don't depend on the order of the rows. The quartiles of
a group (the lower bucket's least value and the upper bucket's greatest) give
its fences (quartile +- 4 interquartile ranges, with a least width per measure)
in place of fixed cutoffs; the fences are joined back on (lang, source) and
documents outside are not kept. Groups of fewer than 20 documents use the
fences of their language.

Words are runs of characters other than space and 0x09-0x0D. Repeated 8-word
windows are found within the row by sorting 64-bit window hashes.

Nulls: a null text has no words and fails the base rules; a null lang or source
is a group of its own. Repeated rows count each. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlweave.llm.common import load
from sqlweave.session import write_table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
TOP = 4095  # last unit bucket of a sketch; the twin's sketches end here
FENCE = 4  # interquartile ranges beyond the quartile
LEAST_ROWS = 20
#: measure -> least width of its fence
WIDTHS = {"symbols": 30, "word_length": 10, "dup_lines": 350, "repeats": 200}
BROADCAST_ROWS = 50_000


def base_columns(df: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = df.withColumns({"_words": F.array_remove(F.split(text, SPACE), ""),
                        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(F.size("_words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))),
    }).drop("_words", "_lines")
    # window hashes with their places, sorted: equal windows are neighbours
    d = d.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_hashes")
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_places", F.sort_array(F.transform(
        F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def measures() -> dict:
    """Each rule's integer measure over the base columns."""
    ratio = lambda a, b, k: F.floor(F.col(a) * k / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbols": ratio("n_symbols", "word_chars", 1000),
            "word_length": ratio("word_chars", "n_words", 10),
            "dup_lines": ratio("n_dup_lines", "n_lines", 1000),
            "repeats": ratio("n_repeat_words", "n_words", 1000)}


def spacing(v) -> Column:
    """Width of the bucket that holds ``v``: 1 up to TOP, then a 2,048th to a 4,096th of the value."""
    bits = F.greatest(F.length(F.bin(v)) - TOP.bit_length(), F.lit(0))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def sketches(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): one mergeable histogram sketch per group and measure."""
    each = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), (F.col(m) - F.col(m) % spacing(F.col(m))).alias("bucket"))
        for m in names])).alias("x"))
    return each.groupBy(*keys, "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], widths: dict) -> DataFrame:
    """(keys, rows, <measure>_lo, <measure>_hi) from the sketches' quartiles."""
    group = Window.partitionBy(*keys, "measure")
    d = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group)})
    q = d.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows") * 3, F.col("bucket"))).alias("q3"))
    width = F.greatest((F.col("q3") - F.col("q1")) * FENCE,
                       F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])[F.col("measure")])
    q = q.withColumns({"lo": F.col("q1") - width, "hi": F.col("q3") + spacing(F.col("q3")) - 1 + width})
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return q.groupBy(*keys).agg(F.max("rows").alias("rows"), *[pick(m, c) for m in widths for c in ("lo", "hi")])


def adaptive_rules(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Base columns, base_failed and kept for every row of ``df`` (key, text, lang, source)."""
    names = list(WIDTHS)
    rows = base_columns(df.select(key, "text", "lang", "source")).drop("text")
    rows = write_table(rows.withColumns(measures()), "rules")
    by_source = sketches(rows, ["lang", "source"], names)
    fine = fences(by_source, ["lang", "source"], WIDTHS)
    coarse = fences(merge(by_source, ["lang"]), ["lang"], WIDTHS)
    cols = [f"{m}_{c}" for m in names for c in ("lo", "hi")]
    coarse = coarse.select(F.col("lang").alias("_l"), *[F.col(c).alias(f"_{c}") for c in cols])
    limits = fine.join(coarse, F.col("lang").eqNullSafe(F.col("_l"))).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        *[F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in cols])
    limits = write_table(limits, "limits")
    if limits.count() <= BROADCAST_ROWS:  # beyond, a shuffled join whose hot keys AQE splits
        limits = F.broadcast(limits)
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    inside = F.lit(True)
    for m in names:
        inside = inside & F.col(m).between(F.col(f"{m}_lo"), F.col(f"{m}_hi"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "base_failed", "kept"]


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return adaptive_rules(load(spark, sf_dir, "documents")).select(*COLUMNS)


def _sql() -> str:
    span = ", ".join(f"{m}_lo, {m}_hi" for m in WIDTHS)
    case = " ".join(f"WHEN '{m}' THEN {w}" for m, w in WIDTHS.items())
    picks = ", ".join(f"max({c}) FILTER (measure = '{m}') AS {m}_{c}" for m in WIDTHS for c in ("lo", "hi"))
    choose = ", ".join(f"CASE WHEN f.rows >= {LEAST_ROWS} THEN f.{m}_{c} ELSE g.{m}_{c} END AS {m}_{c}"
                       for m in WIDTHS for c in ("lo", "hi"))
    inside = " AND ".join(f"{m} BETWEEN {m}_lo AND {m}_hi" for m in WIDTHS)
    wide = lambda v: f"(1::BIGINT << greatest(length(bin({v})) - {TOP.bit_length()}, 0))"  # noqa: E731  a bucket's width
    quart = lambda keys: f"""SELECT {keys}, max(rows) AS rows, {picks} FROM (
      SELECT *, q1 - w AS lo, q3 + {wide("q3")} - 1 + w AS hi FROM (
        SELECT *, greatest((q3 - q1) * {FENCE}, CASE measure {case} END) AS w FROM (
          SELECT {keys}, measure, count(*) AS rows,
                 quantile_disc(v - v % {wide("v")}, 0.25) AS q1, quantile_disc(v - v % {wide("v")}, 0.75) AS q3
          FROM long_rows GROUP BY {keys}, measure))) GROUP BY {keys}"""  # noqa: E731
    return f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, unnest(range({WINDOW})) AS k FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
m AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbols,
         word_chars * 10 // greatest(n_words, 1) AS word_length,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats FROM b),
long_rows AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m" for m in WIDTHS)}),
fine AS ({quart("lang, source")}),
coarse AS ({quart("lang")}),
lim AS (
  SELECT f.lang, f.source, {choose}
  FROM fine f JOIN coarse g ON f.lang IS NOT DISTINCT FROM g.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AS base_failed,
       NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND {inside} AS kept
FROM (SELECT m.*, {span} FROM m JOIN lim
      ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source)
"""


QUERIES = {"op10_rules": op10_rules}
SQL = {"op10_rules": _sql()}
