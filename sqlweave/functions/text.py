"""Text rules as Spark column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlweave.functions.phrases import STOP_WORDS

# -- fixed values ------------------------------------------------------------
# Pre-token pattern of the byte-pair tokenizer: identifiers, digit runs,
# whitespace runs, single other characters. Whitespace is spelled out as ASCII
# so Java and RE2 agree.
PRETOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[ \t\n\r\f\x0B]+|[^ \t\n\r\f\x0BA-Za-z0-9_]"
# Words of a question used for linking.
WORD_PATTERN = r"[a-z0-9]+"
# Table-name endings dropped when naming the entity; line tables keep "line".
LINE_SUFFIXES = ("_lines_all", "_lines")
TABLE_SUFFIXES = ("_headers_all", "_headers", "_all", "_vl", "_tl", "_v")
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def norm_type(raw) -> Column:
    """Raw dictionary type to NUMBER / DATE / VARCHAR2 (exact number names only)."""
    u = F.upper(_c(raw))
    return (F.when(u.isin("NUMBER", "INTEGER", "FLOAT", "DECIMAL"), F.lit("NUMBER"))
            .when(u.startswith("DATE") | u.startswith("TIMESTAMP"), F.lit("DATE"))
            .otherwise(F.lit("VARCHAR2")))


def norm_owner(owner) -> Column:
    """Upper case, keeping only letters, digits and underscore (safe to inline)."""
    return F.regexp_replace(F.upper(_c(owner)), r"[^A-Z0-9_]", "")


def label(name, business_label=None) -> Column:
    """Business label if present, else the name with ``_`` as spaces."""
    spaced = F.translate(_c(name), "_", " ")
    return spaced if business_label is None else F.coalesce(_c(business_label), spaced)


def entity_label(table) -> Column:
    """Strip table suffixes; line tables keep 'line' (``x_lines_all`` -> 'x line').

    Anchored alternations pick the longest matching suffix, which is the
    first one listed for every suffix in the fixed lists above.
    """
    t = _c(table)
    line_re = "(" + "|".join(LINE_SUFFIXES) + ")$"
    tail_re = "(" + "|".join(TABLE_SUFFIXES) + ")$"
    stem = F.when(t.rlike(line_re), F.regexp_replace(t, line_re, "_line")).otherwise(
        F.regexp_replace(t, tail_re, ""))
    return F.translate(stem, "_", " ")


def pluralize(word) -> Column:
    """-es after x/ch/sh/ss/z; words ending in s kept; consonant+y -> ies; else -s."""
    w = _c(word)
    return (F.when(w.rlike("(x|ch|sh|ss|z)$"), F.concat(w, F.lit("es")))
            .when(w.endswith("s"), w)
            .when(w.rlike("[^aeiou]y$"), F.regexp_replace(w, "y$", "ies"))
            .otherwise(F.concat(w, F.lit("s"))))


def group_label(lbl) -> Column:
    """A group's label without a closing ' name'."""
    return F.regexp_replace(_c(lbl), " name$", "")


def clean_question(q) -> Column:
    """Squeeze spaces; any '?' moves to the end."""
    squeezed = F.trim(F.regexp_replace(_c(q), r"\s+", " "))
    no_q = F.trim(F.regexp_replace(F.regexp_replace(squeezed, r"\?", ""), r"\s+", " "))
    return F.when(squeezed.contains("?"), F.concat(no_q, F.lit("?"))).otherwise(squeezed)


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def content_tokens(text) -> Column:
    """Distinct lower-case ``[a-z0-9]+`` words of a text minus stop words."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)
    return F.array_except(F.array_distinct(words), stop_words())


def pretokens(text) -> Column:
    """Pre-tokens in order (spaces kept), the units BPE merges within."""
    return F.regexp_extract_all(_c(text), F.lit(PRETOKEN_PATTERN), 0)


def alias_base(table) -> Column:
    """Initials of the ``_``-separated name parts, at most 3; else first 2 letters."""
    parts = F.filter(F.split(_c(table), "_"), lambda p: F.length(p) > 0)
    initials = F.substring(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""), 1, 3)
    return F.when(F.length(initials) > 0, initials).otherwise(F.substring(_c(table), 1, 2))
