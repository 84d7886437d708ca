"""Column expressions shared by the query shapes.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def year_eq(col, year: int) -> Column:
    """``EXTRACT(YEAR FROM col) = year`` as a half-open range.

    The range form reaches the parquet reader as two pushed bounds; the
    ``year(col) = y`` form only pushes ``IsNotNull``. Literals are cast to
    ``timestamp_ntz`` so nothing depends on the session time zone.
    """
    c = _c(col)
    lo = F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return (c >= lo) & (c < hi)


def date_part(col, part: str) -> Column:
    """year / month / day extraction."""
    fn = {"year": F.year, "month": F.month, "day": F.dayofmonth}[part.lower()]
    return fn(_c(col))


def sql_literal(value) -> str:
    """SQL text of a literal: strings quoted with ``'`` doubled; numbers bare."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)
