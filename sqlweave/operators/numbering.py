"""Gapless global row numbers without a single-task window.

The rows are range-partitioned on the order columns and sorted inside each
partition; ``monotonically_increasing_id`` then holds the partition (high bits)
and the position in it (low 33 bits). The rows are written once to the shared
folder, because range bounds are sampled per evaluation and both readers must
see one copy. A count per partition gives the offsets: one row per partition.
A hot value is spread over as many partitions as the further order columns
can tell apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.session import write_table

_POS_BITS = 33


def row_numbers(df: DataFrame, order, out: str = "rn", sums: dict | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``out``: 0-based row number over ``order`` (a list of column names).

    ``sums`` maps a new column to an integer column; it gets the exact sum of
    that column over all earlier rows (an exclusive prefix sum). Rows equal in
    all order columns are numbered in an arbitrary order.
    """
    spark = df.sparkSession
    sums = sums or {}
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(p, *[F.col(c).asc_nulls_first() for c in order])
              .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
              .withColumn("_mid", F.monotonically_increasing_id()))
    t = write_table(placed, "numbered")
    t = t.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
    parts = sorted(t.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"),
                                         *[F.sum(c).alias(f"s_{k}") for k, c in sums.items()])
                   .collect())  # one row per partition
    rows, base, tot = [], 0, {k: 0 for k in sums}
    for r in parts:
        rows.append((r["_pid"], base, *[tot[k] for k in sums]))
        base += r["n"]
        for k in sums:
            tot[k] += r[f"s_{k}"] or 0
    schema = "_pid long, _base long" + "".join(f", _b_{k} long" for k in sums)
    offsets = F.broadcast(spark.createDataFrame(rows, schema))  # at most p rows
    out_df = t.join(offsets, "_pid")
    out_df = out_df.withColumn(out, F.col("_base") + F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1))
    if sums:
        from pyspark.sql import Window
        w = (Window.partitionBy("_pid").orderBy("_mid")
             .rowsBetween(Window.unboundedPreceding, -1))
        for k, c in sums.items():
            out_df = out_df.withColumn(k, F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out_df.drop("_pid", "_mid", "_base", *[f"_b_{k}" for k in sums])
