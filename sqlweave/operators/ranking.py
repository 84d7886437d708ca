"""RANK / DENSE_RANK / ROW_NUMBER that never send one group to one task.

``Window.partitionBy(k).orderBy(desc(v))`` puts every row of a key into one
task, and a window with no partition key puts the whole table there. Here the
rows are range-partitioned on (partition keys, order value) and written once, with
the partition's number as a column: range bounds are sampled per evaluation, so
every reader must see one copy. Equal (keys, v) always share a partition.

A native window over (partition number, keys) ranks locally; a hot key is many
such groups. The last local row number and dense rank of a (partition, key) are
summed over the earlier partitions of the key, which gives what a key that
continues from an earlier partition has to add. Only a partition's first key can
continue, so the added table has at most one row per partition and is broadcast.

Global value = local value + offset. ROW_NUMBER breaks ties by ``tiebreak``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.session import write_table

_FUNCS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def rank_over(df: DataFrame, order_col: str, partition_cols=(), func: str = "rank",
              tiebreak=(), out: str = "rnk", num_partitions: int | None = None,
              ascending: bool = False) -> DataFrame:
    """Add ``out`` = func() OVER (PARTITION BY partition_cols ORDER BY order_col DESC).

    ``ascending`` flips the order. NULL order values sort last either way, as
    in Spark and DuckDB by default.
    """
    func = func.lower()
    if func not in _FUNCS:
        raise ValueError(f"func must be one of {sorted(_FUNCS)}")
    p = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(partition_cols)
    by = F.col(order_col).asc_nulls_last() if ascending else F.col(order_col).desc_nulls_last()
    base = df if keys else df.withColumn("_k", F.lit(0))
    keys = keys or ["_k"]
    placed = write_table(base.repartitionByRange(p, *[F.col(k).asc_nulls_first() for k in keys], by)
                         .withColumn("_pid", F.spark_partition_id()), "ranked")
    near = Window.partitionBy("_pid", *keys).orderBy(by, *[F.col(c).asc_nulls_first() for c in tiebreak])
    ties = Window.partitionBy("_pid", *keys).orderBy(by)
    order = near if func == "row_number" else ties
    local = placed.withColumn(out, _FUNCS[func]().over(order).cast("long"))
    # what each (partition, key) holds: rows, or distinct order values for the dense rank
    held = F.count(F.lit(1))
    if func == "dense_rank":
        held = F.count_distinct(F.col(order_col)) + F.max(F.col(order_col).isNull().cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_pid", *keys).agg(held.alias("_held"))
               .withColumn("_add", F.sum("_held").over(earlier)).filter("_add > 0")
               .select(F.col("_pid").alias("_op"), *[F.col(k).alias(f"_o_{k}") for k in keys], "_add"))
    same = [F.col("_pid") == F.col("_op")] + [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    joined = local.join(F.broadcast(offsets), same, "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("_add", F.lit(0))).select(*df.columns, out)
