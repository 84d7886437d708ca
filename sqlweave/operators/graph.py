"""Connected components by smallest label, with pointer jumping.

A round sends every node's label to its neighbours, keeps the smallest one (the
sums are partial before the shuffle), then replaces each label by its
label's label, so labels travel doubling distances. Edges and labels
are read from written tables, so both sides of every join are plain shuffles
whose hot keys (hubs) adaptive execution can split. The loop ends when no label
changes; it has no limit of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sqlweave.session import drop_table, write_table


def _written(df: DataFrame) -> tuple[DataFrame, object]:
    """The written table and its state: labels only ever get smaller, so while their sum
    (for names, a sum of hashes) stays the same no label has changed."""
    label = F.col("label").cast("decimal(38,0)") if df.schema["label"].dataType.typeName() in (
        "long", "integer", "short", "byte") else F.xxhash64("node", "label").cast("decimal(38,0)")
    seen = Observation()
    table = write_table(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(label).alias("s")), "labels")
    return table, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Direction, repeated edges and loops don't matter; edges with a null end are
    ignored. No edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    e = write_table(e.union(e.select("v", "u")), "edges")
    labels, state = _written(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
                             .select("node", F.least("node", "v").alias("label")))
    while True:
        near, now = _written(e.join(labels, e.u == labels.node).select(F.col("v").alias("node"), "label")
                             .union(labels).groupBy("node").agg(F.min("label").alias("label")))
        drop_table(labels)
        if now == state:
            drop_table(e)
            return near.select("node", F.col("label").alias("component"))
        far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels, state = _written(near.join(far, "label").select("node", F.col("far").alias("label")))
        drop_table(near)
