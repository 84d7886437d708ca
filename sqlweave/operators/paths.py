"""Join-graph jobs over FK edges: shortest paths, reach, components, FK lookup.

The FK graph is undirected for joining. A breadth-first search that takes
neighbours in FK order, keeping the first parent found, returns for each
target the lexicographically smallest sequence of FK positions among the
shortest paths. That is what the frontier joins below compute: per round, one
join of the frontier with the edge list, an anti join against what is already
reached, and ``min(path)`` per (schema, source, node). Only the requested sources are
expanded, all of them together, so the state is (#sources x component size), never all pairs.

One frame may hold several catalogs: where the requests carry ``schema_id``, a table is
the pair (schema_id, table) and no path leaves its catalog. Requests without the column
take the edges as those of one catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.operators.graph import connected_components
from sqlweave.session import drop_table, write_table

SEP = "\u001f"  # between catalog and table in a node's name


def scoped(df: DataFrame, keyed: bool) -> DataFrame:
    """``df`` with its ``schema_id``, or with one empty one for all rows."""
    return df if keyed else df.withColumn("schema_id", F.lit(""))


def undirected_edges(cat_fks: DataFrame) -> DataFrame:
    """(schema_id if there, a, b, fk_pos) in both directions."""
    key = [c for c in ("schema_id",) if c in cat_fks.columns]
    f = cat_fks.select(*key, "fk_pos", "from_table", "to_table")
    return (f.select(*key, F.col("from_table").alias("a"), F.col("to_table").alias("b"), "fk_pos")
            .unionByName(f.select(*key, F.col("to_table").alias("a"), F.col("from_table").alias("b"),
                                  "fk_pos")))


def bfs(cat_fks: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(schema_id if given, src, node, hops, path ARRAY<fk_pos>) for every node reachable from each src.

    The source itself is included with hops 0 and an empty path. Rounds stop
    when no new node is reached, or after ``max_hops``. A round reads the written rounds
    before it, so lineage stays one round long.
    """
    keyed = "schema_id" in sources.columns
    edges = write_table(scoped(undirected_edges(cat_fks), keyed).select(
        "schema_id", "a", "b", F.col("fk_pos").cast("long").alias("fk_pos")), "edges")
    start = scoped(sources, keyed).select("schema_id", "src").distinct()
    rounds = [write_table(start.select("schema_id", "src", F.col("src").alias("node"), F.lit(0).alias("hops"),
                                       F.array().cast("array<long>").alias("path")), "frontier")]
    while max_hops is None or len(rounds) <= max_hops:
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        near = (rounds[-1].withColumnRenamed("node", "a").join(edges, ["schema_id", "a"])
                .select("schema_id", "src", F.col("b").alias("node"), F.concat("path", F.array("fk_pos")).alias("path")))
        fresh = near.join(seen.select("schema_id", "src", "node"), ["schema_id", "src", "node"], "left_anti")
        nxt = write_table(fresh.groupBy("schema_id", "src", "node").agg(F.min("path").alias("path")).select(
            "schema_id", "src", "node", F.lit(len(rounds)).alias("hops"), "path"), "frontier")
        if nxt.isEmpty():
            drop_table(nxt)
            break
        rounds.append(nxt)
    drop_table(edges)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out if keyed else out.drop("schema_id")


def join_paths(cat_fks: DataFrame, requests: DataFrame) -> DataFrame:
    """Shortest FK path per requested (schema_id if given, src, dst).

    ``path`` is an ARRAY of FK structs in walking order: empty when src = dst,
    NULL when dst is unreachable.
    """
    keyed = "schema_id" in requests.columns
    key = ["schema_id", "src", "dst"]
    r = scoped(requests, keyed).select(*key).distinct()
    reached = scoped(bfs(cat_fks, requests.drop("dst")), keyed)
    hit = r.join(reached.withColumnRenamed("node", "dst"), key, "left")
    steps = hit.select(*key, F.posexplode_outer("path").alias("step", "fk_pos"))
    fk = scoped(cat_fks, keyed).select("schema_id", "fk_pos", F.struct(
        "from_table", "from_column", "to_table", "to_column").alias("fk"))
    walked = (steps.join(fk, ["schema_id", "fk_pos"], "left")
              .groupBy(*key)
              .agg(F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(),
                                                      F.struct("step", "fk")))).alias("s")))
    out = hit.select(*key, "hops", F.col("path").isNull().alias("_unreach")).join(walked, key)
    path = F.when(F.col("_unreach"), F.lit(None)).otherwise(F.transform("s", lambda x: x["fk"]))
    return out.select(*key[0 if keyed else 1:], "hops", path.alias("path"))


def render_path(path) -> F.Column:
    """'a.x=b.y > b.z=c.w' text of a path column (empty path -> '', NULL stays NULL)."""
    return F.array_join(F.transform(path, lambda f: F.concat(
        f["from_table"], F.lit("."), f["from_column"], F.lit("="), f["to_table"], F.lit("."),
        f["to_column"])), " > ")


def reachable(cat_fks: DataFrame, sources: DataFrame, max_hops: int = 2) -> DataFrame:
    """(schema_id if given, src, table_name, hops) for tables within ``max_hops`` FK hops (source excluded)."""
    r = bfs(cat_fks, sources, max_hops=max_hops)
    return r.filter(F.col("hops") > 0).withColumnRenamed("node", "table_name").drop("path")


def neighbors(cat_fks: DataFrame) -> DataFrame:
    """(schema_id if there, table_name, neighbor, n_fks)."""
    e = undirected_edges(cat_fks)
    key = [c for c in ("schema_id",) if c in e.columns]
    return e.groupBy(*key, F.col("a").alias("table_name"), F.col("b").alias("neighbor")).agg(
        F.count("*").alias("n_fks"))


def fk_between(cat_fks: DataFrame) -> DataFrame:
    """First FK (lowest position) linking each unordered table pair of a catalog."""
    key = [c for c in ("schema_id",) if c in cat_fks.columns]
    t1 = F.least("from_table", "to_table")
    t2 = F.greatest("from_table", "to_table")
    return (cat_fks.groupBy(*key, t1.alias("t1"), t2.alias("t2"))
            .agg(F.min_by(F.struct("from_table", "from_column", "to_table", "to_column"),
                          "fk_pos").alias("fk"))
            .select(*key, "t1", "t2", "fk.*"))


def components(cat_tables: DataFrame, cat_fks: DataFrame) -> DataFrame:
    """(schema_id if there, table_name, component): the smallest table name in its FK-connected set.

    Tables without an FK are their own component.
    """
    keyed = "schema_id" in cat_tables.columns and "schema_id" in cat_fks.columns
    node = lambda c: F.concat("schema_id", F.lit(SEP), c)
    ends = scoped(cat_fks, keyed).select(node("from_table").alias("a"), node("to_table").alias("b"))
    found = connected_components(ends)
    tabs = scoped(cat_tables, keyed).select("schema_id", "table_name", node("table_name").alias("node"))
    out = tabs.join(found, "node", "left").select(
        "schema_id", "table_name", F.coalesce(F.element_at(F.split("component", SEP), 2), "table_name").alias("component"))
    return out if keyed else out.drop("schema_id")


def join_tree(cat_fks: DataFrame, requests: DataFrame) -> DataFrame:
    """Union of shortest paths from each request's anchor to each target.

    ``requests``: (schema_id if there are several, tree_id, anchor, targets ARRAY<STRING>). Returns one row
    per distinct FK edge (tree_id, edge_pos, from_table, from_column, to_table,
    to_column), or a row with ``unreachable`` set to the first table with no path.
    """
    keyed = "schema_id" in requests.columns
    key = ["schema_id", "tree_id"][0 if keyed else 1:]
    req = requests.select(*key, "anchor", F.posexplode("targets").alias("tpos", "target"))
    ends = [*key[:-1], F.col("anchor").alias("src"), F.col("target").alias("dst")]
    found = join_paths(cat_fks, req.select(*ends).distinct())
    j = req.select(*ends, "tree_id", "tpos").join(found, [*key[:-1], "src", "dst"]).select(*key, "tpos", "dst", "path")
    bad = (j.filter(F.col("path").isNull()).groupBy(*key)
           .agg(F.min_by("dst", "tpos").alias("unreachable")))
    edges = (j.filter(F.col("path").isNotNull())
             .select(*key, "tpos", F.posexplode("path").alias("step", "fk"))
             .groupBy(*key, "fk")
             .agg(F.min(F.struct("tpos", "step")).alias("edge_pos"))
             .select(*key, F.col("edge_pos.tpos").alias("tpos"),
                     F.col("edge_pos.step").alias("step"), "fk.*"))
    return edges.join(bad, key, "left")
