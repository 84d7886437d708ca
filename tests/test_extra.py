"""Synthetic catalogs, merged catalogs and the JDBC-shaped dictionary path."""

from pyspark.sql import functions as F


def test_synth_catalog_is_consistent(spark):
    from sqlweave.operators.specs import enumerate_specs, validate_specs
    from sqlweave.operators.synth import synth_catalog
    seeds = spark.range(0, 40).withColumnRenamed("id", "seed")
    for style in ("default", "procedural", "business"):
        tabs, cols, fks = synth_catalog(spark, seeds, style)
        assert tabs.select("schema_id").distinct().count() == 40
        # every FK end is a column of the catalog
        ends = fks.select("schema_id", F.col("to_table").alias("table_name"),
                          F.col("to_column").alias("column_name")).unionByName(
            fks.select("schema_id", F.col("from_table").alias("table_name"),
                       F.col("from_column").alias("column_name")))
        assert ends.join(cols, ["schema_id", "table_name", "column_name"], "left_anti").count() == 0
        # multi-org tables carry the _all suffix
        assert tabs.filter("is_multi_org AND NOT table_name LIKE '%\\_all'").count() == 0
    specs = enumerate_specs(tabs, cols, fks, n_per_level=3)
    assert validate_specs(specs, tabs, cols, fks).count() == 0


def test_dictionary_catalog_from_frames(spark):
    from sqlweave.sources.dictionary import dictionary_catalog
    f = {
        "installs": spark.createDataFrame([(1, "I")], "oracle_id int, status string"),
        "users": spark.createDataFrame([(1, "PO")], "oracle_id int, oracle_username string"),
        "tables": spark.createDataFrame([("PO", "PO_HEADERS_ALL"), ("PO", "PO_VENDORS")],
                                        "owner string, table_name string"),
        "synonyms": spark.createDataFrame([("PO_HEADERS_ALL", "PO", "PO_HEADERS_ALL")],
                                          "synonym_name string, table_owner string, "
                                          "table_name string"),
        "columns": spark.createDataFrame(
            [("PO", "PO_HEADERS_ALL", "PO_HEADER_ID", "NUMBER", "N", 1),
             ("PO", "PO_HEADERS_ALL", "VENDOR_ID", "NUMBER", "Y", 2),
             ("PO", "PO_VENDORS", "VENDOR_ID", "NUMBER", "N", 1)],
            "owner string, table_name string, column_name string, data_type string, "
            "nullable string, column_id int"),
        "constraints": spark.createDataFrame(
            [("PO", "H_PK", "PO_HEADERS_ALL", "P", None, None),
             ("PO", "V_PK", "PO_VENDORS", "P", None, None)],
            "owner string, constraint_name string, table_name string, constraint_type string, "
            "r_owner string, r_constraint_name string"),
        "cons_columns": spark.createDataFrame([("PO", "H_PK", "PO_HEADER_ID", 1),
                                               ("PO", "V_PK", "VENDOR_ID", 1)],
                                              "owner string, constraint_name string, "
                                              "column_name string, position int"),
    }
    tabs, cols, fks = dictionary_catalog(f)
    assert {r.table_name for r in tabs.collect()} == {"po_headers_all", "po.po_vendors"}
    got = [(r.from_table, r.from_column, r.to_table) for r in fks.collect()]
    assert got == [("po_headers_all", "vendor_id", "po.po_vendors")]


def test_merged_catalogs_keep_unique_positions(spark, demo_catalog):
    from sqlweave.operators.catalog import merge_catalogs, prefix_catalog
    from sqlweave.operators.paths import join_paths
    tabs, cols, fks = demo_catalog
    for merged in (prefix_catalog(tabs, cols, fks, ["a_", "b_", "c_"]),
                   merge_catalogs([(p, tabs, cols, fks) for p in ("a_", "b_", "c_")])):
        t, _, f = merged
        n = f.count()
        assert n == 3 * fks.count() and f.select("fk_pos").distinct().count() == n
        assert t.select("table_pos").distinct().count() == t.count()
        req = spark.createDataFrame([(p + "po_order_lines_all", p + "po_vendors") for p in ("a_", "b_", "c_")],
                                    "src string, dst string")
        for r in join_paths(f, req).collect():
            prefix = r.src[:2]
            assert r.hops == 2 and len(r.path) == 2
            assert all(x.from_table.startswith(prefix) and x.to_table.startswith(prefix) for x in r.path)


def test_small_checkpoints_have_few_partitions(spark):
    """A catalog-sized table doesn't keep a partition per shuffle task; no row is lost, and many rows stay spread."""
    from sqlweave.session import materialize
    few = materialize(spark.range(50).repartition(40, "id"))
    assert few.rdd.getNumPartitions() == 1
    assert sorted(x.id for x in few.collect()) == list(range(50))
    assert materialize(spark.range(0).repartition(40, "id")).count() == 0
    assert materialize(spark.range(20_000).repartition(40, "id")).rdd.getNumPartitions() == min(40, spark.sparkContext.defaultParallelism)


def _tasks(spark, group, job):
    """What ``job`` returns, and how many tasks its stages ran."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = job()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)


def test_checkpoints_run_no_task_per_shuffle_partition(spark):
    """Odd rows come back whole, and a small grouped table costs as many tasks with 8 shuffle partitions as with 300."""
    from pyspark.sql import functions as F
    from sqlweave.session import materialize
    rows = [(None, None), (1, ["a", None]), (1, []), (2, None), (None, ["b"]), (None, ["b"])]
    df = spark.createDataFrame(rows, "k int, v array<string>")
    assert sorted(map(repr, materialize(df).collect())) == sorted(map(repr, df.collect()))
    grouped = df.groupBy("k").agg(F.count("v").alias("n"), F.collect_list("v").alias("vs"))
    before, used = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (8, 300):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            out, n = _tasks(spark, f"materialize-{parts}", lambda: materialize(grouped))
            assert sorted((r.k or 0, r.n, len(r.vs)) for r in out.collect()) == [(0, 2, 2), (1, 2, 2), (2, 0, 0)]
            used.append(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert used[0] == used[1] < 60


def test_rounds_over_one_block_run_one_task(spark):
    """The pair counts of blocks that one task reads need no shuffle; more blocks give the same counts."""
    from sqlweave.operators import bpe
    hist = spark.createDataFrame([("abab", 3), ("ab", 2), ("bca", 1), ("x", 9), ("caab", 4)], "piece string, cnt long")
    blocks = bpe.piece_blocks(hist)
    made = [[(97, 98, 256)], [(256, 256, 257)]]
    many = spark.createDataFrame([(p, n) for p, n in hist.collect()], hist.schema)
    many = [bpe.piece_blocks(many.filter(f"piece = '{p}'")) for p in ("abab", "ab", "bca", "caab")]
    spread = many[0].union(many[1]).union(many[2]).union(many[3])
    assert spread.rdd.getNumPartitions() > 1 and bpe._readable(spread) is spread
    for rounds in ([], made[:1], made):
        got, n = _tasks(spark, f"round-{len(rounds)}", lambda: bpe._changes(bpe._readable(blocks), rounds))
        assert n == 1 and sorted(got) == sorted(bpe._changes(spread, rounds)) and got
