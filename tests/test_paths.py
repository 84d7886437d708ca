"""Join paths: BFS order ties, unreachable targets, components, join trees."""


def _fks(spark, rows):
    return spark.createDataFrame(
        [(i + 1, a, ac, b, bc, False, "s") for i, (a, ac, b, bc) in enumerate(rows)],
        "fk_pos long, from_table string, from_column string, to_table string, to_column string, "
        "declared boolean, schema_id string")


def test_shortest_path_tie_goes_to_first_fk(spark):
    from sqlweave.operators.paths import join_paths
    # square a-b-d and a-c-d: two shortest paths to d; the one through the earlier FK wins
    fks = _fks(spark, [("a", "c_id", "c", "c_id"), ("a", "b_id", "b", "b_id"),
                       ("b", "d_id", "d", "d_id"), ("c", "d_id", "d", "d_id")])
    req = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "z")], "src string, dst string")
    got = {(r.src, r.dst): r for r in join_paths(fks, req).collect()}
    assert [f.to_table for f in got[("a", "d")].path] == ["c", "d"]
    assert got[("a", "a")].path == [] and got[("a", "a")].hops == 0
    assert got[("a", "z")].path is None


def test_components_and_reach(spark):
    from sqlweave.operators.paths import components, reachable
    fks = _fks(spark, [("a", "b_id", "b", "b_id"), ("b", "c_id", "c", "c_id"),
                       ("x", "y_id", "y", "y_id")])
    tabs = spark.createDataFrame([(t,) for t in "abcxyz"], "table_name string")
    comp = {r.table_name: r.component for r in components(tabs, fks).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    src = spark.createDataFrame([("a",)], "src string")
    assert {(r.table_name, r.hops) for r in reachable(fks, src, 1).collect()} == {("b", 1)}


def test_join_tree_flags_unreachable(spark):
    from sqlweave.operators.paths import join_tree
    fks = _fks(spark, [("a", "b_id", "b", "b_id"), ("b", "c_id", "c", "c_id")])
    req = spark.createDataFrame([(1, "a", ["c", "b", "q"])],
                                "tree_id int, anchor string, targets array<string>")
    rows = join_tree(fks, req).collect()
    assert {(r.from_table, r.to_table) for r in rows} == {("a", "b"), ("b", "c")}
    assert {r.unreachable for r in rows} == {"q"}


def test_long_chain_is_one_component(spark):
    from sqlweave.operators.paths import components
    names = [f"t{i:03d}" for i in range(70)]
    tabs = spark.createDataFrame([(n,) for n in names + ["alone"]], "table_name string")
    fks = spark.createDataFrame([(i, a, "x", b, "x") for i, (a, b) in enumerate(zip(names, names[1:]))],
                                "fk_pos long, from_table string, from_column string, to_table string, to_column string")
    got = {r.table_name: r.component for r in components(tabs, fks).collect()}
    assert {got[n] for n in names} == {"t000"} and got["alone"] == "alone"
