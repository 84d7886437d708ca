"""Column-expression text rules: aliases, entity labels, plurals, question cleanup."""

from pyspark.sql import functions as F


def test_alias_map_numbers_clashes_and_skips_reserved(spark):
    from sqlweave.plans.render import alias_map
    df = spark.createDataFrame([(["o_n", "orders", "other", "ab_cd_ef_gh"],)], "t array<string>")
    got = df.select(alias_map(F.col("t")).alias("m")).first().m
    assert got == {"o_n": "on2", "orders": "o", "other": "o2", "ab_cd_ef_gh": "ace"}


def test_entity_label_and_plural(spark):
    from sqlweave.functions.text import clean_question, entity_label, group_label, pluralize
    rows = [("payment_headers_all",), ("receipt_lines_all",), ("gl_ledgers_v",), ("box",),
            ("category",), ("day",), ("status",)]
    df = spark.createDataFrame(rows, "t string")
    out = {r.t: (r.e, r.p) for r in df.select(
        "t", entity_label("t").alias("e"), pluralize(entity_label("t")).alias("p")).collect()}
    assert out["payment_headers_all"] == ("payment", "payments")
    assert out["receipt_lines_all"] == ("receipt line", "receipt lines")
    assert out["gl_ledgers_v"] == ("gl ledgers", "gl ledgers")
    assert out["box"][1] == "boxes" and out["category"][1] == "categories"
    assert out["day"][1] == "days" and out["status"][1] == "status"
    q = spark.createDataFrame([("what is  the total?  in 2024 ",), ("vendor name",)], "q string")
    got = [r.c for r in q.select(clean_question("q").alias("c")).collect()]
    assert got == ["what is the total in 2024?", "vendor name"]
    g = spark.createDataFrame([("vendor name",)], "l string").select(group_label("l")).first()[0]
    assert g == "vendor"
