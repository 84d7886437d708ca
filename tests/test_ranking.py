"""Distributed RANK / DENSE_RANK / ROW_NUMBER against pandas, including one hot key."""

import numpy as np
import pandas as pd
import pytest

from sqlweave.operators.ranking import rank_over


def _frame(spark, n=4000, hot_share=0.4, seed=7):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < hot_share, 0, rng.integers(1, 50, n))
    vals = rng.integers(0, 300, n).astype(float)
    vals[rng.random(n) < 0.02] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys, "v": vals})
    return spark.createDataFrame(pdf).replace(float("nan"), None), pdf


@pytest.mark.parametrize("func,method", [("rank", "min"), ("dense_rank", "dense"),
                                         ("row_number", "first")])
def test_rank_matches_pandas_with_hot_key(spark, func, method):
    df, pdf = _frame(spark)
    got = rank_over(df, "v", ["k"], func=func, tiebreak=["id"], num_partitions=16).toPandas()
    exp = pdf.sort_values(["k", "id"]).copy()
    filled = exp["v"].fillna(-1e18)  # NULLs last under DESC
    exp["rnk"] = (exp.assign(f=filled).sort_values(["k", "f", "id"], ascending=[True, False, True])
                  .groupby("k")["f"].rank(method=method, ascending=False).astype(int))
    merged = got.merge(exp[["id", "rnk"]], on="id", suffixes=("", "_exp"))
    assert len(merged) == len(pdf)
    assert (merged["rnk"] == merged["rnk_exp"]).all()


def test_global_rank_spans_partitions(spark):
    df, pdf = _frame(spark, n=3000, hot_share=0.0)
    got = rank_over(df, "v", [], func="rank", num_partitions=12).toPandas()
    exp = pdf["v"].fillna(-1e18).rank(method="min", ascending=False).astype(int)
    assert (got.sort_values("id")["rnk"].to_numpy() == exp.to_numpy()).all()


def test_ascending_row_number_over_strings(spark):
    names = [f"t{i:03d}" for i in range(500)][::-1]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = rank_over(df, "name", [], func="row_number", ascending=True, num_partitions=7,
                    out="pos").toPandas()
    assert (got.sort_values("name")["pos"].to_numpy() == np.arange(1, 501)).all()
