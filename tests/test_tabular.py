"""Stored models and rows, and the edges of small table operators."""

import pytest
from pyspark.sql import functions as F

from contractscope.operators import tabular


def test_models_and_rows_are_kept(spark, tmp_path):
    models = spark.createDataFrame([(0, "{}"), (1, "{1}")], "fold int, model string")
    tabular.save_models(models, str(tmp_path), "v1")
    assert sorted(map(tuple, tabular.load_models(spark, str(tmp_path), "v1").collect())) == [(0, "{}"), (1, "{1}")]
    with pytest.raises(Exception, match="(?i)exist"):
        tabular.save_models(models, str(tmp_path), "v1")
    made = []
    make = lambda: made.append(1) or models.select("fold")
    first = sorted(r.fold for r in tabular.kept_rows(spark, str(tmp_path / "keys"), make).collect())
    assert first == sorted(r.fold for r in tabular.kept_rows(spark, str(tmp_path / "keys"), make).collect()) == [0, 1] and made == [1]
    assert not list(tmp_path.glob("keys-*"))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (1, "b", 1.0), (1, "a", 40_000.0), (1, "b", 150_000.0), (2, None, 1e6), (3, "z", None)], "k int, v string, x double")
    assert {r.k: r.s for r in tabular.joined_set(df, ["k"], "v", "s").collect()} == {1: "a, b", 2: "", 3: "z"}
    assert {r.k: r.f for r in tabular.any_of(df, ["k"], f=F.col("x") > 1e5).collect()} == {1: True, 2: True, 3: False}
    assert [r[0] for r in df.select(tabular.amount_band(F.col("x"))).collect()] == [None, "<40k", "40k-150k", "150k-1M", ">=1M", None]
    assert sorted(r.x for r in tabular.within(df, closed={"x": (1.0, None)}, opened={"x": (None, 1e6)}).collect()) == [1.0, 40_000.0, 150_000.0]
    assert tabular.telling_cases(spark.createDataFrame([(1, 0.5, 1), (2, 0.7, None)], "id int, score double, label int"), "id").count() == 0
    assert {(r.label, r["value"]): (r.n, r.share) for r in tabular.crosstab(df, "k", "v").collect()}[1, None] == (1, 0.25)
    assert [tuple(r) for r in tabular.group_ratio(df, ["k"], ["x", "k"], "k", "r").filter("k = 3").collect()] == [(3, 1.0)]
    assert [r.v for r in tabular.codes_or_minus_one(df, ["v"], {"v": {"a": 0, "b": 1}}).collect()] == [-1, 1, 0, 1, -1, -1]
