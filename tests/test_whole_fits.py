"""Fits of trees see every row of their folds, as exact quantiles and counts of cells."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from contractscope.operators import boost, cells, tuning


def table(spark, n, parts=4):
    """Rows of four folds, of which few are labelled; b is missing at times, c always."""
    t = spark.range(n, numPartitions=parts).withColumns({"fold": (F.col("id") % 4).cast("int"), "a": F.floor(F.rand(1) * n) / 7.0, "b": F.when(F.rand(2) < 0.9, F.randn(3)), "c": F.lit(None).cast("double")})
    return t.withColumn("label", F.when(F.rand(4) < 0.05, (F.col("b") > 0).cast("int")))


def test_edges_are_quantiles_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(cells, "VALUES_A_TASK", 100)  # many ranges
    df = table(spark, 3000)
    rows = df.withColumn("_in", cells.roles(*[F.when(F.col("fold") != k, 3 * k + F.when(F.col("id") % 10 == 0, 1).otherwise(0)) for k in range(4)]))
    edges = cells.fit_edges(rows, ["a", "b", "c"], 16)
    x = df.toPandas()
    for k in range(4):
        mine = x[(x["fold"] != k) & (x["id"] % 10 != 0)][["a", "b", "c"]].to_numpy(float)
        want = boost.Binned(mine, 16).edges
        assert all(e.tolist() == w.tolist() for e, w in zip(edges[k], want, strict=True))


@pytest.mark.parametrize("kind", ["nnpu", "bag", "extra"])
def test_a_fit_sees_every_unlabelled_row(spark, kind):
    df = table(spark, 40_000)
    models = boost.fit_models(df, "id", ["a", "b", "c"], kind, [1.0], 0.5, rounds=1, **({} if kind == "extra" else {"hold": 0.0})).collect()
    assert {m.fold: boost.Trees.of(m.model).trees[0][0][6] for m in models} == {k: 30_000 for k in range(4)}
    held = boost.fit_models(df, "id", ["a", "b", "c"], "nnpu", [1.0], 0.5, rounds=1, fold=None).collect()
    assert abs(boost.Trees.of(held[0].model).trees[0][0][6] - 0.85 * 40_000) < 500


def test_cells_of_a_fit_give_the_trees_of_its_rows(spark):
    df = table(spark, 2000)
    x = df.orderBy("id").toPandas()
    mine = x[x["fold"] != 2]
    options = {"rounds": 12, "rate": 0.2, "hold": 0.0}
    made = boost.fit_models(df, "id", ["a", "b", "c"], "nnpu", [0.5], 0.4, **options).filter("fold = 2").first()
    want = boost.fit_one("nnpu", mine[["a", "b", "c"]].to_numpy(float), mine["label"].to_numpy(float), 0.5, 0.4, 1, **options)
    other = x[["a", "b", "c"]].to_numpy(float)
    assert np.abs(boost.Trees.of(made.model).raw(other) - want.raw(other)).max() < 1e-9


def test_a_sample_is_drawn_where_one_is_asked_for(spark):
    models = boost.fit_models(table(spark, 8000), "id", ["a", "b"], "bag", [1.0], 0.5, 300, 2, rounds=1).collect()
    assert all(200 < boost.Trees.of(m.model).trees[0][0][6] < 1100 for m in models) and len({m.model for m in models}) == 8


def labelled_by_value(spark, n):
    """Rows in four folds whose label, where known, follows a."""
    x = spark.range(n, numPartitions=4).withColumns({"fold": (F.col("id") % 4).cast("int"), "a": F.randn(5), "b": F.randn(6)})
    return x.withColumn("label", F.when(F.rand(7) < 0.2, (F.col("a") + F.col("b") > 0).cast("int")))


def test_inner_rows_are_all_rows_and_dealt_by_many_tasks(spark):
    df = table(spark, 40_000)
    rows = tuning.inner_rows(df, "id", ["a", "b"])
    assert rows.count() == 3 * 40_000
    sizes = rows.groupBy("outer", "label", "inner").count().groupBy("outer", "label").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("n")).collect()
    assert len(sizes) == 12 and all(r.d <= 1 and r.n == 3 for r in sizes)
    rank = rows.filter("outer = 1").selectExpr("_key", "label", "inner", "md5(concat_ws('|', outer, md5(concat_ws('|', '2025', _key)))) AS o").toPandas()
    for _, some in rank.groupby("label", dropna=False):  # one after another in the order of a hash
        assert (some.sort_values("o")["inner"].to_numpy() == np.arange(len(some)) % 3).all()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(outer#\d+, label#\d+, _b#\d+", plan)  # no task numbers all rows of a kind


def test_inner_fits_are_judged_on_all_rows(spark):
    df = labelled_by_value(spark, 3000)
    options = {"rounds": 8, "rate": 0.2, "hold": 0.0}
    combos = tuning.grid(leaves=[2, 6], bins=[8, 32])
    rows = tuning.inner_rows(df, "id", ["a", "b"]).cache()
    got = {(r.outer, r.inner, r.combo): r.lift for r in tuning.inner_results(rows, ["a", "b"], combos, prior=0.5, per_task=1, **options).collect()}
    assert len(got) == 4 * 3 * 4
    x = rows.filter("outer = 2").toPandas().sort_values("_key")
    for c, combo in enumerate(combos):
        mine, held = x[x["inner"] != 1], x[x["inner"] == 1]
        model = boost.fit_one("nnpu", mine[["a", "b"]].to_numpy(float), mine["label"].to_numpy(float), 1.0, 0.5, 43, **{**options, **combo})
        score = np.round(model.raw(held[["a", "b"]].to_numpy(float)), 9)
        assert abs(got[2, 1, c] - np.mean([tuning.lift_at_k(score, (held["label"] == 1).to_numpy(), k) for k in tuning.TOP_SHARES])) < 1e-9
    rows.unpersist()


def test_outer_models_see_all_rows(spark, monkeypatch):
    seen = []
    score = tuning.score_models
    monkeypatch.setattr(tuning, "score_models", lambda df, key, features, models, **o: seen.extend(models.collect()) or score(df, key, features, models, **o))
    tuning.nested_cv(table(spark, 24_000), "id", ["a", "b"], [{"leaves": 2}, {"leaves": 3, "hold": 0.5}], prior=0.5, rounds=1, hold=0.0)
    rows = {m.fold: boost.Trees.of(m.model).trees[0][0][6] for m in seen}
    assert set(rows) == {0, 1, 2, 3} and all(n == 18_000 or abs(n - 9000) < 500 for n in rows.values())


def test_lift_of_cells():
    rng = np.random.default_rng(1)
    for _ in range(20):
        score, n = rng.integers(0, 9, 30) / 8.0, rng.integers(1, 9, 30)
        p = rng.integers(0, n + 1)
        rows = np.repeat(score, n)
        positive = np.concatenate([np.arange(k) < q for k, q in zip(n, p, strict=True)])
        for k in (0.001, 0.05, 0.3, 1.0):
            assert abs(tuning.lift_of_cells(score, p, n, k) - tuning.lift_at_k(rows, positive, k)) < 1e-12
    assert np.isnan(tuning.lift_of_cells(np.ones(2), np.zeros(2), np.ones(2), 0.1))
