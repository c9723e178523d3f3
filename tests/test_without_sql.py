"""Registered queries that SQL cannot express, against NumPy on the same tables."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from contractscope import queries as own
from contractscope.operators import metrics, pu

SF = "/root/testdata/sf0.001"


def table(spark):
    return own.scored(spark, SF).toPandas().sort_values("doc_id")


def test_platt_fit(spark):
    t = table(spark).dropna(subset=["label"])
    x, y = t["score"].to_numpy(float), t["label"].to_numpy(float)
    r = own.QUERIES["platt_fit"](spark, SF).first()
    p = 1 / (1 + np.exp(-(r.a * x + r.b)))
    assert abs(((y - p) * x).sum()) < 1e-6 and abs((y - p).sum()) < 1e-6
    w = p * (1 - p)
    inverse = np.linalg.inv(np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]))
    assert np.allclose([r.se_a, r.se_b], np.sqrt(np.diag(inverse)), rtol=1e-6)


def test_bootstrap_mean(spark):
    weights = own.scored(spark, SF).select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("b")).select("doc_id", "b", metrics.poisson_weight(F.col("doc_id"), F.col("b")).alias("w")).toPandas()
    both = weights.merge(table(spark)[["doc_id", "score", "lang"]], on="doc_id")
    assert abs(both["w"].mean() - 1) < 0.05 and abs(both["w"].var() - 1) < 0.1  # Poisson counts
    both["ws"] = both["w"] * both["score"]
    g = both.groupby(["lang", "b"])[["ws", "w"]].sum()
    means = (g["ws"] / g["w"]).unstack("b")
    got = {r.lang: r for r in own.QUERIES["bootstrap_mean"](spark, SF).collect()}
    for lang, m in means.iterrows():
        r = got[lang]
        assert np.allclose([r["mean"], r.lower, r.upper, r.sd], [m.mean(), np.percentile(m, 2.5), np.percentile(m, 97.5), m.std(ddof=0)])


def test_bagged_scores(spark):
    x = own._features(spark, SF)
    models = pu.bagged_weights(x, "doc_id", own.FEATURES, bags=5)
    rows = x.toPandas().set_index("doc_id")
    z = np.column_stack([rows[own.FEATURES].to_numpy(float), np.ones(len(rows))])
    label = rows["label"].to_numpy(float)
    for r in models.collect():  # all rows fit into one bag here, so every bag is the same weighted ridge regression
        p = 1 / (1 + np.exp(-z @ np.array(r.w)))
        assert np.abs(z.T @ (p - (label == 1)) + np.array(r.w)).max() < 1e-6
    want = np.mean([1 / (1 + np.exp(-z @ np.array(r.w))) for r in models.collect()], axis=0)
    got = {r.doc_id: r.score for r in pu.bagged_score(x, own.FEATURES, models).collect()}
    assert np.allclose([got[i] for i in rows.index], want)


def test_feature_importance_is_zero_without_weight(spark):
    x = own._features(spark, SF)
    got = {r.feature: r.importance for r in pu.permutation_importance(x, "doc_id", own.FEATURES, pu.linear_score(own.FEATURES, [2.0, 0.0, -1.0, 0.1])).collect()}
    assert got["odd"] == 0.0 and got["size"] > 0 and set(got) == set(own.FEATURES)


def test_supervised_scores_are_where_the_penalised_loss_is_flat(spark):
    x = own._features(spark, SF).toPandas()
    got = {r.doc_id: r.score for r in own.QUERIES["supervised_scores"](spark, SF).collect()}
    p = np.array([got[i] for i in x["doc_id"]])
    weight, target = np.where(x["label"].isna(), 0.025, 1.0), (x["label"] == 1).to_numpy(float)
    assert abs((weight * (p - target)).sum() / weight.sum()) < 1e-4  # the intercept is free
    assert np.linalg.matrix_rank(np.column_stack([np.log(p / (1 - p)), x[own.FEATURES].to_numpy(float), np.ones(len(x))]), tol=1e-6) <= 4


def test_features_join_numbers_not_texts(spark):
    """Features are made before labels are joined, so a join that shuffles takes no text along."""
    x = own._features(spark, SF)

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    (join,) = [n for n in nodes(x._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert "text" not in [join.output().apply(i).name() for i in range(join.output().size())]
    got = {r.doc_id: r for r in x.collect()}
    for r in own.t(spark, SF, "documents").collect():
        n = len(r.text)
        odd = sum(not (unicodedata.category(c)[0] == "L" or c in " \t\n\x0b\f\r") for c in r.text)
        upper = sum("A" <= c <= "Z" for c in r.text)
        assert np.allclose([got[r.doc_id][c] for c in own.FEATURES], [np.log1p(n) / 10, odd / (n + 1), upper / (n + 1)], rtol=1e-12)
