"""Grouped Platt scaling and score intervals against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from contractscope.operators import intervals as iv


def newton(x, y, w):
    a, b = 0.0, np.log((w * y).sum() / (w * (1 - y)).sum())
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (y - p) * x).sum(), (w * (y - p)).sum()])
        c = w * p * (1 - p)
        h = np.array([[(c * x * x).sum(), (c * x).sum()], [(c * x).sum(), c.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a + d[0], b + d[1]
    return a, b, *np.sqrt(np.diag(np.linalg.inv(h)))


def rows(n=400):
    rng = np.random.default_rng(9)
    x = rng.random(n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(4 * x - 2)))).astype(int)
    return [(i, i % 4, float(x[i]), int(y[i]) if i % 3 else None, float(i % 5)) for i in range(n)]


def test_platt_groups_equal_numpy(spark):
    data = [*rows(), (900, 7, 0.5, 1, 1.0), (901, 8, 0.1, 0, 1.0), (902, 8, 0.9, 1, 1.0), (903, 9, None, 1, 1.0), (904, 6, 0.5, 1, 1.0), (905, 6, 0.5, 0, 1.0)]
    df = spark.createDataFrame(data, "id int, fold int, score double, label int, w double")
    for weight in (None, "w"):
        got = {r.fold: r for r in iv.platt_groups(df, ["fold"], weight=weight).collect()}
        assert set(got) == {0, 1, 2, 3, 6, 7, 8}
        for f in range(4):
            some = [(x, y, w if weight else 1.0) for _, k, x, y, w in data if k == f and y is not None]
            x, y, w = map(np.array, zip(*some, strict=True))
            r = got[f]
            assert np.allclose([r.a, r.b, r.se_a, r.se_b], newton(x, y, w), rtol=1e-7) and r.n_p == (w * y).sum()
        assert all(got[f].a is None and got[f].se_b is None for f in (6, 7, 8))  # one label, told apart, one score


def test_platt_table(spark):
    df = spark.createDataFrame(rows(), "id int, fold int, score double, label int, w double")
    got = {r.fold: r for r in iv.platt_table(df).collect()}
    assert set(got) == {"0", "1", "2", "3", "mean", "global"}
    a = [got[str(f)].a for f in range(4)]
    assert abs(got["mean"].a - np.mean(a)) < 1e-9 and abs(got["mean"].se_a - np.std(a, ddof=1)) < 1e-9
    x, y = map(np.array, zip(*[(x, y) for _, _, x, y, _ in rows() if y is not None], strict=True))
    assert np.allclose([got["global"].a, got["global"].b, got["global"].se_a, got["global"].se_b], newton(x, y, np.ones(len(x))), rtol=1e-7)


def test_intervals_equal_numpy(spark):
    rng = np.random.default_rng(1)
    made = [(i, rng.random(int(n)).tolist()) for i, n in enumerate([1, 2, 7, 200, 200])]
    df = spark.createDataFrame([*made, (5, []), (6, None), (7, made[3][1])], "id int, p array<double>")
    got = {r.id: r for r in iv.intervals(df, "id", F.col("p"), 0.02, 0.3).collect()}
    shift = np.log(0.02 / 0.98) - np.log(0.3 / 0.7)
    for i, p in made:
        want = [np.mean(p), np.percentile(p, 2.5), np.percentile(p, 97.5)]
        assert np.allclose([got[i].score_mean, got[i].score_lower, got[i].score_upper], want)
        assert np.allclose([got[i].pc_mean, got[i].pc_lower, got[i].pc_upper], 1 / (1 + np.exp(-(np.log(np.array(want) / (1 - np.array(want))) + shift))))
        assert abs(got[i].lift_vs_prior - got[i].pc_mean / 0.02) < 1e-12
    assert got[5].score_mean is None and got[6].score_upper is None and got[5].percentile_rank is None
    assert got[3].percentile_rank == got[7].percentile_rank


def test_replicates_of_the_scaling(spark):
    df = spark.createDataFrame([*rows(), (999, 2, None, None, 0.0)], "id int, fold int, score double, label int, w double")
    got = {r.id: r.probs for r in iv.calibrated_replicates(df, "id", replicates=12).collect()}
    assert len(got) == 401 and got[999] is None and all(len(p) == 12 for i, p in got.items() if i != 999)
    weights = {(r.id, r.b): r.w for r in df.select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("b")).select("id", "b", iv.poisson_weight(F.col("id"), F.col("b"), 2028).alias("w")).collect()}
    for fold, b in ((0, 1), (3, 12)):
        some = [(x, y, weights[i, b]) for i, f, x, y, _ in rows() if f != fold and y is not None]
        a, c = newton(*map(np.array, zip(*some, strict=True)))[:2]
        for i, f, x, _, _ in rows():
            if f == fold:
                assert abs(got[i][b - 1] - 1 / (1 + np.exp(-(a * x + c)))) < 1e-8


def test_replicates_of_the_model(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(i, int(y[i]) if i % 2 else None, float(rng.normal() + 2 * y[i])) for i in range(300)], "id int, label int, a double")
    got = iv.refitted_replicates(df, "id", ["a"], df.filter("label IS NULL"), replicates=4, prior=0.5, rounds=10, rate=0.2).collect()
    assert len(got) == 150 and all(len(r.raw) == 4 and len(set(r.raw)) > 1 for r in got)
    mean = {r.id: np.mean(r.raw) for r in got}
    assert np.mean([mean[i] for i in mean if y[i]]) > np.mean([mean[i] for i in mean if not y[i]]) + 0.1
