"""The rounds of hard EM and the sizes of registered jobs."""

import numpy as np
import pytest

from contractscope import queries as own
from contractscope.operators import metrics, pu

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shift, percentiles", [(0.0, [5, 10, 15, 20, 25]), (-0.35, [5, 7, 9, 11, 13]), (-0.6, [5])])
def test_em_hard_rounds(spark, monkeypatch, shift, percentiles):
    """With fixed weights only the percentile and the stop rules act."""
    monkeypatch.setattr(pu, "labelled_logit", lambda *a, **k: np.array([1.0, 0.0]))
    u = np.linspace(-2, 2, 201)
    negative = np.linspace(-1, 0.0, 100) - (0.01 if not shift else 0) + (0.13 if shift == -0.35 else 0.5 if shift else 0)
    rows = [(float(x), None) for x in u] + [(float(x), 0) for x in negative] + [(1.0, 1)] * 9
    log = pu.em_hard(spark.createDataFrame(rows, "x double, label int"), ["x"])[1].orderBy("round").collect()
    score = 1 / (1 + np.exp(-u))
    precision = float((negative < 0).mean())
    assert [r.percentile for r in log] == percentiles
    for r in log:
        cut = np.percentile(score, r.percentile)
        assert abs(r.cut - cut) < 1e-9 and abs(r.reliable - (score < cut).sum()) <= 1
        assert abs(r.precision - precision) < 1e-9 and r.recall == 1.0


def test_registered_jobs_are_whole(spark, monkeypatch):
    seen = {}
    bagged, boot, nnpu = pu.bagged_weights, metrics.bootstrap, pu.nnpu_logit
    monkeypatch.setattr(pu, "bagged_weights", lambda *a, **k: seen.update(bags=bagged(*a, **k)) or seen["bags"])
    assert own.QUERIES["bagged_scores"](spark, SF).count() > 0
    assert seen["bags"].count() == 150
    monkeypatch.setattr(metrics, "bootstrap", lambda *a, **k: seen.update(boot=(len(a), k)) or boot(*a, **k))
    own.QUERIES["bootstrap_mean"](spark, SF)
    assert seen["boot"] == (3, {"keys": ["lang"]})
    monkeypatch.setattr(pu, "nnpu_logit", lambda *a, **k: seen.update(nnpu=k) or nnpu(*a, **{**k, "steps": 1}))
    own.QUERIES["nnpu_scores"](spark, SF)
    assert "steps" not in seen["nnpu"]


@pytest.mark.parametrize("prior, gamma", [(0.3, 1.0), (0.6, 0.25), (0.9, 0.1)])
def test_newton_finds_the_least_risk(spark, prior, gamma):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2)) + 1.0
    label = np.where(x[:, 0] + rng.normal(size=600) > 1.2, 1.0, 0.0)
    label[rng.random(600) < 0.6] = np.nan
    rows = [(None if np.isnan(y) else int(y), float(a), None if i % 50 == 0 else float(b)) for i, (y, (a, b)) in enumerate(zip(label, x, strict=True))]
    w = pu.nnpu_logit(spark.createDataFrame(rows, "label int, a double, b double"), ["a", "b"], prior, gamma)
    x[::50, 1] = 0.0
    x = np.column_stack([x, np.ones(600)])
    p, n, u = label == 1, label == 0, np.isnan(label)

    def risk(w):
        s = x @ w
        plus, minus = np.logaddexp(0, -s), np.logaddexp(0, s)
        return prior * plus[p].mean() + max(0, minus[u].mean() - prior * minus[p].mean()) + gamma * (1 - prior) * minus[n].sum() / u.sum() + 5e-4 * (w[:-1] ** 2).sum()

    for e in [*np.eye(3) * 1e-4, *rng.normal(size=(300, 3)) * 1e-4, *rng.normal(size=(300, 3))]:
        assert risk(w) <= min(risk(w + e), risk(w - e)) + 1e-12


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_kernel_mean_recovers_mixtures(spark, share):
    rng = np.random.default_rng(8)
    p, n = rng.normal(size=(1500, 2)) + [3, 0], rng.normal(size=(1500, 2)) - [3, 0]
    u = np.where(rng.random(1500)[:, None] < share, rng.normal(size=(1500, 2)) + [3, 0], n)
    rows = [(i, 1 if i < 1500 else None, float(a), float(b) if i % 97 else None) for i, (a, b) in enumerate(np.concatenate([p, u]))] + [(9999, 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    runs = pu.multi_sample_prior(df, "id", ["a", "b"], runs=4, positives=200, unlabelled=400).collect()
    assert sorted(r.run for r in runs) == [1, 2, 3, 4] and all(150 < r.n_p < 250 and 320 < r.n_u < 480 for r in runs)
    assert len({r.prior for r in runs}) > 1  # samples of their own
    got = pu.prior_interval(spark.createDataFrame(runs)).first()
    assert abs(got.prior - share) < 0.08 and got.lower <= got.prior <= got.upper and got.runs == 4
    assert pu.prior_interval(spark.createDataFrame(runs[:1])).first().lower is None
    assert pu.multi_sample_prior(df.filter("label = 0"), "id", ["a", "b"], runs=2).count() == 0


def test_width_sets_means_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(40, 2)) + 2])
    d = np.concatenate([np.full(60, 1 / 60), np.full(40, -1 / 40)])
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    best = max((d @ np.exp(-square / (2 * (w * np.sqrt(np.median(square))) ** 2)) @ d, w) for w in np.logspace(-1, 1, 5))[1]
    assert np.allclose(pu.rbf_gram(x, 60), np.exp(-square / (2 * (best * np.sqrt(np.median(square))) ** 2)))


def test_sensitivity_scales_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.4) or None, float(rng.random())) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = {round(r.factor, 1): (r.assumed, r.estimate) for r in pu.prior_sensitivity(df, 0.5).collect()}
    assert sorted(got) == [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4] and abs(got[0.6][0] - 0.3) < 1e-12
    assert abs(got[1.0][1] - pu.blanchard(df).first().prior) < 1e-12


def test_em_hard_learns_from_labelled_and_reliable_rows_and_keeps_the_best_round(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(1, float(x)) for x in rng.normal(2, 1, 60)] + [(0, float(x)) for x in rng.normal(-1, 1, 60)] + [(None, float(x)) for x in rng.normal(0, 2, 400)]
    df = spark.createDataFrame(rows, "label int, x double")
    seen, fit = [], pu.labelled_logit

    def watched(train, cols, **k):
        t = train.toPandas()
        seen.append((t["label"].notna().sum(), (t["label"] == 0).sum(), fit(train, cols, **k)))
        return seen[-1][2] if len(seen) < 3 else -seen[-1][2]  # later rounds are made worse

    monkeypatch.setattr(pu, "labelled_logit", watched)
    w, log = pu.em_hard(df, ["x"])
    rounds = log.orderBy("round").collect()
    labelled = seen[0][0]
    assert 90 <= labelled < 120 and all(n == labelled + r.reliable for (n, _, _), r in zip(seen[1:], rounds, strict=True))
    assert max(r.pr_auc for r in rounds) == rounds[0].pr_auc and any(np.allclose(w, s[2]) for s in seen[:2])


def test_labelled_logit_is_where_the_gradient_is_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (x + rng.normal(size=300) > 0).astype(int)
    w = pu.labelled_logit(spark.createDataFrame([(int(b), float(a)) for a, b in zip(x, y, strict=True)] + [(None, 99.0)], "label int, x double"), ["x"])
    z = np.column_stack([x, np.ones(300)])
    assert np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - y) / 300 + np.array([1e-3, 1e-9]) * w).max() < 1e-7


def _ridge_logit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + l2 * w)
    return w


def test_bags_are_fitted_side_by_side_and_rows_are_not_copied(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [1, 0, None, None][i % 4], float(rng.normal()), None if i % 9 == 0 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double").repartition(3)
    seen = []
    summed = pu.summed
    monkeypatch.setattr(pu, "summed", lambda part, of, size: seen.append(part) or summed(part, of, size))
    got = {r.bag: np.array(r.w) for r in pu.bagged_weights(df, "id", ["a", "b"], bags=4, unlabelled=60, gamma=0.5).collect()}
    dealt = seen[0].collect()
    assert sum(r.label is not None for r in dealt) == 200 and sorted(got) == [0, 1, 2, 3]
    for bag, w in got.items():
        mine = [r for r in dealt if r.bag in (-1, bag)]
        x = np.nan_to_num(np.array([[r.a, r.b] for r in mine], float))
        label = np.array([r.label for r in mine], float)
        assert 200 < len(mine) < 300
        assert np.abs(w - _ridge_logit(x, (label == 1).astype(float), np.where(label == 0, 0.5, 1.0))).max() < 1e-8


def test_bags_score_in_tasks(spark):
    """A model of 150 bags is no expression of 150 terms a row."""
    df = spark.createDataFrame([(1, 0.5, None), (2, -1.0, 2.0)], "id long, a double, b double")
    ws = np.random.default_rng(5).normal(size=(150, 3))
    made = pu.bagged_score(df, ["a", "b"], spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(ws)], "bag int, w array<double>"))
    assert made._jdf.queryExecution().analyzed().toString().upper().count("EXP(") == 0
    got = {r.id: r.score for r in made.collect()}
    for i, x in ((1, [0.5, 0, 1]), (2, [-1, 2, 1])):
        assert abs(got[i] - np.mean(1 / (1 + np.exp(-ws @ np.array(x, float))))) < 1e-12
