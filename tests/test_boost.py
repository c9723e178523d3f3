"""Tree learners against brute force and numerical derivatives, and the out-of-fold loop."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contractscope.operators import boost, panel, shap


def risk(score, label, prior, gamma):
    p, u, n = label == 1, np.isnan(label), label == 0
    plus, minus = np.logaddexp(0, -score), np.logaddexp(0, score)
    return prior * plus[p].mean() + max(0, minus[u].mean() - prior * minus[p].mean()) + gamma * (1 - prior) * minus[n].mean()


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_full_gradient_is_the_risk_s(shift):
    rng = np.random.default_rng(0)
    label = rng.choice([1.0, 0.0, np.nan], 60)
    score = rng.normal(size=60) + np.where(np.isnan(label), shift, 0)
    g, h = boost.nnpu_gradient(score, label, 0.4, 0.66, full=True)
    scale = (label == 1).sum() + np.isnan(label).sum()
    for i in range(60):
        e = np.eye(60)[i] * 1e-5
        assert abs((risk(score + e, label, 0.4, 0.66) - risk(score - e, label, 0.4, 0.66)) / 2e-5 * scale - g[i]) < 1e-5
    assert (h >= 1e-6).all()


@pytest.mark.parametrize("shift, active", [(0.0, 1), (-6.0, 0)])
def test_published_gradient(shift, active):
    rng = np.random.default_rng(0)
    label = rng.choice([1.0, 0.0, np.nan], 60)
    score = rng.normal(size=60) + np.where(np.isnan(label), shift, 0)
    g, h = boost.nnpu_gradient(score, label, 0.4, 0.66, unlabelled=50)
    q, n_p, n_u = 1 / (1 + np.exp(-score)), (label == 1).sum(), np.isnan(label).sum()
    weight = np.where(label == 1, 0.4 / n_p, np.where(label == 0, 0.66 * 0.6 / 50, active / n_u)) * (n_p + n_u)
    assert np.allclose(g, weight * (q - (label == 1))) and np.allclose(h, np.maximum(weight * q * (1 - q), 1e-6))


def test_first_split_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(50, 3))
        x[rng.random((50, 3)) < 0.1] = np.nan
        g, h = rng.normal(size=50), rng.uniform(0.5, 1, 50)
        tree = boost.grow(x, g, h, leaves=2, least=5, bins=200)
        best = 0.0
        for f in range(3):
            for cut in [-np.inf, *x[:, f]]:
                left = np.isnan(x[:, f]) | (x[:, f] <= cut)
                if 5 <= left.sum() <= 45:
                    best = max(best, g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum())
        f, cut = tree[0][:2]
        left = np.isnan(x[:, f]) | (x[:, f] <= cut)
        won = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
        assert won >= 0.9 * best  # edges are quantiles, so a split may lie between two of them
        values = boost.tree_values(tree, x)
        assert np.allclose(values[left], -g[left].sum() / h[left].sum()) and np.allclose(values[~left], -g[~left].sum() / h[~left].sum())


def frame(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 900)
    x = rng.normal(size=(900, 2)) + y[:, None] * 1.5
    seen = rng.random(900) < 0.5
    rows = [(i, int(y[i]) if seen[i] else None, float(x[i, 0]), None if i % 11 == 0 else float(x[i, 1]), str(y[i]) if seen[i] else "U") for i in range(900)]
    return panel.stratified_folds(spark.createDataFrame(rows, "id long, label int, a double, b double, stratum string"), ["stratum"], "id")


@pytest.mark.parametrize("kind, bags, options", [("nnpu", 1, {"rounds": 60, "rate": 0.1, "patience": 20}), ("bag", 3, {"rounds": 20}), ("extra", 2, {"rounds": 20})])
def test_out_of_fold(spark, kind, bags, options):
    df = frame(spark)
    scores, summary = boost.gamma_grid(df, "id", ["a", "b"], [0.0, 1.0], kind, bags=bags, prior=0.5, unlabelled=300, **options)
    rows = scores.collect()
    assert sorted((r.id, r.gamma) for r in rows) == [(i, g) for i in range(900) for g in (0.0, 1.0)]
    fold_of = {r.id: (r.fold, r.label) for r in df.collect()}
    assert all(fold_of[r.id] == (r.fold, r.label) for r in rows)
    one = next(r for r in rows if r.id == 5 and r.gamma == 1.0)  # the same fit by hand, from the other folds' rows alone
    models = [boost.Trees.of(m.model) for m in boost.fit_models(df.filter(f"fold <> {one.fold} OR id = 5"), "id", ["a", "b"], kind, [1.0], 0.5, 10**6, bags, **options).filter(f"fold = {one.fold}").collect()]
    assert len(models) == bags
    got = {r.gamma: r for r in summary.collect()}
    assert set(got) == {0.0, 1.0} and all(r.roc_auc_mean > 0.8 for r in got.values())


def test_refit_and_guardrail(spark):
    model = boost.fit_models(frame(spark), "id", ["a", "b"], prior=0.5, fold=None, rounds=5).collect()
    assert [(m.fold, m.bag) for m in model] == [(-1, 0)] and 0.5 <= model[0].top_gain <= 1.0


def test_small_shares_keep_their_size(spark):
    n = 200_000
    for share in (1.0, 1e-3, 1e-4):
        got = spark.range(n).filter(boost.drawn_share(share, F.col("id"))).count()
        assert abs(got - share * n) <= 5 * (share * n) ** 0.5 * (share < 1)
    wide = [spark.range(1).select(boost.drawn_share(300 / rows, F.lit(1))).count() for rows in (10**9, 10**12, 10**15)]  # never a threshold of 0
    assert wide == [1, 1, 1] and "0L" not in str(boost.drawn_share(300 / 10**12, F.lit(1)))


def conditional(tree, row, known):
    """A tree's value with only the known features, by its training rows."""

    def go(i):
        f, edge, left, right, missing, value, rows = tree[i]
        if f < 0:
            return value
        if f in known:
            return go(left if (missing > 0 if np.isnan(row[f]) else row[f] <= edge) else right)
        return (tree[left][6] * go(left) + tree[right][6] * go(right)) / rows

    return go(0)


def test_contributions_equal_all_subsets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x[rng.random(x.shape) < 0.1] = np.nan
    label = np.where(rng.random(300) < 0.5, (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2]) > 0).astype(float), np.nan)
    model = boost.fit_one("nnpu", x, label, 1.0, 0.3, 1, rounds=20, rate=0.1, leaves=9)
    made, base = shap.contributions(model, x)
    assert np.abs(made.sum(axis=1) + base - model.raw(x)).max() < 1e-9
    for row in range(6):
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * sum(conditional(t, x[row], {*s, i}) - conditional(t, x[row], set(s)) for t in model.trees) for k in range(4) for s in itertools.combinations(others, k))
            assert abs(want - made[row, i]) < 1e-9


def test_explanations_of_rows(spark):
    df = frame(spark)
    names = ["a", "b"]
    models = boost.fit_models(df, "id", names, "nnpu", [1.0], 0.5, rounds=15, rate=0.1)
    told = shap.explain(df, "id", names, models, "fold").cache()
    scores = {r.id: r.score for r in boost.score_models(df, "id", names, models).collect()}
    rows = told.collect()
    assert sorted(r.id for r in rows) == list(range(900))
    for r in rows:
        assert abs(r.base + sum(r.contributions) - r.raw) < 1e-9 and abs(1 / (1 + np.exp(-r.raw)) - scores[r.id]) < 1e-9
    mean = {r.feature: (r.importance, r["rank"]) for r in shap.importance(told, names).collect()}
    by = np.abs(np.array([r.contributions for r in rows])).mean(axis=0)
    assert np.allclose([mean["a"][0], mean["b"][0]], by) and {mean["a"][1], mean["b"][1]} == {1, 2}
    best = shap.top_features(told.filter("id = 7"), "id", names, 1).collect()
    seven = next(r for r in rows if r.id == 7).contributions
    k = int(np.abs(seven).argmax())
    assert [(b.feature, b["rank"], b.contribution) for b in best] == [(names[k], 1, seven[k])]
    assert shap.explain(df.limit(0), "id", names, models, "fold").count() == 0
    told.unpersist()


def spread(n):
    """Rows in few cells, with missing values, and labels of all kinds."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(n, 3)))
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-np.nan_to_num(x[:, 0] + x[:, 1])))).astype(float)
    y[rng.random(n) < 0.3] = np.nan
    return x, y


@pytest.mark.parametrize("kind", ["nnpu", "bag"])
def test_rounds_do_not_pass_over_rows(kind, monkeypatch):
    """Rows of one label that share all bins go through the rounds as one, however many there are."""
    seen = []
    grow_binned = boost.grow_binned
    monkeypatch.setattr(boost, "grow_binned", lambda rows, g, h, **o: seen.append(len(g)) or grow_binned(rows, g, h, **o))
    made = []
    for times in (1, 6):
        x, y = spread(3000)
        made.append(boost.fit_one(kind, np.tile(x, (times, 1)), np.tile(y, times), 0.5, 0.5, 3, rounds=8, hold=0.0, least=20 * times, l2=0.5 * times))
    assert len(set(seen)) == 1 and seen[0] < 1500
    x, _ = spread(500)
    assert np.abs(made[0].raw(x) - made[1].raw(x)).max() < (1e-9 if kind == "bag" else 0.1)


def test_cells_give_the_trees_of_their_rows(monkeypatch):
    x, y = spread(4000)
    cells = boost.fit_one("nnpu", x, y, 0.5, 0.5, 3, rounds=30, rate=0.1)
    monkeypatch.setattr(boost.Binned, "gather", lambda self, kind: np.arange(len(kind)))
    rows = boost.fit_one("nnpu", x, y, 0.5, 0.5, 3, rounds=30, rate=0.1)
    assert len(cells.trees) == len(rows.trees) and np.abs(cells.raw(x) - rows.raw(x)).max() < 1e-9
    assert [[t[6] for t in tree] for tree in cells.trees] == [[t[6] for t in tree] for tree in rows.trees]


def test_cells_rank_as_their_rows():
    rng = np.random.default_rng(6)
    score, positive = rng.integers(0, 9, 300) / 8.0, rng.random(300) < 0.4
    values, cell = np.unique(score, return_inverse=True)
    score_of = np.concatenate([values, values[:1]])  # two cells may share a score
    p, n = np.bincount(cell, positive, 10), np.bincount(cell, minlength=10)
    p[9], n[9] = 1, 2
    whole = boost.auc(np.append(score, [values[0]] * 2), np.append(positive, [True, False]))
    assert boost.auc_of_cells(score_of, p, n) == whole


def test_a_table_of_cells_scores_as_the_trees_do():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 3))
    x[rng.random((3000, 3)) < 0.1] = np.nan
    x[:5, 0] = -np.inf
    y = np.where(rng.random(3000) < 0.5, (x[:, 0] > 0).astype(float), np.nan)
    model = boost.fit_one("nnpu", x, y, 0.5, 0.5, 3, rounds=40, rate=0.1)
    read = boost.reader(model.text())
    other = np.vstack([rng.normal(size=(500, 3)) * 3, x[:50], [[t[1]] * 3 for t in model.trees[0] if t[0] >= 0]])
    assert isinstance(read, boost.Grid) and read.raw(other).tobytes() == model.raw(other).tobytes()
    assert boost.reader(boost.Trees(0.25).text()).raw(other).tolist() == [0.25] * len(other)


def test_models_that_a_table_does_not_fit(monkeypatch):
    x, y = spread(500)
    model = boost.fit_one("nnpu", x, y, 0.5, 0.5, 3, rounds=5)
    right = boost.Trees(0.0, [[(0, 0.0, 1, 2, 0, 0.0, 2), (-1, 0.0, -1, -1, 0, 1.0, 1), (-1, 0.0, -1, -1, 0, 2.0, 1)]])
    assert isinstance(boost.reader(right.text()), boost.Trees) and boost.reader(right.text()).raw(np.array([[np.nan], [-1.0]])).tolist() == [2.0, 1.0]
    monkeypatch.setattr(boost, "MOST_CELLS", 10)
    assert boost.Grid.of(model) is None


def test_a_table_explains_as_the_rows_do(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 4))
    x[rng.random((800, 4)) < 0.1] = np.nan
    y = np.where(rng.random(800) < 0.5, (x[:, 0] * np.nan_to_num(x[:, 2]) > 0).astype(float), np.nan)
    model = boost.fit_one("nnpu", x, y, 0.5, 0.5, 3, rounds=12, rate=0.1, bins=16)
    table, _ = shap.explainer(model.text())
    (made, base), (want, start) = table.contributions(x), shap.contributions(model, x)
    assert isinstance(table, shap.Table) and np.abs(made - want).max() < 1e-12 and abs(base - start) < 1e-12
