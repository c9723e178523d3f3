"""Gradients of the net by differences, the kernel machine against its dual, and sums over partitions."""

import numpy as np
import pytest

from contractscope.operators import neural


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    y[rng.random(n) < 0.4] = np.nan
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, None if np.isnan(b) else int(b), float(a[0]), None if i % 50 == 0 else float(a[1])) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, label int, a double, b double")


def test_sums_do_not_depend_on_partitions(spark):
    df = frame(spark, *data()).select("label", "a", "b")
    of = lambda y, x: np.concatenate([[len(y), np.isnan(y).sum()], x.sum(axis=0)])
    got = [neural.summed(df.repartition(n), of, 4) for n in (1, 3, 17)]
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2]) and got[0][0] == 400
    assert (neural.summed(df.limit(0), of, 4) == 0).all()


@pytest.mark.parametrize("prior, dropped", [(0.3, False), (0.3, True), (0.99, False)])
def test_gradient_is_the_risk_s(prior, dropped):
    x, y = data(60)
    net = neural.Net.drawn([2, 5, 4, 1], 1)
    net.flat[:] += np.random.default_rng(2).normal(size=len(net.flat)) * 0.1
    keep = [np.array([0, 1.5, 1.5, 1.5, 0.0]), np.array([1.25, 0, 1.25, 1.25])] if dropped else None
    p, n, u = y == 1, y == 0, np.isnan(y)

    def risk(flat):
        s = neural.Net(net.sizes, flat).forward(x, keep)[0]
        plus, minus = np.logaddexp(0, -s), np.logaddexp(0, s)
        inner = minus[u].mean() - prior * minus[p].mean()
        return prior * plus[p].mean() + abs(inner) + 0.7 * (1 - prior) * minus[n].sum() / 50  # below 0 the middle term is pushed back

    g = neural.risk_gradient(neural.risk_parts(net, y, x, keep), prior, 0.7, 50)
    for i in range(len(g)):
        e = np.zeros(len(g))
        e[i] = 1e-6
        assert abs((risk(net.flat + e) - risk(net.flat - e)) / 2e-6 - g[i]) < 1e-5


def test_net_learns_what_no_line_can(spark):
    x, y = data(600, 3)
    df = frame(spark, x, y)
    for batches in (1, 3):
        model = neural.fit_net(df, "id", ["a", "b"], prior=0.5, hidden=(16, 8), steps=80, batches=batches, rate=0.05, dropout=0.0)
        got = {r.id: r.score for r in neural.net_scores(df, ["id"], ["a", "b"], model).collect()}
        truth = x[:, 0] * x[:, 1] > 0
        assert len(got) == 600 and np.mean([(got[i] > np.median(list(got.values()))) == truth[i] for i in range(600) if i % 50]) > 0.85
    again = neural.fit_net(df.repartition(7), "id", ["a", "b"], prior=0.5, hidden=(16, 8), steps=80, batches=3, rate=0.05, dropout=0.0)
    assert np.allclose(again["flat"], model["flat"], atol=1e-6)
    assert neural.net_scores(df.limit(0), ["id"], ["a", "b"], model).count() == 0


def test_kernel_machine_is_close_to_its_dual(spark):
    x, y = data(160, 5)
    df = frame(spark, x, y)
    model = neural.fit_kernel(df, ["a", "b"], unlabelled=0.2, size=200, band=0.02)
    mean, deviation = np.array(model["mean"]), np.array(model["deviation"])
    known = x.copy()
    known[::50, 1] = mean[1]
    z = neural.mapped((known - mean) / deviation, np.array(model["frequencies"]), np.array(model["phases"]))
    target, weight = np.where(y == 1, 1.0, -1.0), np.where(np.isnan(y), 0.2, 1.0)
    gram = z[:, :-1] @ z[:, :-1].T + 1e3  # the constant is all but free
    q = gram * target[:, None] * target
    alpha = np.zeros(len(y))
    for t in range(30_000):  # pairs that violate the conditions most, and at times single coordinates
        rise = 1 - q @ alpha
        if t % 20 == 0:
            i = int(np.argmax(np.abs(np.clip(alpha + rise / np.diag(q), 0, weight) - alpha)))
            alpha[i] = np.clip(alpha[i] + rise[i] / q[i, i], 0, weight[i])
            continue
        up, down = ((target > 0) & (alpha < weight)) | ((target < 0) & (alpha > 0)), ((target < 0) & (alpha < weight)) | ((target > 0) & (alpha > 0))
        i, k = int(np.argmax(np.where(up, target * rise, -np.inf))), int(np.argmin(np.where(down, target * rise, np.inf)))
        room = min(weight[i] - alpha[i] if target[i] > 0 else alpha[i], alpha[k] if target[k] > 0 else weight[k] - alpha[k])
        move = min(room, (target[i] * rise[i] - target[k] * rise[k]) / max(1e-12, gram[i, i] + gram[k, k] - 2 * gram[i, k]))
        alpha[i], alpha[k] = alpha[i] + target[i] * move, alpha[k] - target[k] * move
    dual = alpha.sum() - alpha @ q @ alpha / 2
    w = np.array(model["w"])
    primal = w[:-1] @ w[:-1] / 2 + 5e-4 * w[-1] ** 2 + (weight * np.maximum(0, 1 - target * (z @ w))).sum()
    assert dual - 1e-3 * abs(dual) <= primal <= 1.01 * dual + 0.05
    got = {r.id: r.score for r in neural.kernel_scores(df, ["id"], ["a", "b"], model).collect()}
    assert np.allclose([got[i] for i in range(160)], z @ w)


def test_random_features_come_near_the_kernel():
    x = np.random.default_rng(0).normal(size=(40, 3))
    z = neural.mapped(x, *neural.random_map(3, 0.3, 20_000, 1))[:, :-1]
    assert np.abs(z @ z.T - np.exp(-0.3 * ((x[:, None] - x) ** 2).sum(axis=2))).max() < 0.05


def test_a_row_goes_back_for_its_own_kind_alone(monkeypatch):
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(90, 3)), np.repeat([1.0, 0.0, np.nan], [10, 20, 60])
    net, seen, backward = neural.Net.drawn([3, 5, 1], 1), [], neural.Net.backward
    monkeypatch.setattr(neural.Net, "backward", lambda self, inputs, out, keep=None: seen.append(len(out)) or backward(self, inputs, out, keep))
    made = neural.risk_parts(net, label, x)
    assert sum(seen) == 10 + 90
    s, inputs = net.forward(x)
    q = 1 / (1 + np.exp(-s))
    whole = [backward(net, inputs, np.where(k, v, 0)) for k, v in ((label == 1, q - 1), (label == 1, q), (label == 0, q), (np.isnan(label), q))]
    assert made[:3].tolist() == [10, 20, 60] and np.allclose(made[6:], np.concatenate(whole))
    assert np.allclose(made[3:6], [np.logaddexp(0, s[k]).sum() for k in (label == 1, label == 0, np.isnan(label))])


def test_second_derivatives_are_one_product_with_itself():
    rng = np.random.default_rng(10)
    z, w, target, weight = rng.normal(size=(500, 40)), rng.normal(size=40) / 4, rng.choice([-1.0, 1.0], 500), rng.random(500)
    h = neural.hinge_parts(w, target, weight, z, 0.5)[41:].reshape(40, 40)
    short = 1 - target * (z @ w)
    bend = ((short > 0) & (short < 0.5)) / 0.5
    assert (h == h.T).all() and np.allclose(h, (z * (weight * bend)[:, None]).T @ z)
