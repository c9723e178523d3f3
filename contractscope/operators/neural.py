"""Learners whose steps are sums over all rows: a multilayer net under the nnPU risk, and a kernel machine on random features.

A step is one job. Each task adds up its rows' vectors and gives one row; these are added up in a few groups before any
reaches the driver, so what is collected depends on the model's size alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = 8


def summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of a vector of this size; of(first column, the others as a matrix with nulls as 0) adds up a batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                total += of(first, np.column_stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in batch.columns[1:]]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [sum((np.frombuffer(v) for v in pdf["v"]), np.zeros(size)).tobytes()]})

    parts = rows.mapInArrow(each, "v binary").withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    return sum((np.frombuffer(bytes(r["v"])) for r in parts.groupBy("_g").applyInPandas(add, "v binary").collect()), np.zeros(size))


def scaling(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 where there is none) of the known values."""
    m = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)]).first()
    d = len(features)
    return np.array([m[i] or 0.0 for i in range(d)]), np.array([m[d + i] or 1.0 for i in range(d)])


def scaled(features: Sequence[str], mean: np.ndarray, deviation: np.ndarray) -> list[Column]:
    """z-scores, nulls as the mean."""
    return [F.coalesce((F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)).alias(c) for c, m, s in zip(features, mean, deviation, strict=True)]


# --- a multilayer net ---


class Net:
    """Fully connected layers with ReLU between them and one linear output; weights as one flat vector."""

    def __init__(self, sizes: Sequence[int], flat: np.ndarray):
        self.sizes, self.flat = list(sizes), flat
        self.layers, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            self.layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b

    @classmethod
    def drawn(cls, sizes: Sequence[int], seed: int) -> Net:
        """He initialisation, biases 0."""
        rng = np.random.default_rng(seed)
        parts = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b))]
        return cls(sizes, np.concatenate(parts))

    def forward(self, x: np.ndarray, keep: Sequence[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Outputs, and each layer's input; keep scales the units of each hidden layer."""
        inputs = [x]
        for i, (w, b) in enumerate(self.layers[:-1]):
            h = np.maximum(inputs[-1] @ w + b, 0)
            inputs.append(h * keep[i] if keep is not None else h)
        w, b = self.layers[-1]
        return (inputs[-1] @ w + b)[:, 0], inputs

    def backward(self, inputs: list[np.ndarray], out: np.ndarray, keep: Sequence[np.ndarray] | None = None) -> np.ndarray:
        """Gradient of a sum whose derivatives by the outputs are `out`, as a flat vector."""
        parts: list[np.ndarray] = []
        g = out[:, None]
        for i in range(len(self.layers) - 1, -1, -1):
            parts = [(inputs[i].T @ g).ravel(), g.sum(axis=0), *parts]
            if i:
                g = (g @ self.layers[i][0].T) * (inputs[i] > 0)
                g = g * keep[i - 1] if keep is not None else g
        return np.concatenate(parts)


def risk_parts(net: Net, label: np.ndarray, x: np.ndarray, keep: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """Numbers of positive, negative and unlabelled rows, their sums of l-, and the gradients of the sums of l+ over positives
    and of l- over positives, negatives and unlabelled rows."""
    numbers, losses, grads = [], [], []
    for kind, both in ((label == 1, True), (label == 0, False), (np.isnan(label), False)):  # each row goes back for its own kind alone
        s, inputs = net.forward(x[kind], keep)
        q = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        numbers.append(kind.sum())
        losses.append(np.logaddexp(0, s).sum())
        grads += [net.backward(inputs, q - 1, keep)] if both else []
        grads.append(net.backward(inputs, q, keep))
    return np.concatenate([numbers, losses, *grads])


def risk_gradient(parts: np.ndarray, prior: float, gamma: float, unlabelled: float) -> np.ndarray:
    """Gradient of prior * E_P[l+] + max(0, E_U[l-] - prior * E_P[l-]) + gamma * (1 - prior) / unlabelled * sum_N[l-].

    While the middle term is below 0 it is pushed back, as the non-negative estimator does, by its reversed gradient.
    """
    (n_p, _, n_u), (loss_p, _, loss_u) = np.maximum(parts[:3], 1), parts[3:6]
    plus, minus_p, minus_n, minus_u = parts[6:].reshape(4, -1)
    inner = minus_u / n_u - prior * minus_p / n_p
    outer = prior * plus / n_p + gamma * (1 - prior) / max(1.0, unlabelled) * minus_n
    return outer + inner if loss_u / n_u - prior * loss_p / n_p >= 0 else outer - inner


def fit_net(df: DataFrame, key: str, features: Sequence[str], prior: float = 0.02, gamma: float = 1.0, hidden: Sequence[int] = (128, 64), steps: int = 60, batches: int = 1, rate: float = 0.01, decay: float = 1e-4, dropout: float = 0.3, seed: int = 42) -> dict:
    """A fitted net as plain values, to be given to net_scores.

    Each step takes all labelled rows and one of `batches` shares of the unlabelled ones, by a hash of the key; Adam with a
    cosine rate and weight decay. Dropped units are drawn for each step and layer, the same for all rows, so a fit does not
    depend on how rows are partitioned. There is no batch normalisation; features are scaled instead.
    """
    mean, deviation = scaling(df, features)
    rows = df.select(F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(batches)).alias("_b"), *scaled(features, mean, deviation)).persist()
    try:
        n_u = rows.filter("label IS NULL").count()
        net = Net.drawn([len(features), *hidden, 1], seed)
        m = v = np.zeros(len(net.flat))
        rng = np.random.default_rng(seed)
        for t in range(steps):
            keep = [(rng.random(h) >= dropout) / (1 - dropout) for h in hidden]
            part = rows.filter(F.col("label").isNotNull() | (F.col("_b") == t % batches)).drop("_b") if batches > 1 else rows.drop("_b")
            now = Net(net.sizes, net.flat)
            g = risk_gradient(summed(part, lambda y, x, now=now, keep=keep: risk_parts(now, y, x, keep), 6 + 4 * len(net.flat)), prior, gamma, n_u / batches)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = m / (1 - 0.9 ** (t + 1)) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
            pace = rate * (1 + np.cos(np.pi * t / steps)) / 2
            net = Net(net.sizes, net.flat * (1 - pace * decay) - pace * step)
    finally:
        rows.unpersist()
    return {"sizes": net.sizes, "flat": net.flat.tolist(), "mean": mean.tolist(), "deviation": deviation.tolist()}


def _scored(df: DataFrame, keep: Sequence[str], features: Sequence[str], columns: list[Column], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    slim = df.select(*keep, *columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keep) :]]) if batch.num_rows else np.zeros((0, len(features)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score(x), pa.float64())], names=[*keep, "score"])

    return slim.mapInArrow(run, f"{fields}, score double")


def net_scores(df: DataFrame, keep: Sequence[str], features: Sequence[str], model: dict) -> DataFrame:
    """The columns `keep` and a score from 0 to 1. Narrow."""
    net = Net(model["sizes"], np.array(model["flat"]))
    return _scored(df, keep, features, scaled(features, np.array(model["mean"]), np.array(model["deviation"])), lambda x: 1 / (1 + np.exp(-np.clip(net.forward(x)[0], -500, 500))))


# --- a kernel machine ---


def random_map(d: int, width: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of features whose inner products come near exp(-width * |x - y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * width), (d, size)), rng.uniform(0, 2 * np.pi, size)


def mapped(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random features, and a constant 1 at the end."""
    z = np.sqrt(2 / len(phases)) * np.cos(x @ frequencies + phases)
    return np.column_stack([z, np.ones(len(x))])


def hinge_parts(w: np.ndarray, target: np.ndarray, weight: np.ndarray, z: np.ndarray, band: float) -> np.ndarray:
    """Sums over rows of the weighted hinge loss, rounded over a band below 1, of its gradient and its second derivatives."""
    margin = target * (z @ w)
    short = np.clip(1 - margin, 0, None)
    loss = np.where(short >= band, short - band / 2, short**2 / (2 * band))
    slope, bend = np.minimum(short / band, 1), ((short > 0) & (short < band)) / band
    inside = np.flatnonzero(bend)
    bent = z[inside] * np.sqrt((weight * bend)[inside])[:, None]  # a product with itself takes half the work
    return np.concatenate([[(weight * loss).sum()], z.T @ (-weight * target * slope), (bent.T @ bent).ravel()])


def fit_kernel(df: DataFrame, features: Sequence[str], unlabelled: float = 0.025, with_negatives: bool = True, cost: float = 1.0, width: float | None = None, size: int = 256, band: float = 0.1, steps: int = 30, seed: int = 42) -> dict:
    """A biased kernel machine as plain values: positives against the rest, weighted 1 for labelled and a little for
    unlabelled rows (and for negatives, without with_negatives).

    Minimises |w|^2 / 2 + cost * sum of weight * hinge in the space of `size` random features of an RBF kernel, whose width
    is 1 / number of features unless given. Damped Newton steps, each from sums over all rows; the band over which
    the hinge is rounded begins wide and narrows to `band`, which keeps the steps few.
    """
    mean, deviation = scaling(df, features)
    frequencies, phases = random_map(len(features), width or 1 / len(features), size, seed)
    rows = df.select(F.col("label").cast("double").alias("label"), *scaled(features, mean, deviation)).persist()
    ridge = np.eye(size + 1)
    ridge[-1, -1] = 1e-3  # the constant is all but free
    n = 1 + (size + 1) + (size + 1) ** 2

    def at(w: np.ndarray, wide: float) -> tuple[float, np.ndarray, np.ndarray]:
        def of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            weight = np.where((y == 1) | ((y == 0) & with_negatives), 1.0, unlabelled)
            return hinge_parts(w, np.where(y == 1, 1.0, -1.0), weight, mapped(x, frequencies, phases), wide)

        s = summed(rows, of, n)
        return cost * s[0] + w @ ridge @ w / 2, cost * s[1 : size + 2] + ridge @ w, cost * s[size + 2 :].reshape(size + 1, size + 1) + ridge

    try:
        w, wide = np.zeros(size + 1), max(2.0, band)
        while True:
            value, g, h = at(w, wide)
            damp = 1e-3
            for _ in range(steps):
                step = np.linalg.solve(h + damp * np.eye(size + 1), g)
                found = at(w - step, wide)
                told = (value - found[0]) / max(1e-300, g @ step - step @ h @ step / 2)  # of the fall that the curvature promised
                if told > 0:
                    done = value - found[0] <= 1e-5 * max(1.0, abs(value))
                    w, (value, g, h) = w - step, found
                    if done:
                        break
                damp = damp / 4 if told > 0.75 else damp if told > 0.25 else damp * 8
            if wide <= band:
                break
            wide = max(band, wide / 3)
    finally:
        rows.unpersist()
    return {"w": w.tolist(), "frequencies": frequencies.tolist(), "phases": phases.tolist(), "mean": mean.tolist(), "deviation": deviation.tolist(), "value": value}


def kernel_scores(df: DataFrame, keep: Sequence[str], features: Sequence[str], model: dict) -> DataFrame:
    """The columns `keep` and the signed distance as score. Narrow."""
    w, frequencies, phases = (np.array(model[k]) for k in ("w", "frequencies", "phases"))
    return _scored(df, keep, features, scaled(features, np.array(model["mean"]), np.array(model["deviation"])), lambda x: mapped(x, frequencies, phases) @ w)
