"""Shapley values of tree sums, path-dependent: what a tree does without a feature is the mean over its training rows.

A leaf adds value * product over the features on its path of (does the row go this way, or else the share of training
rows that do). Its Shapley value for one feature is an integral from 0 to 1 of the product over the other features of
z (1 - t) + o t, where o is 0 or 1 and z the share; the integrand is a polynomial of a degree below the number of
features, so a Gauss-Legendre rule with half as many points is exact. Rows are explained side by side, or, where the
model's edges make few cells, looked up in a table of all cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractscope.operators.boost import Grid, Trees, codes_of

#: Most features of a model that is explained by a table; a leaf has a box for each subset of those on its path.
MOST_FEATURES = 6


@lru_cache(maxsize=64)
def _rule(features: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on 0 to 1 that are exact for polynomials of a degree below `features`."""
    at, weight = np.polynomial.legendre.leggauss(max(1, (features + 1) // 2))
    return (at + 1) / 2, weight / 2


def leaves(tree: list[tuple]) -> list[tuple[float, list[tuple[int, float, float, bool, float]]]]:
    """(value, path) of each leaf; a step is (feature, edge, goes left: 1 or 0, missing goes left, share of rows)."""
    out, open_ = [], [(0, [])]
    while open_:
        node, path = open_.pop()
        f, edge, left, right, missing, value, rows = tree[node]
        if f < 0:
            out.append((value, path))
            continue
        for child, goes in ((left, 1.0), (right, 0.0)):
            open_.append((child, [*path, (f, edge, goes, missing > 0, tree[child][6] / max(1, rows))]))
    return out


def tree_contributions(tree: list[tuple], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features, base): contributions of one tree; with the base they add up to its values."""
    out, base = np.zeros(x.shape), 0.0
    for value, path in leaves(tree):
        share: dict[int, float] = {}
        goes: dict[int, np.ndarray] = {}
        for f, edge, left, missing, z in path:
            v = x[:, f]
            here = np.where(np.isnan(v), missing, v <= edge) == (left > 0)
            share[f] = share.get(f, 1.0) * z
            goes[f] = goes[f] & here if f in goes else here
        names = list(share)
        base += value * float(np.prod([share[f] for f in names]))
        if not names or value == 0.0:
            continue
        t, w = _rule(len(names))
        parts = [share[f] * (1 - t) + goes[f][:, None] * t for f in names]  # rows x points
        for i, f in enumerate(names):
            others = np.ones_like(parts[0])
            for j, part in enumerate(parts):
                if j != i:
                    others = others * part
            out[:, f] += value * (goes[f] - share[f]) * (others @ w)
    return out, base


def contributions(model: Trees, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features, base) of a whole sum of trees; base and contributions add up to its raw scores."""
    out, base = np.zeros(x.shape), model.start
    for tree in model.trees:
        some, b = tree_contributions(tree, x)
        out, base = out + some, base + b
    return out, base


class Table:
    """Contributions of a sum of trees for every cell of its edges.

    A leaf's contribution is a sum over subsets of the features on its path, each a number times whether the row goes the
    leaf's way for all features of the subset; that is a box of cells, to which the number is added.
    """

    def __init__(self, model: Trees, grid: Grid):
        self.grid, self.base = grid, model.start
        sizes = [len(e) + 2 for e in grid.edges]
        sums: dict[tuple[int, ...], np.ndarray] = {}
        for tree in model.trees:
            for value, path in leaves(tree):
                self.base += self._leaf(value, path, sizes, sums)
        self.table = np.zeros((len(sizes), *sizes))
        for some in sums.values():
            self.table += some

    def _leaf(self, value: float, path: list[tuple], sizes: list[int], sums: dict[tuple[int, ...], np.ndarray]) -> float:
        share: dict[int, float] = {}
        box: dict[int, tuple[int, int]] = {}
        for f, edge, left, _, z in path:
            cut = int(np.searchsorted(self.grid.edges[f], edge)) + 2
            low, high = box.get(f, (0, sizes[f]))
            share[f], box[f] = share.get(f, 1.0) * z, (low, min(high, cut)) if left > 0 else (max(low, cut), high)
        names = sorted(share)
        t, w = _rule(len(names))

        def add(inside: tuple[int, ...], i: int, number: float) -> None:
            if inside not in sums:
                sums[inside] = np.zeros((len(sizes), *[n if f in inside else 1 for f, n in enumerate(sizes)]))
            sums[inside][(i, *[slice(*box[f]) if f in inside else slice(None) for f in range(len(sizes))])] += number

        for i in names:
            others = [f for f in names if f != i]
            for k in range(len(others) + 1):
                for inside in itertools.combinations(others, k):
                    number = value * float(np.prod([t if f in inside else share[f] * (1 - t) for f in others], axis=0) @ w if others else w.sum())
                    add(tuple(sorted((*inside, i))), i, number)
                    add(inside, i, -share[i] * number)
        return value * float(np.prod([share[f] for f in names]))

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        out = np.zeros(x.shape)
        used = len(self.grid.edges)
        if used:
            out[:, :used] = self.table[(slice(None), *codes_of(x[:, :used], self.grid.edges))].T
        return out, self.base


class Rows:
    """Contributions row by row, for models with too many cells."""

    def __init__(self, model: Trees):
        self.model = model

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        return contributions(self.model, x)


@lru_cache(maxsize=16)
def explainer(text: str) -> tuple[Table | Rows, Grid | Trees]:
    """What explains and what scores rows by a model, made once in a worker for all its tasks."""
    model = Trees.of(text)
    grid = Grid.of(model)
    return (Table(model, grid), grid) if grid and len(grid.edges) <= MOST_FEATURES else (Rows(model), grid or model)


def explain(df: DataFrame, key: str, features: Sequence[str], models: DataFrame, fold: str | None = None) -> DataFrame:
    """(key, gamma, base, raw, contributions array<double> in the order of features) for every row, the mean over bags.

    Narrow: models are few and short texts and go to every task, rows stay where they are. With `fold`, a row is explained
    by the models of its own fold (which have not seen it), else by those that were refitted on all rows, fold -1. A null
    feature is a missing one; repeated keys have a row each; an empty table gives an empty result.
    """
    found: dict[int, dict[float, list[str]]] = {}
    for r in models.collect():
        found.setdefault(r["fold"], {}).setdefault(r["gamma"], []).append(r["model"])
    shared = df.sparkSession.sparkContext.broadcast(found)
    names, kind = list(features), df.schema[key].dataType.simpleString()
    part = F.col(fold).cast("int") if fold else F.lit(-1)
    rows = df.select(F.col(key).alias("_key"), part.alias("_fold"), *[F.col(c).cast("double").alias(c) for c in names]).filter("_fold IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, some in pdf.groupby("_fold"):
                x = some[names].to_numpy(float)
                for gamma, texts in shared.value.get(k, {}).items():
                    made_of = [explainer(t) for t in texts]
                    each = [m.contributions(x) for m, _ in made_of]
                    made, base = np.mean([c for c, _ in each], axis=0), float(np.mean([b for _, b in each]))
                    yield pd.DataFrame({key: some["_key"], "gamma": gamma, "base": base, "raw": np.mean([t.raw(x) for _, t in made_of], axis=0), "contributions": list(made)})

    return rows.mapInPandas(run, f"`{key}` {kind}, gamma double, base double, raw double, contributions array<double>")


def importance(explained: DataFrame, features: Sequence[str]) -> DataFrame:
    """(gamma, feature, importance, mean_contribution, rank): mean absolute and plain contributions over all rows."""
    place = F.posexplode("contributions").alias("_i", "c")
    named = F.array(*[F.lit(f) for f in features])
    each = explained.select("gamma", place).groupBy("gamma", "_i").agg(F.avg(F.abs("c")).alias("importance"), F.avg("c").alias("mean_contribution"))
    t = each.select("gamma", named[F.col("_i")].alias("feature"), "importance", "mean_contribution")
    return t.withColumn("rank", F.expr("row_number() over (partition by gamma order by importance desc, feature)"))


def top_features(explained: DataFrame, key: str, features: Sequence[str], k: int = 10) -> DataFrame:
    """(key, gamma, rank, feature, contribution): each row's k largest contributions by size."""
    pairs = F.arrays_zip(F.transform("contributions", lambda c: -F.abs(c)).alias("size"), F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("contributions").alias("contribution"))
    best = F.slice(F.array_sort(pairs), 1, k)
    return explained.select(key, "gamma", F.posexplode(best).alias("_i", "t")).select(key, "gamma", (F.col("_i") + 1).alias("rank"), "t.feature", "t.contribution")
