"""Tree learners for positive-unlabelled data: boosting under the nnPU risk, bagged boosting, extra trees, and their
out-of-fold loop over folds and gammas.

A fit sees all rows of its folds, gathered in cells of bins, so many small fits (folds, gammas, bags) run side by side, one
per group of applyInPandas; models are short texts. Scoring is narrow: each row is scored in its own task by the models of
its fold, whose number is gammas times folds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractscope.operators.cells import FIT, STOP, Cells, cells_of, codes_of, gathered, roles, values_of
from contractscope.operators.metrics import across_folds, evaluate

MODEL = "gamma double, fold int, bag int, model string, n_rounds int, top_gain double"
#: Most cells of a table of scores (4 MB); a model with more is scored tree by tree.
MOST_CELLS = 1 << 19


@dataclass
class Trees:
    """A sum of trees; a node is (feature, edge, left, right, missing goes left, value, rows), a leaf has feature -1.

    The last is the number of rows that came by in training.
    """

    start: float = 0.0
    trees: list[list[tuple]] = field(default_factory=list)
    gain: dict[int, float] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree_values(tree, x)
        return out

    def text(self) -> str:
        return json.dumps({"start": self.start, "trees": self.trees, "gain": self.gain})

    @classmethod
    def of(cls, text: str) -> Trees:
        return cls(**json.loads(text))

    def top_gain(self) -> float:
        """Share of the whole gain that the most used feature has; a guardrail against models of one feature."""
        total = sum(self.gain.values())
        return max(self.gain.values()) / total if total else 0.0


def tree_values(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    feature, edge, left, right, missing, value, _ = (np.array(c) for c in zip(*tree, strict=True))
    while (feature[at] >= 0).any():
        rows = np.flatnonzero(feature[at] >= 0)
        node = at[rows]
        v = x[rows, feature[node]]
        goes = np.where(np.isnan(v), missing[node] > 0, v <= edge[node])
        at[rows] = np.where(goes, left[node], right[node])
    return value[at]


def edges_of(values: Sequence[tuple]) -> list[np.ndarray]:
    """The sorted edges of each feature that trees split at."""
    return [np.unique(v) for v in values]


class Binned:
    """Rows as bins of their features, made once for all trees of a fit; edges are taken from quantiles.

    Missing values have a bin of their own, below all others. After gather(), a row stands for `times` alike ones.
    """

    def __init__(self, x: np.ndarray, bins: int = 64):
        self.edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if np.isfinite(c).any() else np.zeros(0) for c in x.T]
        self.coded, self.times = codes_of(x, self.edges), None

    @classmethod
    def of(cls, edges: list[np.ndarray], coded: np.ndarray, times: np.ndarray) -> Binned:
        """Of cells of rows that are binned already."""
        made = cls.__new__(cls)
        made.edges, made.coded, made.times = edges, coded, times
        return made

    def gather(self, kind: np.ndarray) -> np.ndarray:
        """Rows of one kind in the same bins become one, if that halves their number; returns the rows that stay.

        A fit sees nothing of a row but its bins and its kind, and of cells there are no more than bins allow.
        """
        at, _, times = cells_of(self.coded, kind)
        if 2 * len(at) > len(kind):
            return np.arange(len(kind))
        self.coded, self.times = self.coded[:, at], times
        return at


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int = 64, **grown) -> list[tuple]:
    """A tree grown leaf by leaf, each time where a split lowers the second-order loss most."""
    return grow_binned(Binned(x, bins), g, h, **grown)[0]


def grow_binned(x: Binned, g: np.ndarray, h: np.ndarray, leaves: int = 15, least: int = 20, l2: float = 0.0, rng: np.random.Generator | None = None, gain: dict[int, float] | None = None) -> tuple[list[tuple], np.ndarray]:
    """(tree, its value for each row), grown leaf by leaf; g and h are sums over the rows that a row stands for.

    With rng, a split's feature is drawn from a random few and its edge at random, as extra trees do.
    """
    edges, coded, times = x.edges, x.coded, x.times
    d, n = len(edges), len(g)
    size_of = (lambda rows: len(rows)) if times is None else (lambda rows: int(times[rows].sum()))
    tree: list[tuple] = [(-1, 0.0, -1, -1, 0, 0.0, size_of(np.arange(n)))]
    rows_of = {0: np.arange(n)}

    def best(rows: np.ndarray) -> tuple[float, int, int]:
        found = (0.0, -1, -1)
        n_rows = size_of(rows)
        if n_rows < 2 * least:
            return found
        g_rows, h_rows, t_rows = g[rows], h[rows], None if times is None else times[rows]
        g_all, h_all = g_rows.sum(), h_rows.sum()
        for f in range(d) if rng is None else rng.permutation(d)[: max(1, int(np.sqrt(d)))]:
            size = len(edges[f]) + 2
            code = coded[f][rows]
            gs, hs, cs = (np.cumsum(np.bincount(code, w, size))[:-1] for w in (g_rows, h_rows, t_rows))
            ok = (cs >= least) & (n_rows - cs >= least)
            if rng is not None and ok.any():
                chosen = rng.choice(np.flatnonzero(ok))
                ok = np.arange(len(ok)) == chosen
            with np.errstate(divide="ignore", invalid="ignore"):
                won = gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2)
            won = np.where(ok & np.isfinite(won), won, 0.0)
            k = int(won.argmax())
            if won[k] > found[0] + 1e-12:
                found = (float(won[k]), int(f), k)
        return found

    open_ = {0: best(rows_of[0])}
    while len(rows_of) < leaves:
        node = max(open_, key=lambda i: open_[i][0])
        won, f, k = open_.pop(node)
        if f < 0:
            break
        rows = rows_of.pop(node)
        goes = coded[f][rows] <= k
        left, right = len(tree), len(tree) + 1
        edge = float("-inf") if k == 0 else float(edges[f][k - 1])
        tree[node] = (f, edge, left, right, 1, 0.0, size_of(rows))
        tree += [(-1, 0.0, -1, -1, 0, 0.0, 0)] * 2
        for i, some in ((left, rows[goes]), (right, rows[~goes])):
            rows_of[i], open_[i] = some, best(some)
        if gain is not None:
            gain[f] = gain.get(f, 0.0) + won
    values = np.zeros(n)
    for i, rows in rows_of.items():
        tree[i] = (-1, 0.0, -1, -1, 0, float(-g[rows].sum() / (h[rows].sum() + l2 + 1e-12)), size_of(rows))
        values[rows] = tree[i][5]
    return tree, values


class Grid:
    """The raw scores of a sum of trees for every cell of its edges; a row's score is looked up by its bins.

    A tree's leaves are boxes of cells, to which their values are added in the order of the trees, so scores are the same
    to the last bit as tree by tree.
    """

    def __init__(self, trees: Trees, edges: list[np.ndarray]):
        self.edges = edges
        self.table = np.full([len(e) + 2 for e in edges], trees.start)
        for tree in trees.trees:
            for value, box in self.boxes(tree):
                self.table[box] += value

    def boxes(self, tree: list[tuple]) -> Iterator[tuple[float, tuple[slice, ...]]]:
        open_ = [(0, [(0, len(e) + 2) for e in self.edges])]
        while open_:
            node, box = open_.pop()
            f, edge, left, right, _, value, _ = tree[node]
            if f < 0:
                yield value, tuple(slice(*b) for b in box)
                continue
            cut = int(np.searchsorted(self.edges[f], edge)) + 2
            low, high = box[f]
            for child, b in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
                if b[0] < b[1]:
                    open_.append((child, [*box[:f], b, *box[f + 1 :]]))

    @classmethod
    def of(cls, trees: Trees) -> Grid | None:
        """None where there are too many cells, or where a missing value goes to the right."""
        splits = [t for tree in trees.trees for t in tree if t[0] >= 0]
        if any(t[4] <= 0 for t in splits):
            return None
        values: list[list[float]] = [[] for _ in range(1 + max((t[0] for t in splits), default=-1))]
        for t in splits:
            values[t[0]].append(t[1])
        edges = edges_of(values)
        return cls(trees, edges) if np.prod([len(e) + 2.0 for e in edges]) <= MOST_CELLS else None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.table[tuple(codes_of(x[:, : len(self.edges)], self.edges))] if self.edges else np.full(len(x), float(self.table))


@lru_cache(maxsize=128)
def reader(text: str) -> Grid | Trees:
    """What scores rows by a model, made once in a worker for all its tasks."""
    trees = Trees.of(text)
    return Grid.of(trees) or trees


def nnpu_gradient(score: np.ndarray, label: np.ndarray, prior: float, gamma: float, unlabelled: int | None = None, full: bool = False, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives that boosting follows for the nnPU/PNPU risk; label is NaN for unlabelled rows.

    As published, a positive row has only its own loss, prior / n_P * (q - 1); an unlabelled one q / n_U while
    E_U[l-] - prior * E_P[l-] is above 0, else nothing; a negative one gamma * (1 - prior) / n_U * q, with the number
    `unlabelled` of unlabelled rows before any were held out. All are times the positive and unlabelled rows. With
    `full`, they are the derivatives of prior * E_P[l+] + max(0, E_U[l-] - prior * E_P[l-]) + gamma * (1 - prior) * E_N[l-].
    With `times`, each entry stands for so many rows; its derivatives are those of one of them.
    """
    p, u, n = label == 1, np.isnan(label), label == 0
    q = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    minus = np.logaddexp(0, score)
    count = (lambda k: k.sum()) if times is None else (lambda k: times[k].sum())
    loss = (lambda k: minus[k].sum()) if times is None else (lambda k: minus[k] @ times[k])
    n_p, n_u = max(1, count(p)), max(1, count(u))
    active = loss(u) / n_u - prior * loss(p) / n_p > 0
    of_n = gamma * (1 - prior) / (max(1, count(n)) if full else max(1, unlabelled or n_u))
    weight = np.where(p, prior / n_p, np.where(u, active / n_u, of_n))
    g, h = weight * (q - p), weight * q * (1 - q)
    if full and active:
        g, h = g - p * prior / n_p * q, np.where(p, 0.0, h)
    scale = n_p + n_u
    return g * scale, np.maximum(h * scale, 1e-6)


def logistic_gradient(score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    return weight * (q - target), np.maximum(weight * q * (1 - q), 1e-6)


def auc(score: np.ndarray, target: np.ndarray) -> float:
    rank = pd.Series(score).rank().to_numpy()
    n1 = target.sum()
    n0 = len(target) - n1
    return float((rank[target].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


def auc_of_cells(score: np.ndarray, positives: np.ndarray, rows: np.ndarray) -> float:
    """auc of cells of rows that share a score, from their numbers of positives and of all rows."""
    _, of = np.unique(score, return_inverse=True)
    n, p = np.bincount(of, rows), np.bincount(of, positives)
    rank = np.cumsum(n) - (n - 1) / 2
    n1 = p.sum()
    n0 = n.sum() - n1
    return float(((p * rank).sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


def boost(x: np.ndarray, label: np.ndarray, gradient: Callable[..., tuple], rounds: int = 1000, rate: float = 0.02, patience: int = 200, hold: float = 0.15, seed: int = 2025, bins: int = 64, **grown) -> Trees:
    """Boost trees under a risk that is given by its derivatives in (score, label, times).

    A share `hold` of the rows only tells when to stop: after `patience` rounds without a better ROC of positives
    against the rest, the best number of rounds is kept. With hold 0 all rounds are made. Bins are made once; where rows of
    a label share all bins, they go through the rounds as one (times is None where none do).
    """
    rng = np.random.default_rng(seed)
    kept = rng.permutation(len(x)) >= int(hold * len(x))
    rows, told, out, positive = Binned(x[kept], bins), label[kept], x[~kept], label[~kept] == 1
    told = told[rows.gather(np.where(np.isnan(told), 2, told))]
    first, cell, size = cells_of(codes_of(out, rows.edges), np.zeros(len(out)))  # tree values depend on bins alone
    return boost_cells(rows, told, out[first], np.bincount(cell, positive, len(first)), size, gradient, rounds, rate, patience, **grown)


def boost_cells(rows: Binned, told: np.ndarray, out: np.ndarray, positives: np.ndarray, size: np.ndarray, gradient: Callable[..., tuple], rounds: int = 1000, rate: float = 0.02, patience: int = 200, **grown) -> Trees:
    """boost on binned rows with their labels; held-out cells, if any, are given by a row, their positives and all their rows."""
    made, score, held = Trees(), np.zeros(len(told)), np.zeros(len(out))
    best, at = -np.inf, rounds
    for r in range(rounds):
        g, h = gradient(score, told, rows.times)
        if rows.times is not None:
            g, h = g * rows.times, h * rows.times
        tree, values = grow_binned(rows, g, h, gain=made.gain, **grown)
        tree = [(*t[:5], t[5] * rate, t[6]) for t in tree]
        made.trees.append(tree)
        score += values * rate
        if len(held):
            held += tree_values(tree, out)
            now = auc_of_cells(held, positives, size)
            if now > best:
                best, at = now, r + 1
            elif r + 1 - at >= patience or np.isnan(now):
                break
    made.trees = made.trees[:at] if len(held) and np.isfinite(best) else made.trees
    return made


#: The share of a fit's rows that tells when to stop, and other options of each kind of model.
HOLD = {"nnpu": 0.15, "bag": 0.0, "extra": 0.0}
OPTIONS = {"nnpu": {"l2": 0.5}, "bag": {"rounds": 100, "rate": 0.05}, "extra": {"leaves": 64, "least": 5}}


def gradient_of(kind: str, gamma: float, prior: float, unlabelled: int) -> Callable[..., tuple]:
    """The derivatives that a kind of boosting follows, in (score, label, times)."""
    if kind == "nnpu":
        return lambda s, y, times: nnpu_gradient(s, y, prior, gamma, unlabelled, times=times)
    return lambda s, y, _: logistic_gradient(s, (y == 1).astype(float), np.where(y == 0, gamma, 1.0))


def extra_trees(rows: Binned, label: np.ndarray, gamma: float, seed: int, rounds: int = 50, **options) -> Trees:
    """Extra trees on positives; each leaf is the weighted share of positives."""
    rng = np.random.default_rng(seed)
    target, weight = (label == 1).astype(float), np.where(label == 0, gamma, 1.0) * (1 if rows.times is None else rows.times)
    made = Trees()
    for _ in range(rounds):
        tree, _ = grow_binned(rows, -weight * target, weight, rng=rng, gain=made.gain, **options)
        made.trees.append([(*t[:5], t[5] / rounds, t[6]) for t in tree])
    return made


def fit_one(kind: str, x: np.ndarray, label: np.ndarray, gamma: float, prior: float, seed: int, **options) -> Trees:
    """A model of one kind: nnpu (boosted risk), bag (boosted weighted logistic loss), extra (extra trees on positives)."""
    options = {**OPTIONS[kind], **options}
    if kind == "extra":
        return extra_trees(Binned(x, options.pop("bins", 64)), label, gamma, seed, **options)
    return boost(x, label, gradient_of(kind, gamma, prior, int(np.isnan(label).sum())), seed=seed, **{"hold": HOLD[kind], **options})


def fit_cells(kind: str, cells: Cells, gamma: float, prior: float, seed: int, **options) -> Trees:
    """fit_one on rows that are gathered in cells; bins and held-out rows are those of the cells."""
    options = {k: v for k, v in {**OPTIONS[kind], **options}.items() if k not in ("bins", "hold")}
    grown, out = cells.role == FIT, cells.role == STOP
    rows, told = Binned.of(cells.edges, cells.coded[:, grown], cells.times[grown]), cells.label[grown]
    if kind == "extra":
        return extra_trees(rows, told, gamma, seed, **options)
    first, at, _ = cells_of(cells.coded[:, out], np.zeros(out.sum()))
    positives, size = (np.bincount(at, w[out], len(first)) for w in (cells.times * (cells.label == 1), cells.times))
    n_u = int(cells.times[np.isnan(cells.label) & (grown | out)].sum())
    return boost_cells(rows, told, values_of(cells.coded[:, out][:, first], cells.edges), positives, size, gradient_of(kind, gamma, prior, n_u), **options)


def drawn_share(share: float, *keys: Column) -> Column:
    """Whether a row belongs to a sample of this share, by 62 bits of a hash: shares of a few rows in 10^15 keep their size."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 62)) < F.lit(min(1 << 62, max(1, round(share * (1 << 62)))))


def stops(hold: float, *keys: Column) -> Column:
    """Whether a row only tells when to stop: a share `hold` of all, by a hash."""
    return drawn_share(hold, *keys, F.lit("hold")) if hold > 0 else F.lit(False)


def fit_models(df: DataFrame, key: str, features: Sequence[str], kind: str = "nnpu", gammas: Sequence[float] = (1.0,), prior: float = 0.02, unlabelled: int | None = None, bags: int = 1, fold: str | None = "fold", seed: int = 2025, **options) -> DataFrame:
    """(gamma, fold, bag, model, n_rounds, top_gain): one model for each gamma, fold that is left out, and bag.

    A fit gets every row outside of its fold, gathered in cells of its bins; with `unlabelled`, a bag has only about so many
    unlabelled ones, drawn by a hash of key and bag. Without `fold`, models are refitted on all rows, as fold -1. Rows
    without a fold take no part.
    """
    names = list(features)
    part = F.col(fold).cast("int") if fold else F.lit(-2)
    rows = df.select(F.col(key).alias("_key"), F.col("label").cast("double").alias("label"), part.alias("fold"), *[F.col(c).cast("double").alias(c) for c in names]).filter("fold IS NOT NULL")
    outs = sorted(r[0] for r in rows.select("fold").distinct().collect()) if fold else [-1]
    fits, drawn = [(out, bag) for out in outs for bag in range(bags)], {bag: F.lit(True) for bag in range(bags)}
    if unlabelled is not None:
        n_u = rows.filter("label IS NULL").count()
        share = min(1.0, unlabelled * (len(outs) / max(1, len(outs) - 1) if fold else 1) / n_u) if n_u else 1.0
        drawn = {bag: F.col("label").isNotNull() | drawn_share(share, F.col("_key"), F.lit(bag), F.lit(seed)) for bag in range(bags)}
    hold = options.get("hold", HOLD[kind])
    role = lambda out, bag: F.when(stops(hold, F.col("_key"), F.lit(seed + out + 1000 * bag)), STOP).otherwise(FIT)
    rows = rows.withColumn("_in", roles(*[F.when((F.col("fold") != out) & drawn[bag], 3 * i + role(out, bag)) for i, (out, bag) in enumerate(fits)]))
    cells, edges = gathered(rows, names, options.get("bins", 64))
    none = [np.zeros(0)] * len(names)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        gamma, i = float(pdf["gamma"].iloc[0]), int(pdf["fit"].iloc[0])
        out, bag = fits[i]
        made = fit_cells(kind, Cells.of(pdf, edges.get(i, none)), gamma, prior, seed + out + 1000 * bag, **options)
        return pd.DataFrame({"gamma": [gamma], "fold": [out], "bag": [bag], "model": [made.text()], "n_rounds": [len(made.trees)], "top_gain": [made.top_gain()]})

    dealt = cells.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    return dealt.repartition(2 * len(fits) * len(gammas), "gamma", "fit").groupBy("gamma", "fit").applyInPandas(fit, MODEL)  # cells are few bytes, and much work


def score_models(df: DataFrame, key: str, features: Sequence[str], models: DataFrame, fold: str | None = "fold", kind: str = "nnpu") -> DataFrame:
    """(key, label, gamma, fold, score): each row scored by the models of its own fold, the mean over bags.

    Models are gammas x folds x bags short texts, whatever the number of rows; they go to every task.
    """
    found: dict[int, dict[float, list[str]]] = {}
    for r in models.collect():
        found.setdefault(r["fold"], {}).setdefault(r["gamma"], []).append(r["model"])
    shared = df.sparkSession.sparkContext.broadcast(found)
    names, key_type = list(features), df.schema[key].dataType.simpleString()
    part = F.col(fold).cast("int") if fold else F.lit(-1)
    rows = df.select(F.col(key), F.col("label").cast("double").alias("label"), part.alias("fold"), *[F.col(c).cast("double").alias(c) for c in names]).filter("fold IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, some in pdf.groupby("fold"):
                x = some[names].to_numpy(float)
                for gamma, texts in shared.value.get(k, {}).items():
                    raw = [reader(t).raw(x) for t in texts]
                    each = raw if kind == "extra" else [1 / (1 + np.exp(-np.clip(r, -40, 40))) for r in raw]
                    yield pd.DataFrame({key: some[key], "label": some["label"], "gamma": gamma, "fold": k, "score": np.mean(each, axis=0)})

    return rows.mapInPandas(run, f"{key} {key_type}, label double, gamma double, fold int, score double").withColumn("label", F.expr("cast(nullif(label, double('nan')) as int)"))


def gamma_grid(df: DataFrame, key: str, features: Sequence[str], gammas: Sequence[float], kind: str = "nnpu", shares: Sequence[float] = (0.01, 0.02, 0.05), **options) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, summary): every row scored for every gamma by a model of the other folds, and for each gamma
    the mean and sample deviation over folds of lift at each share, pr_auc and roc_auc."""
    models = fit_models(df, key, features, kind, gammas, **options)
    scores = score_models(df, key, features, models, kind=kind)
    if df.sparkSession.sparkContext.getCheckpointDir():
        scores = scores.checkpoint()  # in the folder the cluster names: the metrics read the scores several times
    per_fold = evaluate(scores, ["gamma", "fold"], shares)
    return scores, across_folds(per_fold, ["gamma"], [*[f"lift_{round(s * 100)}" for s in shares], "pr_auc", "roc_auc"])
