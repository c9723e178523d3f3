"""Positive-unlabelled learning: weights, class priors, logistic nnPU/PNPU risk, bagging and EM, on Spark.

Full-batch models gather their gradients by one aggregation per step, so only vectors of the features' length reach
the driver. Small independent fits (bags, folds, gammas) run side by side, one per group of applyInPandas, on samples
whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from contractscope.operators.boost import drawn_share
from contractscope.operators.metrics import average_precision
from contractscope.operators.neural import summed


# --- encoding and weights ---


def assemble(df: DataFrame, numbers: Sequence[str], classes: Sequence[str] = (), out: str = "features") -> DataFrame:
    """A feature vector: numbers (nulls as NaN kept) and one-hot classes, none dropped, nulls and new ones together."""
    made = df
    for c in classes:
        indexed = StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(made).transform(made)
        made = OneHotEncoder(inputCols=[f"_{c}"], outputCols=[f"_h_{c}"], dropLast=False, handleInvalid="keep").fit(indexed).transform(indexed).drop(f"_{c}")
    made = VectorAssembler(inputCols=[*numbers, *[f"_h_{c}" for c in classes]], outputCol=out, handleInvalid="keep").transform(made)
    return made.drop(*[f"_h_{c}" for c in classes])


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes by alphabetical order of the levels from 0 on; null has none. The level table is small."""
    levels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return levels.withColumn("code", F.expr("cast(row_number() over (order by value) - 1 as int)"))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(c, F.lit(m[c])) for c in columns})


def standardise(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """z-scores with mean and population deviation of the rows of fit_on; a constant column becomes 0."""
    rows = df.filter(fit_on) if fit_on is not None else df
    m = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(m[f"m_{c}"])) / F.lit(m[f"s_{c}"] or 1.0) for c in columns})


def biased_weight(label: Column, unlabelled: float = 0.025, with_negatives: bool = True) -> Column:
    """Weight 1 for positives and for negatives (or as unlabelled without them), a small one for unlabelled."""
    return F.when(label == 1, 1.0).when((label == 0) & F.lit(with_negatives), 1.0).otherwise(unlabelled)


def em_soft_rows(df: DataFrame, score: str = "score", share: float = 0.05) -> DataFrame:
    """Each unlabelled row twice, as positive with weight s*w and as negative with (1-s)*w; labelled rows once.

    w = share * labelled / unlabelled; positives are weighted up to balance the negatives.
    """
    c = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"), F.count_if(F.col("label").isNull()).alias("u")).first()
    w = share * (c["p"] + c["n"]) / c["u"] if c["u"] else 0.0
    balance = c["n"] / c["p"] if c["p"] else 1.0
    both = F.array(F.struct(F.lit(1).alias("target"), (F.col(score) * w).alias("weight")), F.struct(F.lit(0).alias("target"), ((1 - F.col(score)) * w).alias("weight")))
    one = F.array(F.struct(F.col("label").cast("int").alias("target"), F.when(F.col("label") == 1, F.lit(balance)).otherwise(1.0).alias("weight")))
    return df.select("*", F.inline(F.when(F.col("label").isNull(), both).otherwise(one)))


def supervised(df: DataFrame, kind: str = "logit", weight: str | None = None, **params):
    """A fitted Spark ML classifier on (features, target): logit with elastic net, gbt or forest."""
    made = {"logit": LogisticRegression, "gbt": GBTClassifier, "forest": RandomForestClassifier}[kind](featuresCol="features", labelCol="target", **params)
    if weight:
        made.setWeightCol(weight)
    return made.fit(df)


def positive_probability(scored: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("score", vector_to_array("probability")[1])


# --- class priors ---


def elkan_noto(df: DataFrame, score: str = "score") -> DataFrame:
    """(c, prior): mean score of positives, and mean score of unlabelled over it."""
    t = df.agg(F.avg(F.when(F.col("label") == 1, F.col(score))).alias("c"), F.avg(F.when(F.col("label").isNull(), F.col(score))).alias("u"))
    return t.select("c", F.least(F.lit(1.0), F.try_divide("u", "c")).alias("prior"))


def blanchard(df: DataFrame, score: str = "score", steps: int = 200) -> DataFrame:
    """(prior): least ratio of the shares of unlabelled and of positive rows at or above thresholds.

    Thresholds lie evenly from the 5th to the 95th percentile of all scores; both shares for all thresholds come from
    one histogram over threshold intervals.
    """
    edges = df.agg(F.percentile(score, F.array(F.lit(0.05), F.lit(0.95))).alias("e")).select(F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
    t = df.join(F.broadcast(edges)).withColumn("_i", F.floor(F.try_divide(F.col(score) - F.col("low"), F.col("high") - F.col("low")) * (steps - 1) + 1e-9))
    t = t.withColumn("_i", F.coalesce(F.least(F.greatest("_i", F.lit(-1)), F.lit(steps - 1)), F.lit(0)))
    hist = t.groupBy("_i").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label").isNull()).alias("u"))
    up = "over (order by _i desc rows between unbounded preceding and current row)"
    sums = hist.select("_i", F.expr(f"sum(p) {up}").alias("tp"), F.expr(f"sum(u) {up}").alias("tu"), F.expr("sum(p) over ()").alias("p_all"), F.expr("sum(u) over ()").alias("u_all"))
    ratio = F.try_divide(F.col("tu") / F.col("u_all"), F.col("tp") / F.col("p_all"))
    return sums.filter("_i >= 0 AND tp > 0").agg(F.least(F.lit(1.0), F.min(ratio)).alias("prior"))


def rbf_gram(x: np.ndarray, mixture: int, widths: Sequence[float] = tuple(np.logspace(-1, 1, 5))) -> np.ndarray:
    """Kernel matrix of the width, among multiples of the median distance, that sets the two groups' means furthest apart.

    The first `mixture` rows are of the mixture, the others of the component.
    """
    square = np.maximum((x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * x @ x.T, 0)
    median = np.sqrt(np.median(square)) or 1.0
    d = np.concatenate([np.full(mixture, 1 / mixture), np.full(len(x) - mixture, -1 / (len(x) - mixture))])
    grams = [np.exp(-square / (2 * (w * median) ** 2)) for w in widths]
    return grams[int(np.argmax([d @ g @ d for g in grams]))]


def kernel_mean_prior(positives: np.ndarray, unlabelled: np.ndarray, threshold: float | None = None, steps: int = 300, tolerance: float = 0.04) -> float:
    """Kernel-mean estimate of the share of positives among unlabelled rows, on samples of bounded size.

    The unlabelled mean, moved away from the positives' mean by a factor lambda, stays near the convex hull of the points
    in feature space up to lambda = 1 / (1 - share); from there its distance rises. Lambda is found by halving [1, 8]
    until the slope of the distance passes `threshold` times the distance of the two means, or, without a threshold,
    1 / sqrt of the smaller sample. Distances come from projected gradients with momentum on the simplex.
    """
    x = np.concatenate([unlabelled, positives])
    nu, n_p = len(unlabelled), len(positives)
    gram = rbf_gram(x, nu)
    mu, mp = np.zeros(len(x)), np.zeros(len(x))
    mu[:nu], mp[nu:] = 1 / nu, 1 / n_p
    step = 1 / np.linalg.norm(gram, 2)
    apart = float(np.sqrt(max(0.0, (mu - mp) @ gram @ (mu - mp))))
    limit = (1 / np.sqrt(min(nu, n_p)) if threshold is None else threshold) * apart

    def distance(lam: float) -> float:
        target = lam * mu + (1 - lam) * mp
        w = _simplex(target)
        v, t = w, 1.0
        for _ in range(steps):
            new = _simplex(v - step * (gram @ (v - target)))
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = new + (t - 1) / after * (new - w), new, after
        d = w - target
        return float(np.sqrt(max(0.0, d @ gram @ d)))

    low, high = 1.0, 8.0
    while high - low > tolerance:
        middle = (low + high) / 2
        slope = (distance(middle + tolerance / 2) - distance(middle)) * 2 / tolerance
        low, high = (low, middle) if slope > limit else (middle, high)
    return float(np.clip(1 - 2 / (low + high), 0, 1))


def multi_sample_prior(df: DataFrame, key: str, features: Sequence[str], runs: int = 10, positives: int = 500, unlabelled: int = 1000, seed: int = 2025, **options) -> DataFrame:
    """(run, n_p, n_u, prior): kernel-mean estimates on independent samples, one task each.

    A run draws about `positives` positive and `unlabelled` unlabelled rows by a hash of key and run; features are scaled
    by the mean and deviation of all these rows' table, with nulls as the mean. Runs without either kind have no row.
    """
    names = list(features)
    n = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label").isNull()).alias("u")).first()
    scaled = standardise(df, names).select(F.col(key).alias("_key"), "label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    many = scaled.filter("label IS NULL OR label = 1").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    share = lambda m, all_: min(1.0, m / all_) if all_ else 1.0
    drawn = F.when(F.col("label") == 1, drawn_share(share(positives, n["p"]), F.col("_key"), F.col("run"), F.lit(seed))).otherwise(drawn_share(share(unlabelled, n["u"]), F.col("_key"), F.col("run"), F.lit(seed)))

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable")
        p, u = (pdf.loc[m, names].to_numpy(float) for m in (pdf["label"] == 1, pdf["label"].isna()))
        rows = [(int(pdf["run"].iloc[0]), len(p), len(u), kernel_mean_prior(p, u, **options))] if len(p) > 1 and len(u) > 1 else []
        return pd.DataFrame(rows, columns=["run", "n_p", "n_u", "prior"])

    return many.filter(drawn).groupBy("run").applyInPandas(estimate, "run int, n_p long, n_u long, prior double")


def prior_interval(runs: DataFrame) -> DataFrame:
    """(runs, prior, lower, upper): the median over runs, which is the value to work with, and the 2.5th and 97.5th percentile,
    null for a single run."""
    made = runs.agg(F.count("prior").alias("runs"), F.percentile("prior", F.array(*[F.lit(q) for q in (0.5, 0.025, 0.975)])).alias("q"))
    return made.select("runs", F.col("q")[0].alias("prior"), F.when(F.col("runs") > 1, F.col("q")[1]).alias("lower"), F.when(F.col("runs") > 1, F.col("q")[2]).alias("upper"))


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    cum = np.cumsum(u) - 1
    k = np.flatnonzero(u - cum / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - cum[k] / (k + 1), 0)


def prior_sensitivity(df: DataFrame, prior: float, score: str = "score", factors: Sequence[float] = (0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4)) -> DataFrame:
    """(factor, assumed, estimate): the quantile estimate after scores are scaled to an assumed prior, for each factor."""
    out = None
    for f in factors:
        assumed = min(max(prior * f, 1e-6), 0.9999)
        scaled = df.withColumn("_s", F.least(F.greatest(F.col(score) * (assumed / max(prior, 1e-6)), F.lit(0.0)), F.lit(1.0)))
        one = blanchard(scaled, "_s").select(F.lit(f).alias("factor"), F.lit(assumed).alias("assumed"), F.col("prior").alias("estimate"))
        out = one if out is None else out.unionByName(one)
    return out


# --- risk-corrected models ---


def _risk_sums(rows: DataFrame, w: np.ndarray) -> dict[str, tuple[float, float, np.ndarray, np.ndarray, np.ndarray]]:
    """For positives, negatives and unlabelled rows: their number and the sums of l-, q x, q (1 - q) x x', and x.

    Every task gives one row a number, of which there are 3 (2 + 2 d + d^2); Spark adds them up before any is collected.
    """
    d = len(w)

    def run(batches):
        total = np.zeros((3, 2 + 2 * d + d * d))
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([*[np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in batch.columns[1:]], np.ones(batch.num_rows)])
            s = x @ w
            q = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
            for k, here in enumerate((label == 1, label == 0, np.isnan(label.astype(float)))):
                xk, qk = x[here], q[here]
                total[k] += np.concatenate([[len(xk), np.logaddexp(0, s[here]).sum()], xk.T @ qk, xk.sum(axis=0), ((xk * (qk * (1 - qk))[:, None]).T @ xk).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    total = np.zeros((3, 2 + 2 * d + d * d))
    for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total.flat[r["i"]] = r["v"]
    return {k: (t[0], t[1], t[2 : 2 + d], t[2 + 2 * d :].reshape(d, d), t[2 + d : 2 + 2 * d]) for k, t in zip("pnu", total, strict=True)}


def nnpu_logit(df: DataFrame, features: Sequence[str], prior: float, gamma: float = 1.0, l2: float = 1e-3, steps: int = 40, tolerance: float = 1e-8) -> np.ndarray:
    """Weights (intercept last) of a linear score under the non-negative PU risk with a gamma-weighted negative term.

    Risk: prior * E_P[l+] + max(0, A) + gamma * (1 - prior) / n_U * sum_N[l-] with A = E_U[l-] - prior * E_P[l-], as
    published, plus l2 / 2 * |w|^2 without the intercept. As the larger of two convex functions it is convex: Newton's
    method takes A as it is until A falls below 0, then looks for the least risk where A is 0 (weights and the share of A
    that acts, together), and if that share ends outside of 0 to 1, leaves A out or takes it whole. Each step is one job that returns sums of
    the features' length squared; null features count as 0.
    """
    rows = df.select(F.col("label").cast("double"), *[F.col(c).cast("double") for c in features])
    d = len(features) + 1
    w, part, kind = np.zeros(d), 1.0, "whole"
    ridge = np.diag([l2] * (d - 1) + [1e-9])
    for _ in range(steps):
        s = _risk_sums(rows, w)
        (n_p, loss_p, q_p, h_p, x_p), (_, _, q_n, h_n, _), (n_u, loss_u, q_u, h_u, _) = s["p"], s["n"], s["u"]
        n_p, n_u = max(1.0, n_p), max(1.0, n_u)
        a, g_a, h_a = loss_u / n_u - prior * loss_p / n_p, q_u / n_u - prior * q_p / n_p, h_u / n_u - prior * h_p / n_p
        g = prior * (q_p - x_p) / n_p + gamma * (1 - prior) * q_n / n_u + ridge @ w + part * g_a
        h = prior * h_p / n_p + gamma * (1 - prior) * h_n / n_u + ridge + part * h_a
        if kind == "whole" and a < -1e-9:
            kind, part, h, g = "edge", 0.5, h - 0.5 * h_a, g - 0.5 * g_a
        if kind == "edge":
            both = np.linalg.lstsq(np.block([[h, g_a[:, None]], [g_a[None, :], np.zeros((1, 1))]]), np.append(g, a), rcond=None)[0]
            step, part = both[:-1], part - both[-1]
        else:
            step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < tolerance:
            if kind != "edge" or 0 <= part <= 1:
                break
            kind, part = ("none", 0.0) if part < 0 else ("settled whole", 1.0)
    return w


def linear_score(features: Sequence[str], w: Sequence[float]) -> Column:
    s = F.lit(float(w[-1]))
    for c, a in zip(features, w, strict=False):
        s = s + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(a))
    return 1 / (1 + F.exp(-s))


def _of_bags(w: np.ndarray, gamma: float):
    """of(labels, bag and features) for summed: each bag's rows, gradient and second derivatives; bag -1 stands for all bags."""
    bags, d = w.shape

    def of(label: np.ndarray, x: np.ndarray) -> np.ndarray:
        bag, x = x[:, 0].astype(np.int64), np.column_stack([x[:, 1:], np.ones(len(x))])
        square = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        y, weight = (label == 1).astype(float), np.where(label == 0, gamma, 1.0)
        out = np.zeros((1 + d + d * d, bags))
        every = bag < 0
        if every.any():
            p = 1 / (1 + np.exp(-np.clip(x[every] @ w.T, -30, 30)))
            out[0] += every.sum()
            out[1 : 1 + d] += x[every].T @ (weight[every, None] * (p - y[every, None]))
            out[1 + d :] += square[every].T @ (weight[every, None] * p * (1 - p) + 1e-9)
        x, square, bag, y, weight = x[~every], square[~every], bag[~every], y[~every], weight[~every]
        p = 1 / (1 + np.exp(-np.clip((x * w[bag]).sum(axis=1), -30, 30)))
        out[0] += np.bincount(bag, minlength=bags)
        for i in range(d):
            out[1 + i] += np.bincount(bag, x[:, i] * (weight * (p - y)), bags)
        for i in range(d * d):
            out[1 + d + i] += np.bincount(bag, square[:, i] * (weight * p * (1 - p) + 1e-9), bags)
        return out.ravel()

    return of


def bagged_weights(df: DataFrame, key: str, features: Sequence[str], bags: int = 150, unlabelled: int = 15_000, gamma: float = 1.0, seed: int = 2025, l2: float = 1.0, steps: int = 25) -> DataFrame:
    """(bag, w array): one weighted logistic model per bag of all labelled rows and about `unlabelled` unlabelled ones.

    Unlabelled rows are dealt to bags by hash. Labelled rows belong to every bag and are neither copied nor sent: all bags
    go through Newton's method side by side, each step one job that adds up a gradient and second derivatives a bag.
    """
    n_u = df.filter("label IS NULL").count()
    share = min(1.0, unlabelled / n_u) if n_u else 1.0
    u = drawn_share(share, F.col(key), F.col("bag"), F.lit(seed))
    rows = df.select(key, F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features])
    some = rows.filter("label IS NULL").withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).filter(u)
    dealt = rows.filter("label IS NOT NULL").withColumn("bag", F.lit(-1)).unionByName(some).select("label", "bag", *features).persist()
    d = len(features) + 1
    w, n = np.zeros((bags, d)), np.zeros(bags)
    try:
        for _ in range(steps):
            sums = summed(dealt, _of_bags(w, gamma), bags * (1 + d + d * d)).reshape(1 + d + d * d, bags).T
            n, g, h = sums[:, 0], sums[:, 1 : 1 + d] + l2 * w, sums[:, 1 + d :].reshape(bags, d, d) + l2 * np.eye(d)
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            w = w - step
            if np.abs(step).max() < 1e-10:
                break
    finally:
        dealt.unpersist()
    return df.sparkSession.createDataFrame([(b, w[b].tolist()) for b in range(bags) if n[b]], "bag int, w array<double>")


def bagged_score(df: DataFrame, features: Sequence[str], models: DataFrame) -> DataFrame:
    """Mean probability over the bags' models, which are few and short: they are collected and go to every task. Narrow; null features count as 0."""
    w = np.array([r["w"] for r in models.orderBy("bag").collect()]).reshape(-1, len(features) + 1)
    slim = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)])
    kept = df.columns

    def run(batches):
        for batch in batches:
            x = np.column_stack([*[c.to_numpy(zero_copy_only=False) for c in batch.columns[len(kept) :]], np.ones(batch.num_rows)])
            score = (1 / (1 + np.exp(-np.clip(x @ w.T, -700, 700)))).sum(axis=1) / max(1, len(w))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score, pa.float64())], names=[*kept, "score"])

    return slim.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType())]))


def labelled_logit(df: DataFrame, features: Sequence[str], l2: float = 1e-3, steps: int = 40, tolerance: float = 1e-8) -> np.ndarray:
    """Weights (intercept last) of a plain logistic regression on labelled rows; unlabelled ones take no part. Newton's
    method, a job a step; long steps are cut."""
    rows = df.filter("label IS NOT NULL").select(F.col("label").cast("double"), *[F.col(c).cast("double") for c in features])
    w = np.zeros(len(features) + 1)
    ridge = np.diag([l2] * len(features) + [1e-9])
    for _ in range(steps):
        s = _risk_sums(rows, w)
        n = max(1.0, s["p"][0] + s["n"][0])
        step = np.linalg.solve((s["p"][3] + s["n"][3]) / n + ridge, (s["p"][2] - s["p"][4] + s["n"][2]) / n + ridge @ w)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < tolerance:
            break
    return w


def em_hard(df: DataFrame, features: Sequence[str], rounds: int = 5, least: float = 5, most: float = 30, hold: float = 0.15, seed: int = 17) -> tuple[np.ndarray, DataFrame]:
    """(weights of the best round, log): reliable negatives from unlabelled rows below a percentile of the score.

    Round 0 learns from labelled rows alone, each later one from these and the reliable negatives that the model before it
    finds, all of one weight; other unlabelled rows take no part. A share `hold` of the labelled rows is kept out of all
    fits, by a hash of the features, and the round of the highest average precision on them is returned (all labelled rows,
    if that share lacks a kind). The percentile starts at `least` and rises by 5 while the last refit kept margins of more
    than 0.10 over both limits, by 2 for margins of more than 0.05, up to `most`. Stops when the refit puts fewer than 0.8 of
    the negatives below 0.5, fewer than half of the positives above it, or when reliable negatives exceed half of the
    unlabelled. The percentile is exact, from one row a distinct score.
    """
    cols = list(features)
    spark = df.sparkSession
    kept_out = F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(10_000)) < int(hold * 10_000)
    rows = df.select("label", *cols).withColumn("_out", F.col("label").isNotNull() & kept_out)
    c = rows.agg(F.count_if(F.col("label").isNull()).alias("u"), F.count_if(F.col("_out") & (F.col("label") == 1)).alias("p"), F.count_if(F.col("_out") & (F.col("label") == 0)).alias("n")).first()
    judged = rows.filter("_out") if c["p"] and c["n"] else rows.filter("label IS NOT NULL")
    train = rows.filter("NOT _out")
    quality = lambda w: average_precision(judged.withColumn("score", linear_score(cols, w))).first()["pr_auc"] or 0.0
    w = labelled_logit(train, cols)
    best, log, q = (quality(w), w), [], float(least)
    for r in range(rounds):
        scored = train.withColumn("score", linear_score(cols, w))
        cut = scored.filter("label IS NULL").groupBy("score").count().agg(F.percentile("score", F.lit(q / 100), F.col("count"))).first()[0]
        if cut is None:
            break
        target = scored.withColumn("label2", F.when(F.col("label").isNotNull(), F.col("label")).when(F.col("score") < cut, 0))
        reliable = target.filter("label IS NULL AND label2 = 0").count()
        if not reliable:
            break
        w = labelled_logit(target.drop("label", "score").withColumnRenamed("label2", "label"), cols)
        now = rows.withColumn("score", linear_score(cols, w))
        m = now.agg(F.avg(F.when(F.col("label") == 0, (F.col("score") < 0.5).cast("double"))).alias("precision"), F.avg(F.when(F.col("label") == 1, (F.col("score") > 0.5).cast("double"))).alias("recall")).first()
        precision, recall, reached = m["precision"] or 0.0, m["recall"] or 0.0, quality(w)
        best = max(best, (reached, w), key=lambda x: x[0])
        log.append((r, q, float(cut), reliable, precision, recall, float(reached)))
        if reliable > 0.5 * c["u"] or precision < 0.8 or recall < 0.5:
            break
        margin = min(precision - 0.8, recall - 0.5)
        q = min(q + (5 if margin > 0.10 else 2 if margin > 0.05 else 0), float(most))
    return best[1], spark.createDataFrame(log, "round int, percentile double, cut double, reliable long, precision double, recall double, pr_auc double")


# --- explanation ---


def partial_dependence(df: DataFrame, feature: str, score: Column, points: int = 50) -> DataFrame:
    """(value, mean_score): the mean score with the feature set to each of evenly spaced values from p5 to p95."""
    e = df.agg(F.percentile(feature, F.array(F.lit(0.05), F.lit(0.95))).alias("e")).first()["e"]
    if e is None:
        return df.sparkSession.createDataFrame([], "value double, mean_score double")
    grid = [e[0] + (e[1] - e[0]) * i / max(1, points - 1) for i in range(points)]
    t = df.withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn("_s", score)
    return t.groupBy(F.col(feature).alias("value")).agg(F.avg("_s").alias("mean_score"))


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], score: Column, seed: int = 2025) -> DataFrame:
    """(feature, importance): mean absolute change of the score when a feature's value is another row's.

    The other row is the next one in pseudo-random order within a hash bucket, so no task sorts the whole table.
    """
    base = df.withColumn("_base", score).withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(256)))
    order = F.expr(f"xxhash64({key}, {seed + 1})")
    out = None
    for f in features:
        w = Window.partitionBy("_bucket").orderBy(order)
        moved = base.withColumn(f, F.coalesce(F.lead(f).over(w), F.first(f).over(w.rowsBetween(Window.unboundedPreceding, 0))))
        one = moved.withColumn("_now", score).agg(F.lit(f).alias("feature"), F.avg(F.abs(F.col("_now") - F.col("_base"))).alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out

