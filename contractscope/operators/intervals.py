"""Platt scaling of many groups at once, and bootstrap intervals of scores, calibrated and shifted to a prior."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractscope.operators.boost import Trees, drawn_share, fit_one
from contractscope.operators.metrics import poisson_weight, prior_shift
from contractscope.operators.panel import percentile_rank


def platt_groups(df: DataFrame, keys: Sequence[str], score: str = "score", weight: str | None = None, steps: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """(keys, a, b, se_a, se_b, n_p, n_n): a logistic regression of the label on the score for every group at once.

    Newton's method for all groups together: a step is one aggregation by the keys, of which seven sums a group reach the
    driver, so groups must be few (folds times replicates); a group whose step is small enough stays as it is. Long steps are cut, so
    that no row's log-odds moves by more than about eight in one. Without both labels, or with scores that tell
    them apart wholly or that are all equal, there is no finite fit: a, b and their errors are null.
    """
    spark = df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.filter(f"label IS NOT NULL AND {score} IS NOT NULL").select(*keys, F.col(score).cast("double").alias("_x"), F.col("label").cast("double").alias("_y"), w.alias("_w")).filter("_w > 0")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys]
    first = rows.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_y")).alias("p"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.min(F.when(F.col("_y") == 1, F.col("_x"))).alias("p_low"), F.max(F.when(F.col("_y") == 1, F.col("_x"))).alias("p_high"), F.min(F.when(F.col("_y") == 0, F.col("_x"))).alias("n_low"), F.max(F.when(F.col("_y") == 0, F.col("_x"))).alias("n_high")).collect()
    counts = {tuple(r[k] for k in keys): (r["p"], r["n"]) for r in first}
    told = {tuple(r[k] for k in keys): r for r in first}
    at = {k: (0.0, float(np.log(p / n))) for k, (p, n) in counts.items() if p > 0 and n > 0 and told[k]["low"] < told[k]["high"] and told[k]["p_low"] < told[k]["n_high"] and told[k]["n_low"] < told[k]["p_high"]}
    done: dict[tuple, tuple] = {}
    for _ in range(steps):
        open_ = {k: v for k, v in at.items() if k not in done}
        if not open_:
            break
        now = spark.createDataFrame([(*k, *v) for k, v in open_.items()], ", ".join([*kinds, "_a double", "_b double"]))
        p = 1 / (1 + F.exp(-(F.col("_a") * F.col("_x") + F.col("_b"))))
        c = F.col("_w") * p * (1 - p)
        sums = rows.join(now, list(keys)).groupBy(*keys).agg(F.sum(F.col("_w") * (F.col("_y") - p) * F.col("_x")).alias("ga"), F.sum(F.col("_w") * (F.col("_y") - p)).alias("gb"), F.sum(c * F.col("_x") * F.col("_x")).alias("aa"), F.sum(c * F.col("_x")).alias("ab"), F.sum(c).alias("bb"))
        for r in sums.collect():
            k = tuple(r[x] for x in keys)
            det = r["aa"] * r["bb"] - r["ab"] ** 2
            if det <= 1e-300:
                done[k] = (None, None)
                continue
            da, db = (r["bb"] * r["ga"] - r["ab"] * r["gb"]) / det, (r["aa"] * r["gb"] - r["ab"] * r["ga"]) / det
            size = max(abs(da) * max(1.0, abs(told[k]["low"]), abs(told[k]["high"])), abs(db))
            cut = min(1.0, 4.0 / size) if size else 1.0  # no row's log-odds moves by more than about eight in a step
            at[k] = (at[k][0] + cut * da, at[k][1] + cut * db)
            if abs(da) + abs(db) < tolerance:
                done[k] = ((r["bb"] / det) ** 0.5, (r["aa"] / det) ** 0.5)
    out = []
    for k, (p, n) in counts.items():
        se = done.get(k, (None, None))
        fit = at[k] if k in at and se[0] is not None else (None, None)
        out.append((*k, *fit, *se, float(p), float(n)))
    return spark.createDataFrame(out, ", ".join([*kinds, "a double", "b double", "se_a double", "se_b double", "n_p double", "n_n double"]))


def platt_table(df: DataFrame, fold: str = "fold", score: str = "score") -> DataFrame:
    """(fold, a, b, se_a, se_b, n_p, n_n): each fold's scaling, their mean with sample deviations as errors, and all rows'."""
    each = platt_groups(df, [fold], score).withColumn("fold", F.col(fold).cast("string"))
    names = ["fold", "a", "b", "se_a", "se_b", "n_p", "n_n"]
    mean = each.agg(F.lit("mean").alias("fold"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.stddev_samp("a").alias("se_a"), F.stddev_samp("b").alias("se_b"), F.lit(None).cast("double").alias("n_p"), F.lit(None).cast("double").alias("n_n"))
    whole = platt_groups(df.withColumn("_all", F.lit("global")), ["_all"], score).withColumnRenamed("_all", "fold")
    return each.select(*names).unionByName(mean.select(*names)).unionByName(whole.select(*names))


def quantile(values: Column, q: float) -> Column:
    """Linear quantile of an array of doubles; null for an empty one."""
    sorted_ = F.array_sort(values)
    place = (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.try_element_at(sorted_, low + 1), F.try_element_at(sorted_, F.least(low + 2, F.size(values)))
    return a + (b - a) * (place - low)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def intervals(df: DataFrame, key: str, replicates: str, prior: float, rate: float, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(key, score_mean, score_lower, score_upper, pc_mean, pc_lower, pc_upper, lift_vs_prior, percentile_rank).

    `replicates` is each row's array of calibrated probabilities. pc_* are shifted from the training share `rate` of
    positives to the prior; the rank is that of the mean among all rows, in percent, ties getting their mean rank. A row
    without replicates has nulls. Arrays are reduced where they lie; only one number a row is ranked.
    """
    keep = lambda p: F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    known = F.filter(replicates, lambda x: x.isNotNull())
    has = F.size(known) > 0
    t = df.select(key, F.when(has, mean_of(known)).alias("score_mean"), F.when(has, quantile(known, low)).alias("score_lower"), F.when(has, quantile(known, high)).alias("score_upper"))
    t = t.withColumns({f"pc_{c}": prior_shift(keep(F.col(f"score_{c}")), prior, rate) for c in ("mean", "lower", "upper")})
    return percentile_rank(t.withColumn("lift_vs_prior", F.col("pc_mean") / prior), "score_mean")


def _scaled(score: Column, fits: Sequence[tuple[float, float]]) -> Column:
    """Array of the score's probabilities by each (a, b)."""
    a, b = (F.lit(np.array([f[i] for f in fits])) for i in (0, 1))
    return F.zip_with(a, b, lambda x, y: 1 / (1 + F.exp(-(x * score + y))))


def calibrated_replicates(df: DataFrame, key: str, fold: str = "fold", score: str = "score", replicates: int = 200, seed: int = 2028) -> DataFrame:
    """(key, probs): every row's score scaled by each replicate of the scaling that the other folds' labelled rows give.

    A replicate draws labelled rows with replacement, as Poisson counts of a hash. All folds and replicates are fitted
    together; the fits, folds times replicates of two numbers, are collected and sent with the query.
    """
    folds = sorted(r[0] for r in df.select(fold).filter(F.col(fold).isNotNull()).distinct().collect())
    labelled = df.filter(f"label IS NOT NULL AND {score} IS NOT NULL AND {fold} IS NOT NULL").select(key, "label", score, fold)
    many = labelled.withColumn("out", F.explode(F.array(*[F.lit(f) for f in folds]))).filter(F.col("out") != F.col(fold)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    many = many.withColumn("weight", poisson_weight(F.col(key), F.col("replicate"), seed)).filter("weight > 0")
    fits: dict = {f: [] for f in folds}
    for r in platt_groups(many, ["out", "replicate"], score, "weight").filter("a IS NOT NULL").orderBy("out", "replicate").collect():
        fits[r["out"]].append((r["a"], r["b"]))
    array = F.lit(None).cast("array<double>")
    for f in folds:
        if fits[f]:
            array = F.when(F.col(fold) == f, _scaled(F.col(score), fits[f])).otherwise(array)
    return df.filter(F.col(fold).isNotNull()).select(key, F.when(F.col(score).isNotNull(), array).alias("probs"))


def refitted_replicates(df: DataFrame, key: str, features: Sequence[str], scored: DataFrame, replicates: int = 200, kind: str = "nnpu", prior: float = 0.02, gamma: float = 1.0, unlabelled: int = 15_000, seed: int = 2028, **options) -> DataFrame:
    """(key, raw): for every row of `scored` the scores of models refitted on positives, negatives and unlabelled rows that
    are each drawn with replacement. A fit is one task on one bounded sample; scoring is narrow."""
    names = list(features)
    rows = df.select(F.col(key).alias("_key"), F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in names])
    n_u = rows.filter("label IS NULL").count()
    some = rows.filter(F.col("label").isNotNull() | drawn_share(min(1.0, unlabelled / n_u) if n_u else 1.0, F.col("_key"), F.lit(seed)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["b"].iloc[0])
        pdf = pdf.sort_values("_key", kind="stable")
        x, label, rng = pdf[names].to_numpy(float), pdf["label"].to_numpy(float), np.random.default_rng([seed, b])
        kinds = [np.flatnonzero(k) for k in (label == 1, label == 0, np.isnan(label))]
        at = np.concatenate([rng.choice(k, len(k)) for k in kinds if len(k)])
        return pd.DataFrame({"b": [b], "model": [fit_one(kind, x[at], label[at], gamma, prior, seed + b, **options).text()]})

    made = some.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).groupBy("b").applyInPandas(fit, "b int, model string")
    models = df.sparkSession.sparkContext.broadcast([r["model"] for r in made.orderBy("b").collect()])
    kind_of = scored.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Trees.of(t) for t in models.value]
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            raw = np.column_stack([t.raw(x) for t in trees]) if len(x) else np.zeros((0, len(trees)))
            yield pd.DataFrame({key: pdf[key], "raw": list(raw if kind == "extra" else 1 / (1 + np.exp(-np.clip(raw, -40, 40))))})

    return scored.select(key, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, f"`{key}` {kind_of}, raw array<double>")
