"""Evaluation of scores with ties handled by group: lift, average precision, ROC, calibration, conformal sets.

All operators take a long table with columns label (1, 0 or null for unlabelled) and score, and group keys such as
(model, gamma, fold). Rows are first summed up by distinct score, so windows run over distinct scores only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractscope.operators.panel import percentile_rank, running_sum


def by_score(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Positives, negatives and all rows for each distinct score, and from the highest score down to it."""
    each = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"), F.count("*").alias("rows"))
    down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return each.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "top": F.sum("rows").over(down), "p_all": F.sum("p").over(whole), "n_all": F.sum("n").over(whole), "rows_all": F.sum("rows").over(whole)})


def lift_at(df: DataFrame, shares: Sequence[float], keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """(keys, k, lift): share of positives among the top k of scores over k.

    The threshold is the score of row max(1, ceil(k * rows)); ties at it all count as in the top, as published. With
    strict, what the ties exceed is taken off in proportion, so constant scores have lift 1.
    """
    t = by_score(df, keys).withColumn("k", F.explode(F.array(*[F.lit(s) for s in shares])))
    t = t.withColumn("_top", F.greatest(F.lit(1), F.ceil(F.round(F.col("k") * F.col("rows_all"), 9))))
    at = t.filter("top >= _top").groupBy(*keys, "k").agg(F.min_by(F.struct("tp", "p", "top", "rows", "p_all", "_top"), "top").alias("s")).select(*keys, "k", "s.*")
    hit = F.col("tp") - F.col("p") * (F.col("top") - F.col("_top")) / F.col("rows") if strict else F.col("tp")
    return at.select(*keys, "k", F.try_divide(hit.cast("double"), F.col("k") * F.col("p_all")).alias("lift"))


def average_precision(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pr_auc): step-wise, over labelled rows; null without positives or negatives."""
    t = by_score(df.filter("label IS NOT NULL"), keys)
    step = F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.groupBy(*keys).agg(F.when((F.max("p_all") > 0) & (F.max("n_all") > 0), F.sum(step) / F.max("p_all")).alias("pr_auc"))


def roc_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, roc_auc): share of positive-negative pairs in the right order, ties counting half."""
    t = by_score(df.filter("label IS NOT NULL"), keys)
    below = F.col("n_all") - F.col("fp")
    return t.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * (below + F.col("n") / 2)), F.max(F.col("p_all") * F.col("n_all")).cast("double")).alias("roc_auc"))


def evaluate(df: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.01, 0.02, 0.05)) -> DataFrame:
    """One row per group: lift at each share, pr_auc and roc_auc."""
    lifts = lift_at(df, shares, keys).groupBy(*keys).pivot("k", list(shares)).agg(F.first("lift"))
    for s in shares:
        lifts = lifts.withColumnRenamed(str(s), f"lift_{round(s * 100)}")
    return lifts.join(average_precision(df, keys), list(keys)).join(roc_auc(df, keys), list(keys))


def across_folds(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric over folds."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_sd") for m in metrics])


def rank_agreement(df: DataFrame, scores: Sequence[str], far: float = 20.0) -> DataFrame:
    """(model_a, model_b, n, spearman, mae, share_far) for every pair of score columns, over rows that have both.

    Each column's percentile ranks (mean ranks for ties) are taken over the rows that have every score, so that all pairs
    are compared on the same rows; all pairs come from one aggregation. mae is in percentage points; share_far is the
    share of rows whose ranks are more than `far` points apart, times 100. The correlation is null where ranks are all
    equal.
    """
    known = df
    for s in scores:
        known = known.filter(F.col(s).isNotNull())
    ranked = known.select(*scores)
    for s in scores:
        ranked = percentile_rank(ranked, s, f"_rank_{s}")
    pairs = [(a, b) for i, a in enumerate(scores) for b in scores[i + 1 :]]
    gap = lambda a, b: F.abs(F.col(f"_rank_{a}") - F.col(f"_rank_{b}"))
    made = ranked.agg(F.count("*").alias("n"), *[x for i, (a, b) in enumerate(pairs) for x in (F.corr(f"_rank_{a}", f"_rank_{b}").alias(f"r{i}"), F.avg(gap(a, b)).alias(f"m{i}"), F.avg((gap(a, b) > far + 1e-9).cast("double") * 100).alias(f"f{i}"))])
    rows = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col("n"), F.nanvl(f"r{i}", F.lit(None)).alias("spearman"), F.col(f"m{i}").alias("mae"), F.col(f"f{i}").alias("share_far")) for i, (a, b) in enumerate(pairs)]
    return made.select(F.inline(F.array(*rows)))


# --- calibration ---


def calibration(df: DataFrame, keys: Sequence[str] = (), prob: str = "prob", bins: int = 10, half_open: bool = False) -> DataFrame:
    """(keys, ece, brier, n) of labelled rows. With half_open, a probability of 1 is in no bin, as published."""
    t = df.filter(f"label IS NOT NULL AND {prob} IS NOT NULL").withColumn("_bin", F.floor(F.col(prob) * bins))
    if not half_open:
        t = t.withColumn("_bin", F.least("_bin", F.lit(bins - 1)))
    each = t.groupBy(*keys, "_bin").agg(F.count("*").alias("c"), F.avg(prob).alias("mp"), F.avg(F.col("label").cast("double")).alias("ml"), F.sum(F.pow(F.col(prob) - F.col("label"), 2)).alias("se"))
    inside = F.when(F.col("_bin") < bins, F.col("c") * F.abs(F.col("mp") - F.col("ml"))).otherwise(0.0)
    return each.groupBy(*keys).agg((F.sum(inside) / F.sum("c")).alias("ece"), (F.sum("se") / F.sum("c")).alias("brier"), F.sum("c").alias("n"))


def fit_platt(df: DataFrame, score: str = "score", steps: int = 50) -> dict[str, float]:
    """Slope and intercept of an unregularised logistic regression on the score, with Fisher standard errors.

    Newton's method; each step is one job that returns six sums, so nothing of the data's size reaches the driver.
    """
    rows = df.filter(f"label IS NOT NULL AND {score} IS NOT NULL").select(F.col(score).cast("double").alias("x"), F.col("label").cast("double").alias("y"))
    a = b = 0.0
    info = (1.0, 0.0, 1.0)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w = p * (1 - p)
        g = rows.agg(F.sum((F.col("y") - p) * F.col("x")), F.sum(F.col("y") - p), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first()
        if g[0] is None:
            return {"a": float("nan"), "b": float("nan"), "se_a": float("nan"), "se_b": float("nan")}
        info = (g[2], g[3], g[4])
        det = g[2] * g[4] - g[3] * g[3]
        if det <= 1e-12:
            break
        da, db = (g[4] * g[0] - g[3] * g[1]) / det, (g[2] * g[1] - g[3] * g[0]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    det = info[0] * info[2] - info[1] ** 2
    return {"a": a, "b": b, "se_a": (info[2] / det) ** 0.5 if det > 0 else float("inf"), "se_b": (info[0] / det) ** 0.5 if det > 0 else float("inf")}


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * score + F.lit(b))))


def prior_shift(p: Column, prior: float, rate: float) -> Column:
    """Probability under a prior instead of the training share of positives."""
    return 1 / (1 + F.exp(-(F.ln(p / (1 - p)) + F.ln(F.lit(prior / (1 - prior))) - F.ln(F.lit(rate / (1 - rate))))))


# --- conformal prediction ---


def conformal_thresholds(calibration_rows: DataFrame, alpha: float = 0.1, prob: str = "prob", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, q1, q0): for each class the nonconformity score at level min(1, ceil((n + 1)(1 - alpha)) / n), lower."""
    s = F.when(F.col("label") == 1, 1 - F.col(prob)).otherwise(F.col(prob))
    rows = calibration_rows.filter("label IS NOT NULL").withColumn("_s", s)
    each = rows.groupBy(*keys, "label", "_s").agg(F.count("*").alias("c"))
    up = Window.partitionBy(*keys, "label").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("c").over(Window.partitionBy(*keys, "label"))
    level = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * (1 - alpha), 9)) / n)
    place = F.floor(F.round(level * (n - 1), 9)) + 1
    t = each.withColumns({"_upto": F.sum("c").over(up), "_place": place}).filter("_upto >= _place").groupBy(*keys, "label").agg(F.min("_s").alias("q"))
    return t.groupBy(*keys).agg(F.max(F.when(F.col("label") == 1, F.col("q"))).alias("q1"), F.max(F.when(F.col("label") == 0, F.col("q"))).alias("q0"))


def prediction_sets(rows: DataFrame, thresholds: DataFrame, prob: str = "prob", keys: Sequence[str] = ()) -> DataFrame:
    """Add in1, in0, set and size; thresholds has one row per key."""
    t = rows.join(thresholds, list(keys)) if keys else rows.join(F.broadcast(thresholds))
    t = t.withColumns({"in1": F.coalesce(1 - F.col(prob) <= F.col("q1"), F.lit(False)), "in0": F.coalesce(F.col(prob) <= F.col("q0"), F.lit(False))})
    name = F.when(F.col("in1") & F.col("in0"), "{0,1}").when(F.col("in1"), "{1}").when(F.col("in0"), "{0}").otherwise("{}")
    return t.withColumns({"set": name, "size": F.col("in1").cast("int") + F.col("in0").cast("int")}).drop("q1", "q0")


def conformal_p_values(rows: DataFrame, calibration_rows: DataFrame, prob: str = "prob", name: str = "p_value") -> DataFrame:
    """(1 + calibration positives whose score is no smaller) / (n + 1); rows without a probability keep a null value."""
    known = calibration_rows.filter((F.col("label") == 1) & F.col(prob).isNotNull())
    cal = known.select((1 - F.col(prob)).alias("_s")).groupBy("_s").agg(F.count("*").alias("_c"))
    asked = rows.withColumn("_s", 1 - F.col(prob))
    both = cal.unionByName(asked.filter("_s IS NOT NULL").select("_s").distinct().withColumn("_c", F.lit(0).cast("long"))).groupBy("_s").agg(F.sum("_c").alias("_c"))
    n = known.count()
    table = running_sum(both, "_s", "_c", "_upto", down=True).select("_s", ((1 + F.col("_upto")) / (1 + F.lit(n))).alias(name))
    return asked.join(table, "_s", "left").drop("_s")


def coverage(sets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage overall and by class, mean size, and shares of each kind of set, over labelled rows."""
    hit = F.when(F.col("label") == 1, F.col("in1")).otherwise(F.col("in0")).cast("double")
    share = lambda s: F.avg((F.col("set") == s).cast("double"))
    return sets.filter("label IS NOT NULL").groupBy(*keys).agg(F.avg(hit).alias("coverage"), F.avg(F.when(F.col("label") == 1, hit)).alias("coverage_1"), F.avg(F.when(F.col("label") == 0, hit)).alias("coverage_0"), F.avg(F.col("size").cast("double")).alias("mean_size"), share("{0,1}").alias("share_both"), share("{}").alias("share_empty"))


# --- bootstrap ---


def poisson_weight(key: Column, replicate: Column, seed: int = 2025) -> Column:
    """Poisson(1) count from a hash of key and replicate: the distributed form of drawing with replacement."""
    u = (F.pmod(F.xxhash64(key, replicate, F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    out, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        out = out + (u > total).cast("int")
        term /= k
    return out


def bootstrap(df: DataFrame, key: str, value: Column, replicates: int = 200, keys: Sequence[str] = (), seed: int = 2025) -> DataFrame:
    """(keys, mean, lower, upper, sd): percentile interval of a mean over Poisson replicates, with population sd."""
    rows = df.withColumns({"_v": value, "_b": F.explode(F.sequence(F.lit(1), F.lit(replicates)))})
    rows = rows.withColumn("_w", poisson_weight(F.col(key), F.col("_b"), seed))
    each = rows.groupBy(*keys, "_b").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w").cast("double")).alias("m"))
    return each.groupBy(*keys).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"), F.stddev_pop("m").alias("sd"))
