"""Forensic indicators over contracts: effect sizes, digit law, bunching, red flags, missingness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractscope.functions.columns import first_digit, wilson
from contractscope.operators.metrics import by_score

#: Mean absolute deviations that separate the verdicts on the digit law.
DIGIT_VERDICTS = [(0.006, "close"), (0.012, "acceptable"), (0.015, "marginal")]


def cliffs_delta(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, delta): 2U/(mn) - 1 of positives against negatives, ties averaged; one job for all features."""
    long = df.filter("label IS NOT NULL").unpivot(["label"], list(features), "feature", "score").filter("score IS NOT NULL")
    t = by_score(long, ["feature"])
    below = F.col("n_all") - F.col("fp")
    return t.groupBy("feature").agg((2 * F.try_divide(F.sum(F.col("p") * (below + F.col("n") / 2)), F.max(F.col("p_all") * F.col("n_all")).cast("double")) - 1).alias("delta"))


def log2_ratio(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(flag, p_share, n_share, log2_ratio): null where a share is 0."""
    long = df.filter("label IS NOT NULL").unpivot(["label"], list(flags), "flag", "v")
    t = long.groupBy("flag").agg(F.avg(F.when(F.col("label") == 1, F.col("v"))).alias("p_share"), F.avg(F.when(F.col("label") == 0, F.col("v"))).alias("n_share"))
    return t.withColumn("log2_ratio", F.when((F.col("p_share") > 0) & (F.col("n_share") > 0), F.log2(F.col("p_share") / F.col("n_share"))))


def benford(df: DataFrame, amount: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, digit, n, share, expected): shares of first digits in percent against the digit law."""
    each = df.filter(F.col(amount) > 0).withColumn("digit", first_digit(F.col(amount))).filter("digit BETWEEN 1 AND 9").groupBy(*keys, "digit").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return each.withColumns({"share": F.col("n") / F.sum("n").over(w) * 100, "expected": F.log10(1 + 1 / F.col("digit")) * 100})


def benford_verdict(shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, mad, verdict)."""
    t = shares.groupBy(*keys).agg(F.sum("n").alias("n"), (F.avg(F.abs(F.col("share") - F.col("expected"))) / 100).alias("mad"))
    verdict = F.lit("nonconforming")
    for limit, name in reversed(DIGIT_VERDICTS):
        verdict = F.when(F.col("mad") < limit, name).otherwise(verdict)
    return t.withColumn("verdict", verdict)


def bunching(df: DataFrame, amount: str, thresholds: Sequence[float], window: float = 0.1) -> DataFrame:
    """(threshold, below, above, ratio): counts within the window below and above each threshold; one pass."""
    x = F.col(amount)
    parts = []
    for t in thresholds:
        parts.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if((x > t * (1 - window)) & (x <= t)).alias("below"), F.count_if((x > t) & (x <= t * (1 + window))).alias("above")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a")).withColumn("ratio", F.col("below") / F.greatest(F.col("above"), F.lit(1)))


def red_flags(df: DataFrame, group: str) -> DataFrame:
    """Add five flags and their sum cri: single bid, no open procedure, short window, urgency, low discount.

    "Short" and "low" compare with the group's median window and lower quartile of discounts, exact percentiles that
    are computed once per group and sent to every task, so that rows stay where they are: a group is a category of which
    there are few, and a join by it would gather a category's rows in one task. Unknown values raise no flag.
    """
    stats = df.groupBy(F.col(group).alias("_g")).agg(F.percentile("finestra_offerta_giorni", F.lit(0.5)).alias("_w"), F.percentile("ribasso_aggiudicazione", F.lit(0.25)).alias("_q"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    t = df.join(F.broadcast(stats), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    t = t.withColumns({"cri_single": flag(F.col("num_imprese_offerenti") <= 1), "cri_nonopen": flag(F.col("tipo_scelta_4cls") != "APERTA"), "cri_short": flag(F.col("finestra_offerta_giorni") < F.col("_w")), "cri_urgency": flag(F.col("flag_urgenza") == 1), "cri_low": flag(F.col("ribasso_aggiudicazione") < F.col("_q"))})
    return t.withColumn("cri", sum((F.col(c) for c in ("cri_nonopen", "cri_short", "cri_urgency", "cri_low")), F.col("cri_single"))).drop("_w", "_q")


def bid_zone(bidders: Column, discount: Column, spread: Column) -> Column:
    """Zone of a tender by bidders, discount and spread of discounts."""
    return F.when((bidders <= 2) & (discount < 5), "monopoly").when((bidders >= 5) & (spread < 2), "cover bidding").when((bidders >= 5) & (spread >= 2), "competitive").otherwise("between")


def severity(*flags: Column) -> Column:
    """Number of raised flags; unknown ones count as not raised."""
    out = F.lit(0)
    for f in flags:
        out = out + F.coalesce((f == 1).cast("int"), F.lit(0))
    return out


def share_with_interval(df: DataFrame, keys: Sequence[str], hit: Column, least: int = 10) -> DataFrame:
    """(keys, n, hits, share, lower, upper) of groups with at least `least` rows."""
    t = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).filter(F.col("n") >= least)
    low, high = wilson(F.col("hits"), F.col("n"))
    return t.withColumns({"share": F.col("hits") / F.col("n"), "lower": low, "upper": high})


def missing_rates(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, rate): share of nulls; all columns in one aggregation."""
    t = df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return t.unpivot(list(keys), list(columns), "column", "rate")


def missingness_signal(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, pct_p, pct_n, delta): percent of nulls among positives and among negatives, and their difference in points,
    for features that either lacks at times; one aggregation."""
    of = lambda c, v: F.avg(F.when(F.col(label) == v, F.col(c).isNull().cast("double") * 100))
    made = df.agg(*[x for c in columns for x in (of(c, 1).alias(f"p_{c}"), of(c, 0).alias(f"n_{c}"))])
    rows = made.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"p_{c}").alias("pct_p"), F.col(f"n_{c}").alias("pct_n")) for c in columns])))
    return rows.withColumn("delta", F.col("pct_p") - F.col("pct_n")).filter("delta IS NOT NULL AND (pct_p > 0 OR pct_n > 0)")


def funnel(m1: DataFrame, m2: DataFrame, m3: DataFrame, key: str) -> DataFrame:
    """Rows of each nested set and of those that leave after it, by anti joins."""
    out = m1.agg(F.lit("M1").alias("phase"), F.count("*").alias("n"))
    out = out.unionByName(m2.agg(F.lit("M2").alias("phase"), F.count("*").alias("n"))).unionByName(m3.agg(F.lit("M3").alias("phase"), F.count("*").alias("n")))
    only1 = m1.join(m2.select(key), key, "left_anti").agg(F.lit("M1 only").alias("phase"), F.count("*").alias("n"))
    only2 = m2.join(m3.select(key), key, "left_anti").agg(F.lit("M2 only").alias("phase"), F.count("*").alias("n"))
    return out.unionByName(only1).unionByName(only2)


def gower_neighbours(df: DataFrame, key: str, numbers: Sequence[str], classes: Sequence[str], k: int = 15, queries: DataFrame | None = None, per_block: int = 2000) -> DataFrame:
    """(key, rank, other, distance): k nearest rows of df by Gower distance for every row of `queries` (of df, if not given).

    The query set is taken in blocks of about per_block rows, each of which is sent to all tasks; rows are dealt by key to as
    many tasks as run at once. A task compares a block with a batch of its rows as one matrix, of which only what is no
    farther than a query's k-th distance so far is looked at, and gives k rows a query. Distance: the mean over features of the difference over
    the range, and of 0 or 1 for classes, where two nulls are equal; a null number counts as a whole range. Equal distances
    go by key.
    """
    low = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in numbers]).first() if numbers else {}
    span = np.array([float((low[c]["b"] - low[c]["a"]) if low[c]["b"] is not None else 0.0) or 1.0 for c in numbers])
    names = [key, *numbers, *classes]
    asked = (queries if queries is not None else df).select(*names)
    n_blocks = max(1, -(-asked.count() // per_block))
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(*names).repartition(df.sparkSession.sparkContext.defaultParallelism, key)

    def values(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        return pdf[list(numbers)].to_numpy(float) / span if numbers else np.zeros((len(pdf), 0)), [pdf[c].astype(object).where(pdf[c].notna(), None).to_numpy() for c in classes]

    def nearest(block: list[tuple]):
        q = pd.DataFrame(block, columns=names)
        qx, qc = values(q)
        ids = q[key].to_numpy()
        places = [{u: i for i, u in enumerate(dict.fromkeys(c))} for c in qc]
        asked_codes = [np.array([place[u] for u in c], np.int64) for c, place in zip(qc, places, strict=True)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = [(np.zeros(0, ids.dtype), np.zeros(0))] * len(q)
            most = np.full(len(q), np.inf)  # the k-th distance so far
            for pdf in batches:
                x, c = values(pdf)
                others = pdf[key].to_numpy()
                codes = [np.array([place.get(u, -1) for u in some], np.int64) for some, place in zip(c, places, strict=True)]
                step = max(1, (1 << 21) // max(1, len(pdf)))
                for a in range(0, len(q), step):
                    z = min(len(q), a + step)
                    d = np.zeros((z - a, len(pdf)))
                    for j in range(len(numbers)):
                        gap = np.abs(x[:, j] - qx[a:z, j, None])
                        d += np.where(np.isnan(gap), 1.0, gap)
                    for there, here in zip(codes, asked_codes, strict=True):
                        d += there != here[a:z, None]
                    d /= len(numbers) + len(classes)
                    for m in np.flatnonzero(np.isin(others, ids[a:z])):
                        d[ids[a:z] == others[m], m] = np.inf
                    bound = most[a:z]
                    if len(pdf) > k and np.isinf(bound).any():
                        bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
                    rows, cols = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
                    edges = np.flatnonzero(np.diff(rows)) + 1
                    for some in np.split(np.arange(len(rows)), edges) if len(rows) else []:
                        i = a + rows[some[0]]
                        other = np.concatenate([best[i][0], others[cols[some]]])
                        far = np.concatenate([best[i][1], d[rows[some], cols[some]]])
                        first = np.argsort(other, kind="stable")
                        first = first[np.argsort(far[first], kind="stable")][:k]
                        best[i] = (other[first], far[first])
                        if len(first) == k:
                            most[i] = far[first[-1]]
            sizes = [len(o) for o, _ in best]
            if sum(sizes):
                yield pd.DataFrame({key: np.repeat(ids, sizes), "other": np.concatenate([o for o, _ in best if len(o)]), "distance": np.concatenate([f for _, f in best])})

        return run

    out = None
    for b in range(n_blocks):
        block = [tuple(r) for r in (asked.filter(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == b) if n_blocks > 1 else asked).collect()]
        found = slim.mapInPandas(nearest(block), f"`{key}` {kind}, other {kind}, distance double")
        w = Window.partitionBy(key).orderBy("distance", "other")
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", "other", "distance")
        out = found if out is None else out.unionByName(found)
    return out
