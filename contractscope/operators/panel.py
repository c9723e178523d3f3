"""Ordered operators: dense panels, filling, percentile ranks, folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_panel(entities: DataFrame, first: int, last: int, year: str = "anno") -> DataFrame:
    """Each entity with every year of a range; the range is a literal, so no join is needed."""
    return entities.withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def backward_fill(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], most: int = 10) -> DataFrame:
    """The next known value, if it is at most `most` steps of the order column away."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    out = df
    for c in columns:
        at = F.first(F.when(F.col(c).isNotNull(), F.col(order)), ignorenulls=True).over(w)
        out = out.withColumn(f"_{c}", F.when(at - F.col(order) <= most, F.first(c, ignorenulls=True).over(w)))
    return out.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def parent_proxy(df: DataFrame, parents: Mapping, key: str, order: str, columns: Sequence[str], last: int) -> DataFrame:
    """Up to `last`, an entity that another one was split from takes its known values, as far as they are known.

    parents names each such entity's parent; of these few entities only the parents' early rows are joined.
    """
    early = df.filter(F.col(key).isin(list(set(parents.values()))) & (F.col(order) <= last))
    other = early.select(F.col(key).alias("_parent"), F.col(order).alias("_order"), *[F.col(c).alias(f"_{c}") for c in columns])
    named = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    out = df.withColumn("_of", F.when(F.col(order) <= last, F.try_element_at(named, F.col(key)))).join(other, (F.col("_of") == F.col("_parent")) & (F.col(order) == F.col("_order")), "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_of", "_parent", "_order", *[f"_{c}" for c in columns])


def running_sum(counts: DataFrame, order: str, value: str, name: str, down: bool = False, parts: int = 64) -> DataFrame:
    """Add the sum of value over all rows up to each one in the order of a distinct number, without sorting in one task.

    Rows are cut into ranges of the order by approximate quantiles; each range is summed up by itself, and the sums of the
    ranges before it, at most `parts` numbers, are added.
    """
    edges = [e for e in counts.agg(F.percentile_approx(order, F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), F.lit(10_000))).first()[0] or []]
    edges = sorted(set(edges))
    place = F.lit(0)
    for i, e in enumerate(edges):
        place = F.when(F.col(order) > F.lit(e), F.lit(i + 1)).otherwise(place)
    dealt = counts.withColumn("_part", place)
    totals = {r["_part"]: r["s"] for r in dealt.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    before, so_far = {}, 0
    for k in sorted(totals, reverse=down):
        before[k], so_far = so_far, so_far + (totals[k] or 0)
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    w = Window.partitionBy("_part").orderBy(F.desc(order) if down else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn(name, F.sum(value).over(w) + offset[F.col("_part")]).drop("_part")


def percentile_rank(df: DataFrame, score: str, name: str = "percentile_rank", keys: Sequence[str] = ()) -> DataFrame:
    """Average rank over the number of scored rows, times 100; rows without a score keep a null rank.

    Ranks are summed up from one row per distinct score, so equal scores, however many, never meet in one task; without
    keys, the distinct scores are cut into ranges.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_c"))
    if keys:
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumns({"_upto": upto, "_all": F.sum("_c").over(Window.partitionBy(*keys))})
    else:
        counts = running_sum(counts, score, "_c", "_upto").withColumn("_all", F.lit(df.filter(F.col(score).isNotNull()).count()))
    ranks = counts.withColumn(name, (F.col("_upto") - (F.col("_c") - 1) / F.lit(2.0)) / F.col("_all") * 100)
    return df.join(ranks.drop("_c", "_upto", "_all"), [*keys, score], "left")


def share_below(df: DataFrame, reference: DataFrame, score: str, name: str = "share_below") -> DataFrame:
    """Percentage of reference scores strictly below each score; rows without a score keep a null share."""
    known = reference.filter(F.col(score).isNotNull())
    both = known.groupBy(score).agg(F.count("*").alias("_r")).unionByName(df.filter(F.col(score).isNotNull()).select(score).distinct().withColumn("_r", F.lit(0).cast("long")))
    merged = running_sum(both.groupBy(score).agg(F.sum("_r").alias("_r")), score, "_r", "_upto")
    n = known.count()
    table = merged.select(score, F.try_divide((F.col("_upto") - F.col("_r")) * 100.0, F.lit(n)).alias(name))
    return df.join(table, score, "left")


def risk_band(rank: Column) -> Column:
    """Fixed bands of the percentile rank: below 20, 50, 80, and the rest."""
    return F.when(rank < 20, "low").when(rank < 50, "medium").when(rank < 80, "high").otherwise("very high")


def shuffle_key(seed: int, *columns: str) -> Column:
    """A reproducible pseudo-random order: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified_folds(df: DataFrame, strata: Sequence[str], key: str, n: int = 4, seed: int = 2025, name: str = "fold", order: Column | None = None) -> DataFrame:
    """Round-robin folds in pseudo-random order within each stratum; `order` gives another such order, as hex digits.

    The order is cut by its first characters into 4096 stretches, so that a stratum of any size is numbered by many tasks;
    a stretch's first number comes from the counts of those before it, one row a stratum and stretch.
    """
    t = df.withColumn("_o", shuffle_key(seed, key) if order is None else order).withColumn("_b", F.substring("_o", 1, 3))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = t.groupBy(*strata, "_b").agg(F.count("*").alias("_c")).select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_b").alias("_x"), before.alias("_before"))
    numbered = t.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_o", key)))
    same = F.col("_b") == F.col("_x")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    made = numbered.join(counts, same).withColumn(name, ((F.col("_before") + F.col("_r") - 1) % n).cast("int"))
    return made.drop("_o", "_b", "_r", "_x", "_before", *[f"_s{i}" for i in range(len(strata))])


def nested_folds(levels: Sequence[DataFrame], strata: Sequence[str], key: str, n: int = 4, seed: int = 2025) -> DataFrame:
    """(key, fold): each level's rows that an inner level lacks get folds of their own; inner ones keep theirs."""
    out = None
    for level in levels:
        rest = level if out is None else level.join(out.select(key), key, "left_anti")
        made = stratified_folds(rest.select(key, *strata), strata, key, n, seed).select(key, "fold")
        out = made if out is None else out.unionByName(made)
    return out


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 2025) -> DataFrame:
    """n rows in pseudo-random, reproducible order."""
    return df.orderBy(shuffle_key(seed, key), key).limit(n)


def fold_balance(df: DataFrame, features: Sequence[str], fold: str = "fold") -> DataFrame:
    """(feature, balance): the largest distance of a fold's mean from the mean, in standard deviations."""
    long = df.unpivot([fold], list(features), "feature", "v")
    each = long.groupBy("feature", fold).agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.sum(F.col("v") * F.col("v")).alias("q"))
    whole = each.groupBy("feature").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"), F.sum("q").alias("q_all"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q_all") - F.col("s_all") * F.col("s_all") / F.col("n_all")) / (F.col("n_all") - 1)))
    return each.join(whole, "feature").groupBy("feature").agg(F.max(F.try_divide(F.abs(F.col("s") / F.col("n") - F.col("s_all") / F.col("n_all")), sd)).alias("balance"))


def balanced_folds(df: DataFrame, strata: Sequence[str], key: str, features: Sequence[str], n: int = 4, seed: int = 2025, tries: int = 30, good: float = 0.10) -> tuple[DataFrame, int, float]:
    """Folds of the first seed whose worst balance is good, else of the best seed; one aggregation job per seed."""
    best: tuple[DataFrame, int, float] | None = None
    for s in range(seed, seed + tries):
        folds = stratified_folds(df, strata, key, n, s)
        worst = fold_balance(folds, features).agg(F.max("balance")).first()[0] or 0.0
        if best is None or worst < best[2]:
            best = (folds, s, worst)
        if worst <= good:
            break
    return best
