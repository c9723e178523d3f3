"""Small table operators: sets as text, cross tables, ratios of sums, bands, ranges, telling cases, samples, stored models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractscope.operators.panel import shuffle_key
from contractscope.sources.tables import write_version

#: Edges of amount bands, each of which holds its lower edge.
AMOUNT_EDGES, AMOUNT_BANDS = (40_000, 150_000, 1_000_000), ("<40k", "40k-150k", "150k-1M", ">=1M")


def joined_set(df: DataFrame, keys: Sequence[str], column: str, name: str, separator: str = ", ") -> DataFrame:
    """(keys, name): each key's distinct known values, sorted and joined; a key without any has an empty text.

    Values are made distinct before they are gathered, so a task holds a key's distinct values, not its rows.
    """
    each = df.select(*keys, F.col(column).cast("string").alias("_v")).distinct()
    return each.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_v")), separator).alias(name))


def any_of(df: DataFrame, keys: Sequence[str], **flags: Column) -> DataFrame:
    """Whether any row of a key meets each condition; null conditions count as not met."""
    return df.groupBy(*keys).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()])


def crosstab(df: DataFrame, label: str, column: str) -> DataFrame:
    """(label, value, n, share): rows of each label by value, null values too, and their share of the label's rows."""
    n = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def group_ratio(df: DataFrame, keys: Sequence[str], above: Sequence[str], below: str, name: str) -> DataFrame:
    """(keys, name): the sum of several columns over the sum of one; keys without a sum above 0 below are left out."""
    total = F.lit(0.0)
    for c in above:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sums = df.groupBy(*keys).agg(F.sum(total).alias("_a"), F.sum(below).alias("_b")).filter("_b > 0")
    return sums.select(*keys, (F.col("_a") / F.col("_b")).alias(name))


def amount_band(c: Column) -> Column:
    """Band of an amount; null for null."""
    out = F.lit(AMOUNT_BANDS[-1])
    for edge, name in zip(reversed(AMOUNT_EDGES), reversed(AMOUNT_BANDS[:-1]), strict=True):
        out = F.when(c < edge, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def within(df: DataFrame, closed: Mapping[str, tuple] | None = None, opened: Mapping[str, tuple] | None = None) -> DataFrame:
    """Rows whose values lie in all ranges, with or without the ends; None leaves an end open, and a null value is outside."""
    for ranges, with_ends in ((closed or {}, True), (opened or {}, False)):
        for c, (low, high) in ranges.items():
            df = df.filter(F.col(c).isNotNull())
            if low is not None:
                df = df.filter(F.col(c) >= low if with_ends else F.col(c) > low)
            if high is not None:
                df = df.filter(F.col(c) <= high if with_ends else F.col(c) < high)
    return df


def onto(features: DataFrame, base: DataFrame, key: str, zero: Sequence[str] = ()) -> DataFrame:
    """Every row of the base with its features; those in `zero` are 0 where there are none."""
    return features.join(base, key, "right").fillna(0, list(zero))


def telling_cases(df: DataFrame, key: str, score: str = "score", label: str = "label") -> DataFrame:
    """(case, key, score): the highest score, the positive of the lowest, the negative of the highest, and the row nearest to
    the median score; equal scores go by key. Nothing without a positive or without a negative."""
    s = F.col(score)
    middle = df.agg(F.percentile(score, F.lit(0.5)).alias("_m"))
    rows = df.filter(s.isNotNull()).join(F.broadcast(middle))
    first = lambda order, where=None: F.min(F.when(where, F.struct(order.alias("o"), F.col(key).alias("k"), s.alias("s"))) if where is not None else F.struct(order.alias("o"), F.col(key).alias("k"), s.alias("s")))
    cases = {"highest": first(-s), "hard_positive": first(s, F.col(label) == 1), "extreme_negative": first(-s, F.col(label) == 0), "median": first(F.abs(s - F.col("_m")))}
    made = rows.agg(*[c.alias(name) for name, c in cases.items()]).filter("hard_positive IS NOT NULL AND extreme_negative IS NOT NULL")
    return made.select(F.inline(F.array(*[F.struct(F.lit(name).alias("case"), F.col(f"{name}.k").alias(key), F.col(f"{name}.s").alias(score)) for name in cases])))


def sample_per_fold(df: DataFrame, key: str, n: int, fold: str = "fold", label: str = "label", seed: int = 42) -> DataFrame:
    """All labelled rows, and of each fold n unlabelled ones in pseudo-random order; tasks keep n rows a fold before they send them."""
    w = Window.partitionBy(fold).orderBy(shuffle_key(seed, key), key)
    some = df.filter(F.col(label).isNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    return df.filter(F.col(label).isNotNull()).unionByName(some)


def codes_or_minus_one(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Columns as learnt codes; null and unknown levels are -1."""

    def code(c: str) -> Column:
        if not levels[c]:
            return F.lit(-1)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in levels[c].items() for x in kv]), F.col(c).cast("string")), F.lit(-1))

    return df.withColumns({c: code(c) for c in columns})


# --- what is kept between runs ---


def save_models(models: DataFrame, folder: str, version: str) -> str:
    """Models, one row each, under a version of their own, which must be new; returns the path."""
    return write_version(models.coalesce(1), folder, version)


def load_models(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{version}")


def kept_rows(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows at a path, made and written first if there are none yet, so that later runs use the same.

    They are written beside the path and moved there when whole, so a run that breaks off leaves nothing behind.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    draft = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    make().write.parquet(draft)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    if not place(draft).getFileSystem(conf).rename(place(draft), place(path)):
        raise OSError(f"{draft} could not be moved to {path}")
    return spark.read.parquet(path)
