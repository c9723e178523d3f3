"""One row per key: picking, deduplication, attaching and set operations, all as windows, joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_one(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should end in a column that breaks ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return pick_one(df, keys, F.col(ordinal).asc_nulls_last())


def dedup_latest(df: DataFrame, keys: Sequence[str], moment: str, *ties: Column) -> DataFrame:
    return pick_one(df, keys, F.col(moment).desc_nulls_last(), *ties)


#: Fixed value: about so many rows of awards are sorted by one task.
ROWS_A_TASK = 250_000


def pick_award(df: DataFrame, targets: DataFrame | None = None, *ties: Column, n_rows: int | None = None) -> DataFrame:
    """One award per cig: the known target award if there is one, else the earliest that is no re-award, else the earliest.

    Ties go by the column `_row`, the place in the file, if there is one, then by award id. With n_rows, the number of
    awards, they are dealt to so many tasks that each sorts a bounded number, and targets are merged, not sent to every task.
    """
    if n_rows is not None:
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_A_TASK))
        df = df.repartition(parts, "cig")
        targets = targets.repartition(parts, "cig") if targets is not None else None
    tie = [F.col("_row").asc_nulls_last()] if "_row" in df.columns else []
    if targets is not None:
        known = targets.select("cig", F.col("id_aggiudicazione").alias("_target")).distinct()
        df = df.join(known.hint("merge") if n_rows is not None else known, "cig", "left")
    else:
        df = df.withColumn("_target", F.lit(None).cast("string"))
    rank = F.when(F.trim("id_aggiudicazione") == F.col("_target"), 0).when(F.coalesce(F.trim("cod_modo_riaggiudicazione"), F.lit("")).isin("", "nan"), 1).otherwise(2)
    picked = pick_one(df.withColumn("_rank", rank), ["cig"], F.col("_rank"), F.col("data_aggiudicazione_definitiva").asc_nulls_last(), *tie, F.col("id_aggiudicazione"), F.col("cod_modo_riaggiudicazione"), *ties)
    return picked.drop("_rank", "_target")


def first_by_priority(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str], none: Sequence[str] = ()) -> DataFrame:
    """For each key the value that stands first in `order`; those in `none` become null. Partial aggregation, no sort."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    best = df.filter(place > 0).groupBy(*keys).agg(F.min_by(column, place).alias(column))
    return best.withColumn(column, F.when(~F.col(column).isin(list(none)), F.col(column))) if none else best


def attach(base: DataFrame, *features: DataFrame, on: str = "cig") -> DataFrame:
    """Left join of tables that are unique in the key; columns the base already has are replaced."""
    for f in features:
        new = [c for c in f.columns if c != on]
        base = base.drop(*[c for c in new if c in base.columns]).join(f, on, "left")
    return base


def coalesce_lookup(base: DataFrame, table: DataFrame, keys: Sequence[tuple[str, str]], value: str, null_matches: bool = False) -> DataFrame:
    """value of the first key pair (base column, table column) that has a match; null keys match only if asked for.

    For each pair the table is first reduced to one row per key, so the base keeps its rows.
    """
    out, parts = base, []
    for i, (left, right) in enumerate(keys):
        one = table.groupBy(F.col(right).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        one = one if null_matches else one.filter(F.col(f"_k{i}").isNotNull())
        same = F.col(left).eqNullSafe(F.col(f"_k{i}")) if null_matches else F.col(left) == F.col(f"_k{i}")
        out = out.join(one, same, "left").drop(f"_k{i}")
        parts.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*parts)).drop(*[f"_v{i}" for i in range(len(keys))])


def latest_not_after(base: DataFrame, table: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """The table's row of the same year, else of its latest year, for each row of base (which has a column `_id`)."""
    other = table.withColumnRenamed(year, "_year")
    joined = base.join(other, list(keys), "left")
    return pick_one(joined, ["_id"], (F.col("_year") == F.col(year)).desc_nulls_last(), F.col("_year").desc_nulls_last()).drop("_year")


def without(df: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(others.select(*on).distinct(), list(on), "left_anti")


def present(df: DataFrame, others: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Add a 0/1 flag whether the key is among the others."""
    marked = others.select(*on).distinct().withColumn(name, F.lit(1))
    return df.join(marked, list(on), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def first_wins(*frames: DataFrame, on: Sequence[str]) -> DataFrame:
    """All frames one below the other; of a key only the rows of the earliest frame that has it, and of these one."""
    tagged = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    rest = [F.col(c) for c in frames[0].columns if c not in on]
    return pick_one(out, on, F.col("_from"), *rest).drop("_from")


def unless_overridden(df: DataFrame, bad: Column, saved: DataFrame, on: str) -> DataFrame:
    """Rows that aren't bad, and bad ones whose key is among the saved."""
    lost = df.filter(F.coalesce(bad, F.lit(False))).select(on).distinct().join(saved.select(on).distinct(), on, "left_anti")
    return df.join(lost, on, "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
