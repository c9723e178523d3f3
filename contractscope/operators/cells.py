"""Rows of many fits gathered into cells of bins, so that a fit of trees sees all of its rows in one task of bounded size.

Trees see bins alone. A fit's edges are exact quantiles of its rows, read from the distinct values of each feature by ranges;
rows of one kind that share the bin of every feature are then counted by Spark, and a fit gets the counts. `rows` have
_key, label, the features as doubles, and _in, an array of 3 * fit + role for each fit that a row has a role in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles of a row in a fit: grown on, held out to tell when to stop, and held out to judge the fit by.
FIT, STOP, JUDGE = 0, 1, 2
#: About so many distinct values of a feature are sorted by one task, in at most so many ranges.
VALUES_A_TASK, MOST_RANGES = 20_000, 1024


def codes_of(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """(features x rows) the bin of each value: 0 where it is missing, else 1 and the number of edges below it."""
    return np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, side="left")) for c, e in zip(x.T, edges, strict=True)]) if x.shape[1] else np.zeros((0, len(x)), np.int64)


def values_of(coded: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """(rows x features) a value in each bin: the edge above it, NaN for missing ones; trees score it as any other there."""
    return np.stack([np.where(c == 0, np.nan, np.append(e, np.inf)[np.maximum(c, 1) - 1]) for c, e in zip(coded, edges, strict=True)], axis=1) if len(coded) else np.zeros((coded.shape[1], 0))


def cells_of(coded: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each cell, the cell of each row, rows of each): rows of one kind in the same bin of every feature share a cell."""
    key = kind.astype(np.int64)
    most = int(key.max(initial=0)) + 1
    for c in coded:
        size = int(c.max(initial=0)) + 1
        if most * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max(initial=0)) + 1
        key, most = key * size + c, most * size
    return np.unique(key, return_index=True, return_inverse=True, return_counts=True)[1:]


@dataclass
class Cells:
    """The cells of one fit: (features x cells) bins, and of each cell its label (NaN for unlabelled), role and number of rows."""

    edges: list[np.ndarray]
    coded: np.ndarray
    label: np.ndarray
    role: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame, edges: list[np.ndarray]) -> Cells:
        """From gathered() for one fit, in an order that depends on the cells alone."""
        pdf = pdf.sort_values(["role", "kind", "code"], kind="stable")
        coded = np.frombuffer(b"".join(pdf["code"]), ">u2").reshape(len(pdf), len(edges)).T.astype(np.int64)
        kind = pdf["kind"].to_numpy()
        return cls(edges, coded, np.where(kind == 2, np.nan, kind), pdf["role"].to_numpy(), pdf["n"].to_numpy())


def roles(*each: Column) -> Column:
    """_in, from 3 * fit + role or null for each fit."""
    return F.filter(F.array(*each), lambda m: m.isNotNull())


def fit_edges(rows: DataFrame, features: Sequence[str], bins: int = 64) -> dict[int, list[np.ndarray]]:
    """For each fit and feature the quantiles of the rows that it is grown on, as np.nanquantile has them.

    A fit's distinct values of a feature are cut into ranges; counts of ranges tell in which one a rank lies, and a range
    gives the values at its ranks. To the driver come counts of ranges and two values a quantile.
    """
    d, places = len(features), np.linspace(0, 1, bins + 1)[1:-1]
    grown = rows.select(F.filter("_in", lambda m: F.pmod(m, F.lit(3)) == FIT).alias("_in"), F.array(*features).alias("v"))
    long = grown.select("_in", F.posexplode("v").alias("feature", "value")).filter("value IS NOT NULL AND NOT isnan(value)")
    counts = long.select(F.explode(F.transform("_in", lambda m: F.floor(m / 3).cast("int"))).alias("fit"), "feature", "value").groupBy("fit", "feature", "value").agg(F.count("*").alias("n")).persist()
    try:
        most = counts.groupBy("fit", "feature").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        ranges = min(MOST_RANGES, -(-most // VALUES_A_TASK))
        at = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)]) if ranges > 1 else None
        cut = counts.groupBy("feature").agg((F.percentile_approx("value", at, F.lit(10_000)) if at is not None else F.array().cast("array<double>")).alias("cuts"))
        cuts = rows.sparkSession.createDataFrame([(r["feature"], sorted(set(r["cuts"]))) for r in cut.collect()], "feature int, cuts array<double>")
        placed = counts.join(F.broadcast(cuts), "feature").withColumn("range", F.size(F.filter("cuts", lambda e: e < F.col("value")))).drop("cuts")
        totals: dict[tuple[int, int], list] = {}
        for r in placed.groupBy("fit", "feature", "range").agg(F.sum("n").alias("n"), F.max(F.abs("value") < float("inf")).alias("finite")).collect():
            totals.setdefault((r["fit"], r["feature"]), []).append((r["range"], r["n"], r["finite"]))
        asked: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
        number = {}
        for (fit, f), found in totals.items():
            if not any(finite for *_, finite in found):
                continue
            number[fit, f] = n = sum(x for _, x, _ in found)
            low = np.floor(places * (n - 1)).astype(np.int64)
            ranks, before = np.unique([low, np.minimum(low + 1, n - 1)]), 0
            for k, x, _ in sorted(found):
                here = ranks[(ranks >= before) & (ranks < before + x)]
                if len(here):
                    asked[fit, f, k] = (before, here)
                before += x

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            fit, f, k = (int(pdf[c].iloc[0]) for c in ("fit", "feature", "range"))
            before, ranks = asked[fit, f, k]
            pdf = pdf.sort_values("value")
            return pd.DataFrame({"fit": fit, "feature": f, "rank": ranks, "value": pdf["value"].to_numpy()[np.searchsorted(np.cumsum(pdf["n"].to_numpy()), ranks - before, side="right")]})

        wanted = F.broadcast(rows.sparkSession.createDataFrame(list(asked), "fit int, feature int, range int"))
        picked = placed.join(wanted, ["fit", "feature", "range"], "left_semi").groupBy("fit", "feature", "range").applyInPandas(pick, "fit int, feature int, rank long, value double")
        value = {(r["fit"], r["feature"], r["rank"]): r["value"] for r in picked.collect()}
    finally:
        counts.unpersist()
    edges: dict[int, list[np.ndarray]] = {}
    for (fit, f), n in number.items():
        at = places * (n - 1)
        low = np.floor(at).astype(np.int64)
        a, b = (np.array([value[fit, f, int(r)] for r in some]) for some in (low, np.minimum(low + 1, n - 1)))
        t = at - low
        edges.setdefault(fit, [np.zeros(0) for _ in range(d)])[f] = np.unique(np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t)))
    return edges


def gathered(rows: DataFrame, features: Sequence[str], bins: int = 64) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """((fit, kind, role, code, n), edges of each fit): the number of rows of each cell; kind is the label, 2 for none.

    code has two bytes for each feature's bin. A fit has no more cells than its bins allow, however many rows there are.
    """
    names = list(features)
    found, none = fit_edges(rows, names, bins), [np.zeros(0)] * len(names)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, label = pdf[names].to_numpy(float), pdf["label"].to_numpy(float)
            kind = np.where(np.isnan(label), 2, label).astype(np.int64)
            row = np.repeat(np.arange(len(pdf)), [len(m) for m in pdf["_in"]])
            member = np.concatenate([*pdf["_in"], np.zeros(0, np.int64)]).astype(np.int64)
            for fit in np.unique(member // 3):
                of = member // 3 == fit
                here, role = row[of], member[of] % 3
                coded = codes_of(x[here], found.get(int(fit), none))
                first, _, n = cells_of(coded, 3 * kind[here] + role)
                packed = np.ascontiguousarray(coded[:, first].T.astype(">u2")).tobytes()
                wide = 2 * len(names)
                yield pd.DataFrame({"fit": int(fit), "kind": kind[here][first], "role": role[first], "code": [packed[i * wide : (i + 1) * wide] for i in range(len(first))], "n": n})

    coded = rows.select("label", "_in", *names).mapInPandas(code, "fit int, kind int, role int, code binary, n long")
    return coded.groupBy("fit", "kind", "role", "code").agg(F.sum("n").alias("n")), found
