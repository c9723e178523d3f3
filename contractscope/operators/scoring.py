"""Scoring of uploaded contracts: one model for each stage and set of known features, ranks against all reference rows.

A row's stage is the latest of which it knows a feature; its signature is the set of features up to that stage that it
knows. Rows of one signature share a model, which is fitted on the stage's labelled rows and a bounded sample of its
unlabelled ones, and are ranked among the scores that this model gives to every row of the stage's reference table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractscope.operators.boost import Trees, drawn_share, fit_one, reader
from contractscope.operators.panel import risk_band

#: Least and largest number of unlabelled rows of a fit.
LEAST_U, MOST_U = 3_000, 50_000


def level_codes(df: DataFrame, columns: Sequence[str], most: int = 10_000) -> dict[str, dict[str, int]]:
    """For each column its levels' codes, by alphabetical order from 0 on; more levels than `most` are an error."""
    out = {}
    for c in columns:
        levels = sorted(r[0] for r in df.filter(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(most + 1).collect())
        if len(levels) > most:
            raise ValueError(f"{c} has more than {most} levels")
        out[c] = {v: i for i, v in enumerate(levels)}
    return out


def encoded(df: DataFrame, features: Sequence[str], codes: Mapping[str, Mapping[str, int]]) -> list[Column]:
    """Features as doubles: codes of known levels, null for new ones; other features as numbers, null where they are none."""

    def one(c: str) -> Column:
        if c not in codes:
            return F.col(c).cast("string").try_cast("double") if df.schema[c].dataType.simpleString() in ("string", "boolean") else F.col(c).cast("double")
        table = F.create_map(*[F.lit(x) for kv in codes[c].items() for x in kv]) if codes[c] else None
        return F.try_element_at(table, F.col(c).cast("string")).cast("double") if table is not None else F.lit(None).cast("double")

    return [one(c).alias(c) for c in features]


def u_size(positives: int, prior: float) -> int:
    """Unlabelled rows of a fit: positives over the prior, within fixed limits."""
    return int(min(MOST_U, max(LEAST_U, round(positives / prior))))


def with_signature(df: DataFrame, registry: Mapping[int, Sequence[str]]) -> DataFrame:
    """Add stage and signature: the known features up to the stage, as a text of 0 and 1 in the registry's order."""
    stages = sorted(registry)
    known = lambda k: [F.col(c).isNotNull() for c in registry[k]]
    stage = F.lit(stages[0])
    for k in stages[1:]:
        has = F.lit(False)
        for c in known(k):
            has = has | c
        stage = F.when(has, F.lit(k)).otherwise(stage)
    t = df.withColumn("stage", stage)
    bits = [F.when((F.col("stage") >= k) & F.col(c).isNotNull(), "1").otherwise("0") for k in stages for c in registry[k]]
    return t.withColumn("signature", F.concat(*bits))


def fit_signatures(signatures: DataFrame, reference: Mapping[int, DataFrame], registry: Mapping[int, Sequence[str]], codes: Mapping[str, Mapping[str, int]], prior: float, gamma: float, boot: int = 0, seed: int = 42, **options) -> DataFrame:
    """(stage, signature, bag, model): one fit for each signature (bag 0), and `boot` more on rows drawn with replacement.

    Labelled rows all take part; unlabelled ones are drawn by a hash, about u_size of them. A fit is one task.
    """
    names = [c for k in sorted(registry) for c in registry[k]]
    parts = []
    for k, table in reference.items():
        here = [c for s in sorted(registry) if s <= k for c in registry[s]]
        n = table.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label").isNull()).alias("u")).first()
        drawn = drawn_share(min(1.0, u_size(n["p"], prior) / n["u"]) if n["u"] else 1.0, F.col("_id"), F.lit(seed))
        rows = table.filter(F.col("label").isNotNull() | drawn).select("_id", F.col("label").cast("double").alias("label"), *encoded(table, here, codes), *[F.lit(None).cast("double").alias(c) for c in names if c not in here])
        parts.append(rows.withColumn("stage", F.lit(k)))
    sample = parts[0]
    for more in parts[1:]:
        sample = sample.unionByName(more)
    asked = signatures.select("stage", "signature").distinct().withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(boot))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        signature, bag = pdf["signature"].iloc[0], int(pdf["bag"].iloc[0])
        pdf = pdf.sort_values("_id", kind="stable")
        used = [c for c, b in zip(names, signature, strict=True) if b == "1"]
        x, label = pdf[used].to_numpy(float), pdf["label"].to_numpy(float)
        if bag:
            rng = np.random.default_rng([seed, bag])
            kinds = (np.flatnonzero(k) for k in (label == 1, label == 0, np.isnan(label)))
            rows = np.concatenate([rng.choice(k, len(k)) for k in kinds if len(k)])
            x, label = x[rows], label[rows]
        made = fit_one("nnpu", x, label, gamma, prior, seed + bag, **options) if used else Trees()
        return pd.DataFrame({"stage": [int(pdf["stage"].iloc[0])], "signature": [signature], "bag": [bag], "model": [made.text()]})

    return asked.join(sample, "stage").groupBy("signature", "bag").applyInPandas(fit, "stage int, signature string, bag int, model string")


def _scorer(models: dict[tuple[int, str], dict[int, str]]):
    """(stage, signature, bag, x) -> scores, with each model read once a worker."""

    def score(stage: int, signature: str, bag: int, x: np.ndarray) -> np.ndarray:
        at = [i for i, b in enumerate(signature) if b == "1"]
        return 1 / (1 + np.exp(-np.clip(reader(models[stage, signature][bag]).raw(x[:, at]), -40, 40)))

    return score


def score_uploads(uploads: DataFrame, key: str, reference: Mapping[int, DataFrame], registry: Mapping[int, Sequence[str]], classes: Sequence[str] = (), prior: float = 0.02, gamma: float = 1.0, boot: int = 0, per_block: int = 1_000_000, **options) -> DataFrame:
    """(key, stage, signature, score, rank_pct, band), and with boot the 5th and 95th percentile of rank_pct over refits.

    rank_pct is the share of the stage's reference rows with a lower score under the same model, times 100. reference has
    each stage's table with _id, label and the features of its stages; `classes` are the features that are names, coded by
    the reference's levels. Uploaded features may be text, as read from CSV; null, or what is no number where a number is
    meant, counts as unknown. A row that knows nothing is ranked by a constant. Repeated keys have a row each.

    Reference rows are scored where they lie; a task counts how many fall between the uploaded scores of each signature,
    which are sent to it in blocks of at most about per_block distinct scores, so nothing of the reference's size is
    shuffled. A table of a model's cells has no more scores than cells, so passes over the reference then don't grow with
    the uploads.
    """
    spark = uploads.sparkSession
    last = max(registry)
    names = [c for k in sorted(registry) for c in registry[k]]
    codes = level_codes(reference[last], classes)
    numbers = dict(zip(names, encoded(uploads, names, codes), strict=True))
    # a name that the reference lacks is known, though its code is not
    told = uploads.select(key, *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) if c in codes else numbers[c] for c in names])
    rows = with_signature(told, registry).select(F.monotonically_increasing_id().alias("_row"), key, "stage", "signature", *encoded(told, names, codes))
    rows = rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows.persist()
    found: dict[tuple[int, str], dict[int, str]] = {}
    for r in fit_signatures(rows, reference, registry, codes, prior, gamma, boot, **options).collect():
        found.setdefault((r["stage"], r["signature"]), {})[r["bag"]] = r["model"]
    models = spark.sparkContext.broadcast(found)
    bags = list(range(boot + 1))

    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(models.value)
        for pdf in batches:
            for (stage, signature), some in pdf.groupby(["stage", "signature"]):
                x = some[names].to_numpy(float)
                for bag in bags:
                    yield pd.DataFrame({"_row": some["_row"], "stage": stage, "signature": signature, "bag": bag, "score": score(stage, signature, bag, x)})

    scored = rows.mapInPandas(targets, "_row long, stage int, signature string, bag int, score double")
    scored = scored.checkpoint() if spark.sparkContext.getCheckpointDir() else scored.persist()
    alike = scored.select("stage", "signature", "bag", "score").distinct()
    alike = alike.checkpoint() if spark.sparkContext.getCheckpointDir() else alike.persist()
    n_blocks = max(1, -(-alike.count() // per_block))
    shares = None
    for b in range(n_blocks):
        mine = alike.filter(F.pmod(F.xxhash64("signature", "bag", "score"), F.lit(n_blocks)) == b) if n_blocks > 1 else alike
        edges: dict[int, list[tuple[str, int, np.ndarray]]] = {}
        for r in mine.groupBy("stage", "signature", "bag").agg(F.array_sort(F.collect_list("score")).alias("e")).collect():
            edges.setdefault(r["stage"], []).append((r["signature"], r["bag"], np.array(r["e"])))
        sent = spark.sparkContext.broadcast(edges)
        for stage in edges:
            table = reference[stage]
            here = [c for s in sorted(registry) if s <= stage for c in registry[s]]
            ref = table.select(*encoded(table, here, codes), *[F.lit(None).cast("double").alias(c) for c in names if c not in here]).select(*names)

            def place(batches: Iterator[pd.DataFrame], stage: int = stage, sent=sent) -> Iterator[pd.DataFrame]:
                score = _scorer(models.value)
                counts = [np.zeros(len(e) + 1, np.int64) for _, _, e in sent.value[stage]]
                for pdf in batches:
                    x = pdf[names].to_numpy(float)
                    for (signature, bag, e), c in zip(sent.value[stage], counts, strict=True):
                        c += np.bincount(np.searchsorted(e, score(stage, signature, bag, x), side="right"), minlength=len(e) + 1)
                for (signature, bag, e), c in zip(sent.value[stage], counts, strict=True):
                    at = np.flatnonzero(c)
                    yield pd.DataFrame({"signature": signature, "bag": bag, "place": at, "rows": c[at]})

            counted = ref.mapInPandas(place, "signature string, bag int, place long, rows long").groupBy("signature", "bag", "place").agg(F.sum("rows").alias("rows"))
            below: list[tuple] = []
            got: dict[tuple[str, int], dict[int, int]] = {}
            for r in counted.collect():  # no more rows than edges were sent
                got.setdefault((r["signature"], r["bag"]), {})[r["place"]] = r["rows"]
            for signature, bag, e in edges[stage]:
                c = np.zeros(len(e) + 1, np.int64)
                for at, n in got.get((signature, bag), {}).items():
                    c[at] = n
                total = max(1, c.sum())
                below += [(stage, signature, bag, float(s), 100.0 * float(k) / float(total)) for s, k in zip(e, np.cumsum(c)[:-1], strict=True)]
            share = spark.createDataFrame(pd.DataFrame(below, columns=["stage", "signature", "bag", "score", "rank_pct"]), "stage int, signature string, bag int, score double, rank_pct double")
            if n_blocks > 1 and spark.sparkContext.getCheckpointDir():
                share = share.checkpoint()  # the driver keeps one block at a time
            shares = share if shares is None else shares.unionByName(share)
    ranked = scored.join(shares, ["stage", "signature", "bag", "score"]) if shares is not None else scored.withColumn("rank_pct", F.lit(None).cast("double"))
    point = ranked.filter("bag = 0").select("_row", "stage", "signature", "score", "rank_pct", risk_band(F.col("rank_pct")).alias("band"))
    if boot:
        limits = ranked.filter("bag > 0").groupBy("_row").agg(F.percentile("rank_pct", F.lit(0.05)).alias("rank_low"), F.percentile("rank_pct", F.lit(0.95)).alias("rank_high"))
        point = point.join(limits, "_row")
    return rows.select("_row", key).join(point, "_row").drop("_row")

