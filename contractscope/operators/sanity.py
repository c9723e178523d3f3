"""Sanity checks as data: each rule says which rows it can judge and which of these break it; one pass counts them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """asked: rows that can be judged; broken: those of them that break the rule.

    The status is OK while at most `most` percent of the asked rows are broken, else `otherwise`; a rule without `most`
    only informs.
    """

    name: str
    asked: Column
    broken: Column
    most: float | None = None
    otherwise: str = "WARNING"

    def bad(self) -> Column:
        return F.coalesce(self.asked & self.broken, F.lit(False))


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, status, asked, broken, pct) of all rules, from one aggregation over one scan."""
    counts = df.agg(*[x for i, r in enumerate(rules) for x in (F.count_if(F.coalesce(r.asked, F.lit(False))).alias(f"a{i}"), F.count_if(r.bad()).alias(f"b{i}"))])
    rows = []
    for i, r in enumerate(rules):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        pct = F.when(a > 0, 100.0 * b / a).otherwise(0.0)
        status = F.lit("INFO") if r.most is None else F.when(pct <= r.most, "OK").otherwise(r.otherwise)
        rows.append(F.struct(F.lit(r.name).alias("rule"), status.alias("status"), a.alias("asked"), b.alias("broken"), pct.alias("pct")))
    return counts.select(F.inline(F.array(*rows)))


def samples(df: DataFrame, key: str, rules: Sequence[Rule], n: int = 10) -> DataFrame:
    """(rule, rank, key): for each rule the n smallest keys that break it; a null key is the smallest.

    A task keeps n keys a rule and sends no others; no row is copied or sorted before that.
    """
    names, kind = [r.name for r in rules], df.schema[key].dataType.simpleString()
    told = df.select(F.col(key).alias("_key"), *[r.bad().alias(f"b{i}") for i, r in enumerate(rules)])

    def first(keys: pa.Array) -> pa.Array:
        return keys.take(pc.array_sort_indices(keys, null_placement="at_start")[:n]) if len(keys) > n else keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pa.Array] = {}
        for batch in batches:
            keys = batch.column(0)
            for i in range(len(names)):
                found = keys.filter(batch.column(i + 1))
                if len(found):
                    kept[i] = first(pa.concat_arrays([kept[i], found]) if i in kept else found)
        for i, found in kept.items():
            yield pa.RecordBatch.from_arrays([found, pa.array([names[i]] * len(found), pa.string())], names=[key, "rule"])

    hit = told.mapInArrow(run, f"`{key}` {kind}, rule string")
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("rule").orderBy(key))).filter(F.col("rank") <= n).select("rule", "rank", key)


def contrasts(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(label, feature, n, mean, median) of each feature's known values among labelled rows."""
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["label"], list(features), "feature", "v")
    return long.groupBy("label", "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"))


def contract_rules() -> list[Rule]:
    """The checks of the wide table of contracts (audit_frame)."""
    c = F.col
    known = lambda *names: [*map(lambda n: c(n).isNotNull(), names)]
    both = lambda a, b: known(a)[0] & known(b)[0]
    bids = F.coalesce("numero_offerte_ammesse", F.lit(0.0)) + F.coalesce("numero_offerte_escluse", F.lit(0.0))
    off = F.abs(c("num_imprese_offerenti") - bids)
    told = c("num_imprese_offerenti").isNotNull() & (bids > 0)
    every = F.lit(True)
    return [
        Rule("SC-01 one row a contract", every, c("n_rows") > 1, 0.0, "ERROR"),
        Rule("SC-02 award not before tender", c("data_aggiudicazione_definitiva").isNotNull(), c("data_aggiudicazione_definitiva") < c("data_pubblicazione"), 0.0, "HANDLED"),
        Rule("SC-03 coherence can be told", every, c("delta_coerenza_pct").isNull(), 90.0),
        Rule("SC-03 coherence within 20%", c("delta_coerenza_pct").isNotNull(), c("delta_coerenza_pct") > 0.20),
        Rule("SC-03 coherence within 50%", c("delta_coerenza_pct").isNotNull(), c("delta_coerenza_pct") > 0.50),
        Rule("SC-05 security within the lot", c("sicurezza_oltre_lotto").isNotNull(), c("sicurezza_oltre_lotto") == 1, 1.0),
        Rule("SC-06a start before end", both("inizio", "termine"), c("inizio") > c("termine"), 1.0),
        Rule("SC-06b award before signing", both("data_stipula_contratto", "data_aggiudicazione_definitiva"), c("data_aggiudicazione_definitiva") > c("data_stipula_contratto"), 10.0),
        Rule("SC-09 lots and awards agree", both("n_lotti_componenti", "n_awards"), c("n_lotti_componenti") != c("n_awards")),
        Rule("SC-10 authority is known", c("ausa").isNotNull(), c("ausa_known").isNull(), 1.0),
        Rule("SC-11 security as in the budget", both("importo_sicurezza_bando", "sicurezza_base_asta"), F.abs(c("importo_sicurezza_bando") - c("sicurezza_base_asta")) > F.abs(c("importo_sicurezza_bando")) * 0.01),
        Rule("SC-12 lot as in the budget", both("importo_lotto", "somma_base_asta"), F.abs(c("importo_lotto") - c("somma_base_asta")) > F.abs(c("importo_lotto")) * 0.05),
        Rule("SC-13a awarded with award", c("esito") == "AGGIUDICATA", c("importo_aggiudicazione").isNull()),
        Rule("SC-13c condemned were awarded", c("label") == 1, c("esito").isin("DESERTA", "NON_AGGIUDICATA", "IN_CORSO") & ~F.coalesce(c("cod_esito").isin("1", "5"), F.lit(False)), 0.0),
        Rule("SC-OFFERTE bids add up", told, off != 0, 20.0),
        Rule("SC-OFFERTE bids within 2", told, off > 2),
        Rule("SC-OFFERTE bids within 10", told, off > 10),
        Rule("SC-VAR-1 variant after award", both("prima_variante", "data_aggiudicazione_definitiva"), c("prima_variante") < c("data_aggiudicazione_definitiva")),
    ]


def participant_rules() -> list[Rule]:
    """SC-07: the winners' fiscal codes are among the participants, for contracts that have any (participant_frame)."""
    return [Rule("SC-07 winner took part", F.col("has_participants") == 1, F.col("took_part").isNull(), 10.0)]


def participant_frame(winners: DataFrame, participants: DataFrame) -> DataFrame:
    """Rows of winners with a fiscal code, whether their contract has participants, and whether they are among these."""
    tidy = lambda df: df.select(F.trim("cig").alias("cig"), F.trim("codice_fiscale").alias("codice_fiscale")).filter("cig IS NOT NULL AND codice_fiscale IS NOT NULL")
    p = tidy(participants).distinct()
    return tidy(winners).join(p.withColumn("took_part", F.lit(1)), ["cig", "codice_fiscale"], "left").join(p.select("cig").distinct().withColumn("has_participants", F.lit(1)), "cig", "left")


def list_rules() -> list[Rule]:
    """SC-08: no contract is on both lists (list_frame)."""
    return [Rule("SC-08 on one list only", F.lit(True), F.col("lists") > 1, 0.0, "ERROR")]


def list_frame(condemned: DataFrame, acquitted: DataFrame) -> DataFrame:
    both = condemned.select(F.trim("cig").alias("cig"), F.lit(1).alias("list")).union(acquitted.select(F.trim("cig"), F.lit(0)))
    return both.groupBy("cig").agg(F.count_distinct("list").alias("lists"))
