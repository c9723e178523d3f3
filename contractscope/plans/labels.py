"""Outcome labels from dated rulings: clean, deduplicate, consolidate, join with appeals, apply precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractscope.functions.columns import moment, split_ids, tidy, tidy_outcome, uid, valid_id, year_in
from contractscope.operators.rows import dedup_latest, pick_one

#: Normalised outcomes of rulings. Won, for judgments and for orders.
WON_JUDGMENT = ["accoglie", "accoglie il ricorso", "accoglie sui motivi aggiunti", "accoglie parzialmente", "accolto", "accolto parzialmente", "accolto parzialmente nei termini in motivazione", "dichiara nullita", "dichiara la nullita", "annulla", "annulla in parte"]
WON_ORDER = ["accoglie", "accoglie il ricorso", "accoglie parzialmente", "accoglie parzialmente il ricorso"]
#: Lost, for judgments and for orders.
LOST_JUDGMENT = ["respinge", "respinge il ricorso", "respinge sui motivi aggiunti", "respinge nel merito", "respinto", "respinto nel merito", "dichiara inammissibile", "dichiara inammissibile il ricorso", "dichiara irricevibile", "dichiara irricevibile il ricorso", "dichiara improcedibile", "dichiara improcedibile il ricorso", "dichiara estinto", "dichiara estinto il ricorso", "dichiara perenzione", "da in perenzione", "perenzione"]
LOST_ORDER = ["respinge", "respinge il ricorso", "respinge la domanda cautelare", "respinge la domanda", "rigetta", "rigetta la domanda cautelare"]
#: Second-instance outcomes that undo a won first instance, and those that leave it open.
UNDONE = ["respinge", "respinge il ricorso", "respinge l appello", "dichiara improcedibile", "dichiara improcedibile l appello", "dichiara inammissibile", "dichiara inammissibile l appello"]
OPEN = ["annulla con rinvio", "rimette al tar", "sospende il giudizio"]


def second_instance(seat):
    """Whether a seat is the council of state."""
    s = F.upper(F.trim(seat))
    return F.coalesce(F.contains(s, F.lit("CONSIGLIO DI STATO")) | (s == "CDS") | F.startswith(s, F.lit("CDS ")), F.lit(False))


def clean_appeals(raw: DataFrame) -> DataFrame:
    """(cig, uid) of appeals: cells with several identifiers are exploded, invalid identifiers dropped."""
    t = raw.withColumn("cig", F.explode_outer(split_ids(F.col("CODICE_CIG")))).withColumn("cig", valid_id(F.col("cig")))
    t = t.withColumns({"seat": tidy(F.col("NOME_SEDE")), "no": tidy(F.col("NUMERO_RICORSO")), "year": F.col("ANNO_DEPOSITO_RICORSO").try_cast("int")})
    return t.filter("cig IS NOT NULL AND no IS NOT NULL").select("cig", uid(F.col("seat"), F.col("year"), F.col("no")).alias("uid"), second_instance(F.col("seat")).alias("second")).distinct()


def clean_rulings(raw: DataFrame, kind: str) -> DataFrame:
    """(uid, outcome, published, second, kind): the year comes from its column, the filing date or the publication."""
    year = F.coalesce(F.col("ANNO_DEPOSITO_RICORSO").try_cast("int"), year_in(F.col("DATA_DEPOSITO_RICORSO")), F.col("ANNO_PUBBLICAZIONE").try_cast("int"))
    seat, no = tidy(F.col("NOME_SEDE")), tidy(F.col("NUMERO_RICORSO"))
    t = raw.select(uid(seat, year, no).alias("uid"), tidy_outcome(F.col("ESITO_PROVVEDIMENTO")).alias("outcome"), moment(F.col("DATA_PUBBLICAZIONE"), ("dd/MM/yyyy", "yyyy-MM-dd")).alias("published"), second_instance(seat).alias("second"), F.lit(kind).alias("kind"), no.alias("_no"))
    return t.filter("_no IS NOT NULL").drop("_no")


def latest(rulings: DataFrame) -> DataFrame:
    return dedup_latest(rulings, ["uid"], "published", F.col("outcome"))


def council_verdicts(rulings: DataFrame, appeals: DataFrame) -> DataFrame:
    """(cig, verdict): of each cig's latest second-instance ruling: undone, open or confirmed."""
    t = appeals.join(rulings.filter("second"), "uid")
    last = pick_one(t, ["cig"], F.col("published").desc_nulls_last(), F.col("uid"), F.col("outcome"))
    return last.select("cig", F.when(F.col("outcome").isin(UNDONE), "undone").when(F.col("outcome").isin(OPEN), "open").otherwise("confirmed").alias("verdict"))


def case_states(judgments: DataFrame, orders: DataFrame, reversal: bool = True) -> DataFrame:
    """(uid, won, lost, council): one grouping of all rulings by case.

    Of each kind the latest first-instance ruling counts, of equal dates the first by outcome; an order counts as far as no
    judgment says the same. council is the latest second-instance judgment as (no date, date reversed, uid, outcome), of
    which the smallest is the latest.
    """
    age = [F.col("published").isNull(), F.coalesce(-F.unix_micros("published"), F.lit(0))]
    every = judgments.unionByName(orders)
    of = lambda kind: F.min(F.when((F.col("kind") == kind) & ~F.col("second"), F.struct(*age, "outcome")))["outcome"]
    asked = F.col("second") & (F.col("kind") == "judgment")
    if not reversal:
        asked = asked & F.col("outcome").isin(WON_JUDGMENT)
    council = F.min(F.when(asked, F.struct(age[0].alias("n"), age[1].alias("d"), F.col("uid").alias("uid"), F.col("outcome").alias("outcome"))))
    t = every.groupBy("uid").agg(of("judgment").alias("j"), of("order").alias("o"), council.alias("council"))
    among = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    return t.select("uid", (among("j", WON_JUDGMENT) | among("o", WON_ORDER)).alias("won"), (among("j", LOST_JUDGMENT) | among("o", LOST_ORDER)).alias("lost"), "council")


def decide(appeals: DataFrame, judgments: DataFrame, orders: DataFrame, reversal: bool = True) -> DataFrame:
    """(cig, label, reason): 1 for cigs with a won first instance that stands, 0 for those that only lost.

    Without `reversal` the second instance is looked at among won rulings only, so it undoes nothing, as published. All
    rulings are grouped by case once, and the cases of each cig once.
    """
    t = appeals.select("cig", "uid").join(case_states(judgments, orders, reversal), "uid").groupBy("cig").agg(F.bool_or("won").alias("won"), F.bool_or("lost").alias("lost"), F.min("council").alias("council"))
    undone = F.coalesce(F.col("council.outcome").isin(UNDONE), F.lit(False))
    label = F.when(F.col("won") & ~undone, 1).when(F.col("lost") & ~F.col("won"), 0)
    return t.select("cig", label.alias("label"), F.lit("ruling").alias("reason")).filter("label IS NOT NULL")


def closures(ends: DataFrame) -> DataFrame:
    """(cig, label, reason) of contracts ended for a crime (code 4) or for lack of an anti-mafia clearance (code 6)."""
    code = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(-1.0))
    hit = (code("cod_motivo_risoluzione") == 4.0) | (code("cod_motivo_interruzione_anticipata") == 6.0)
    return ends.filter(hit).select("cig").distinct().withColumns({"label": F.lit(1), "reason": F.lit("closure")})


def final_labels(rulings: DataFrame, ends: DataFrame) -> DataFrame:
    """Union of both sources; a cig with any label 1 is never 0. rulings has one row a cig."""
    closed = closures(ends).select("cig", F.lit(1).alias("_closed"))
    t = rulings.select("cig", "label").join(closed, "cig", "full")
    reason = F.when(F.col("label") == 1, "ruling").when(F.col("_closed") == 1, "closure").otherwise("ruling")
    return t.select("cig", F.when((F.col("label") == 1) | (F.col("_closed") == 1), 1).otherwise(0).alias("label"), reason.alias("reason"))


def match_report(appeals: DataFrame, rulings: DataFrame) -> DataFrame:
    """(matched, unmatched) numbers of rulings, for the decision log."""
    keys = appeals.select("uid").distinct().withColumn("_m", F.lit(1))
    return rulings.join(keys, "uid", "left").agg(F.count_if(F.col("_m") == 1).alias("matched"), F.count_if(F.col("_m").isNull()).alias("unmatched"))
