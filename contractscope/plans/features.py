"""One wide row per contract: each event table is reduced to one row per cig and attached by a left join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contractscope.functions.columns import clamp, days_between, excluded_share, first_match, lag_days, look_up, moment, near, number, plain_code, prefix_class, ratio, row_sum
from contractscope.operators.rows import attach, coalesce_lookup, duplicates, first_by_priority, pick_award, pick_one, unless_overridden

#: Codes of each class. Codes that no class names, such as 17, 122 and 999, have none.
PROCEDURE = {
    "APERTA": ["1", "9", "14", "27", "28", "29", "30"],
    "RISTRETTA": ["2", "10", "11", "12", "15", "26", "32", "33", "97"],
    "NEGOZIATA": ["3", "4", "5", "16", "40"],
    "AFFIDAMENTO_DIRETTO": ["6", "7", "8", "13", "18", "19", "20", "21", "22", "23", "24", "25", "34", "35", "36", "37", "38", "98", "99", "114"],
}
MODE = {"APPALTO": [1], "ECONOMIA": [7], "ACCORDO_QUADRO": [2, 9, 11, 17, 18], "CONCESSIONE": [3, 4, 20, 21], "PPP": [5, 6, 8, 12, 13], "ALTRO": [10, 14, 15, 16, 19, 90, 999]}
CPV = {"IT": ["30", "48", "72"], "SANITA": ["33", "85"], "LAVORI": ["44", "45"], "ING_PROF": ["71", "73", "79"], "SERVIZI": ["50", "51", "55", "60", "63", "64", "65", "66", "70", "75", "76", "77", "80", "90", "92", "98"]}
WORK_KINDS = {"ACQUISIZIONE": [1, 2, 3, 4, 5], "COSTRUZIONE": [6, 7], "RISANAMENTO": [8, 9, 10], "MANUTENZIONE": [11, 12, 13, 14]}
#: Reasons of variants that count as minor.
MINOR_VARIANTS = (17.0, 18.0, 19.0, 22.0, 96.0, 98.0, 99.0)
#: Outcomes that end a tender without an award, and award outcomes that overrule them.
NO_AWARD, AWARDED = ("DESERTA", "NON_AGGIUDICATA", "IN_CORSO"), ("1", "5")
#: First and last province code of each region.
REGIONS = {
    "Piemonte": [(1, 8)], "Valle d'Aosta": [(9, 9)], "Liguria": [(10, 13)], "Lombardia": [(14, 20)], "Trentino-Alto Adige": [(21, 22)], "Veneto": [(23, 29)], "Friuli-Venezia Giulia": [(30, 33)],
    "Emilia-Romagna": [(34, 41)], "Toscana": [(42, 51)], "Umbria": [(52, 53)], "Marche": [(54, 57), (109, 109)], "Lazio": [(58, 62)], "Abruzzo": [(63, 66)], "Molise": [(67, 68)], "Campania": [(69, 73)],
    "Puglia": [(74, 78), (110, 110)], "Basilicata": [(79, 80)], "Calabria": [(81, 85)], "Sicilia": [(86, 94)], "Sardegna": [(95, 98), (111, 111)],
}
#: Words of an authority's legal form, in order of precedence.
LEGAL_FORMS = [
    ("SANITARIO", ["OSPEDALIERI", "CURA, SOGGIORNO", "DI PREVIDENZA E DI ASSIST", "ISTITUTO PUBBLICO DI ASSIST", "CASSE MUTUE", "AZIENDA PUBBLICA DI SERVIZI ALLE PERSONE"]),
    ("EPE", ["ENTI PUBBLICI ECONOMICI"]),
    ("PA_ISTITUZIONALE", ["AMMINISTRAZIONI PUBBLICHE", "COMUNE", "ORGANI ED AMMIN", "UNIONE DI COMUNI", "CONSORZIO INTERCOMUNALE", "CONSORZIO DI CUI AL DLGS", "CONSORZI AI SENSI", "CONSORZIO AI SENSI", "CONSORZIO DI DIRITTO PUBBLICO"]),
    ("PA_ENTE", ["ENTI PUBBLICI NON ECONOMICI", "ALTRI ENTI ED ISTITUTI", "ALTRO ENTE PUBBLICO", "AZIENDE REGIONALI", "AZIENDA SPECIALE", "AZIENDE AUTONOME", "ISTITUTO E SCUOLA PUBBLICA", "ORDINE E COLLEGIO", "ASSOCIAZIONI TRA PROFESSIONISTI", "LAVORATORI AUTONOMI", "LIBERO PROFESSIONISTA", "ENTE DIRITTO PUBBLICO", "ENTE PARCO", "ENTE AMBIENTALE", "ENTE MORALE", "ENTE SOCIALE", "ENTE IMPRESA", "ENTI ED ISTITUTI DI PREVIDENZA"]),
    ("NON_PROFIT", ["FONDAZION", "ASSOCIAZION", "ORGANIZZAZIONI SENZA", "OPERE PIE", "ECCLESIASTIC", "ISTITUTO RELIGIOSO", "ENTE RELIGIOSO", "SOCIETA' SPORTIVE DILETTANTISTICHE"]),
    ("CONSORZIO", ["CONSORZI"]),
    ("SOCIETA", ["SOCIETA'", "SOCIETA ", "SOCIET\ufffd", "DITTE INDIVIDUALI", "IMPRESE INDIVIDUALI", "CONDOMINI", "COOPERATIV", "GRUPPI EUROPEI", "GEIE", "CONTRATTO DI RETE", "MUTUE ASSICURATRICI"]),
]
#: First and last year of context.
YEARS = (2007, 2024)
#: Kinds of works, the most telling first.
WORKS = ["COSTRUZIONE", "RISANAMENTO", "MANUTENZIONE", "ACQUISIZIONE"]


def by_class(classes):
    """code -> class, from class -> codes."""
    return {code: name for name, codes in classes.items() for code in codes}


def outcome_family(c):
    """Family of an outcome text; a text that fits none stays as it is, in upper case."""
    v = F.nullif(F.upper(F.trim(c)), F.lit(""))
    has = lambda *words: reduce(lambda a, w: a | F.contains(v, F.lit(w)), words, F.lit(False))
    kind = F.when(v == "AGGIUDICATA", v).when(has("ANNULLAT", "REVOCAT"), "ANNULLATA").when(has("DESERTA"), "DESERTA").when(has("IN_CORSO") | (v == "IN CORSO"), "IN_CORSO")
    kind = kind.when(has("SENZA ESITO", "NON AGGIUDICATA", "NON_AGGIUDICATA") | (has("NESSUN VINCITORE") & has("CHIUSA")), "SENZA_ESITO")
    return kind.when(has("ANCORA IN CORSO", "NON ANCORA"), "IN_CORSO").when(has("PROPOSTA"), "PROPOSTA").otherwise(v)


def section(c):
    """CENTRALE or REGIONALE, else null."""
    v = F.upper(c)
    return F.when(F.contains(v, F.lit("CENTRALE")), "CENTRALE").when(F.contains(v, F.lit("REGIONALE")) | F.contains(v, F.lit("SEZIONE")), "REGIONALE")


def province(c):
    """First three of six digits of a place code; null unless it is a plain number."""
    v = F.trim(c)
    return F.when(v.rlike(r"^[0-9.]+$"), F.substring(F.lpad(v.try_cast("double").cast("bigint").cast("string"), 6, "0"), 1, 3).try_cast("int"))


def region(code):
    out = F.lit(None).cast("string")
    for name, ranges in REGIONS.items():
        for low, high in ranges:
            out = F.when(code.between(low, high), name).otherwise(out)
    return out


def filled(c):
    """1 where a cell of a file holds anything, else 0."""
    return F.coalesce(c != "", F.lit(False)).cast("tinyint")


def file_order(df: DataFrame, *ties):
    """The order in which a key's first row is looked for: by the column `_row` if there is one, else by the ties."""
    return [F.col("_row").asc_nulls_last(), *ties] if "_row" in df.columns else list(ties)


def legal_form(c):
    v = F.upper(F.trim(c))
    return F.coalesce(F.when(v.isin("ENTE", "ENTE ECCLESIASTICO"), F.lit("PA_ENTE")), first_match(v, LEGAL_FORMS, F.lit("ALTRO")), F.lit("ALTRO"))


def subject_kind(c):
    v = F.upper(F.trim(c))
    kind = F.when(F.startswith(v, F.lit("IMPRESA SINGOLA")) | v.isin("IMPRESA", "DITTA INDIVIDUALE", "MONOSOGGETTIVO"), "SINGOLA").when(F.startswith(v, F.lit("ATI")) | (v == "RTI"), "ATI")
    kind = kind.when(F.startswith(v, F.lit("CONSORZIO")) | (~F.startswith(v, F.lit("GEIE")) & F.contains(v, F.lit("CONSORZIO"))), "CONSORZIO").when(F.startswith(v, F.lit("GEIE")), "GEIE").when(v == "STAZIONE APPALTANTE", "SA")
    return kind.otherwise("ALTRO")


def contracts(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Base table, one row per cig: the prevalent lot line, with dates, amounts, classes and derived features.

    With strict, several prevalent lines of one cig are an error; else the first one in file order (or by code, amount and
    place, if files give no `_row`) stays.
    """
    lines = raw.filter(F.trim("flag_prevalente") == "1")
    if strict and (twice := duplicates(lines, ["cig"]).select("cig").limit(5).collect()):
        raise ValueError(f"several prevalent lines: {[r['cig'] for r in twice]}")
    t = pick_one(lines, ["cig"], *file_order(lines, *[F.col(c).asc_nulls_last() for c in ("cod_cpv", "importo_lotto", "luogo_istat")]))
    for c in ("data_pubblicazione", "data_scadenza_offerta", "data_ultimo_perfezionamento", "data_comunicazione_esito"):
        t = t.withColumn(c, moment(F.col(c)))
    for c in ("importo_complessivo_gara", "importo_lotto", "importo_sicurezza"):
        t = t.withColumn(c, number(F.col(c)))
    code = lambda c: F.trim(c).try_cast("double").cast("long")
    year = F.col("anno_pubblicazione").try_cast("int")
    over = F.coalesce(F.col("importo_sicurezza") > F.col("importo_lotto"), F.lit(False))
    t = t.withColumns({
        "finestra_offerta_giorni": days_between(F.col("data_pubblicazione"), F.col("data_scadenza_offerta")),
        "lag_perfezionamento_giorni": days_between(F.col("data_pubblicazione"), F.col("data_ultimo_perfezionamento")),
        "lag_comunicazione_esito_giorni": days_between(F.col("data_pubblicazione"), F.col("data_comunicazione_esito")),
        "importo_sicurezza_pct": F.when((F.col("importo_lotto") > 0) & ~over, F.col("importo_sicurezza") / F.col("importo_lotto")),
        "importo_sicurezza": F.when(~over, F.col("importo_sicurezza")), "sicurezza_oltre_lotto": (F.col("importo_sicurezza") > F.col("importo_lotto")).cast("int"),
        "flag_urgenza": F.coalesce(code("flag_urgenza"), F.lit(0)), "flag_delega": code("flag_delega"),
        "flag_ripetizioni": F.coalesce(clamp(F.trim("flag_prev_ripetizioni").try_cast("double"), 0, 1), F.lit(0.0)).cast("tinyint"),
        "flag_accordo_quadro": filled(F.col("cig_accordo_quadro")), "flag_appalto_riservato": filled(F.col("tipo_appalto_riservato")),
        "settore_speciale": F.coalesce(F.contains(F.upper("settore"), F.lit("SPECIALI")), F.lit(False)).cast("tinyint"),
        **{c: code(c) for c in ("n_lotti_componenti", "cod_strumento_svolgimento", "cod_motivo_urgenza")},
        "modalita_realizzazione_macro": look_up(code("cod_modalita_realizzazione").cast("int"), by_class(MODE)),
        "sezione_regionale": section(F.col("sezione_regionale")),
        "tipo_scelta_4cls": look_up(F.trim("cod_tipo_scelta_contraente"), by_class(PROCEDURE)),
        "cpv_macro_categoria": prefix_class(F.col("cod_cpv"), by_class(CPV), "FORNITURE"),
        "esito": outcome_family(F.col("esito")),
        "anno": clamp(F.coalesce(year, F.lit(2025)) - 1, *YEARS),  # context of the year before, as far as there is any
        "codice_provincia": province(F.col("luogo_istat")),
    })
    return t.withColumn("regione", region(F.col("codice_provincia")))


def award_targets(condemned: DataFrame, ended: DataFrame) -> DataFrame:
    """(cig, id_aggiudicazione): the award that ended, for condemned contracts whose end names one; the first in file order."""
    named = ended.filter("id_aggiudicazione IS NOT NULL").withColumn("id_aggiudicazione", F.trim("id_aggiudicazione"))
    one = pick_one(named, ["cig"], *file_order(named, F.col("id_aggiudicazione")))
    return one.join(condemned.select(F.trim("cig").alias("cig")).distinct(), "cig", "left_semi").select("cig", "id_aggiudicazione")


def award_rows(raw: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One award per cig with what its own row tells: bids, discounts and flags."""
    t = raw
    for c in ("importo_aggiudicazione", "numero_offerte_ammesse", "numero_offerte_escluse", "num_imprese_offerenti", "ribasso_aggiudicazione", "massimo_ribasso", "minimo_ribasso"):
        t = t.withColumn(c, number(F.col(c)))
    t = t.withColumn("data_aggiudicazione_definitiva", moment(F.col("data_aggiudicazione_definitiva")))
    made = pick_award(t, targets, F.col("importo_aggiudicazione")).withColumns({
        "pct_offerte_escluse": excluded_share(F.col("numero_offerte_ammesse"), F.col("numero_offerte_escluse"), F.col("num_imprese_offerenti")),
        "ribasso_spread": F.col("massimo_ribasso") - F.col("ribasso_aggiudicazione"),
        "flag_vince_minimo": near(F.col("ribasso_aggiudicazione"), F.col("minimo_ribasso")),
        "flag_progettazione_esterna": F.coalesce(F.trim("cig_prog_esterna") != "", F.lit(False)),
        "cod_esito": F.substring_index(F.trim("cod_esito"), ".", 1),
        **{c: F.coalesce(F.trim(c).try_cast("double").cast("int"), F.lit(0)) for c in ("asta_elettronica", "flag_scomputo", "flag_proc_accelerata")},
    })
    return made.select("cig", "id_aggiudicazione", "data_aggiudicazione_definitiva", "importo_aggiudicazione", "numero_offerte_ammesse", "numero_offerte_escluse", "num_imprese_offerenti", "pct_offerte_escluse", "ribasso_aggiudicazione", "ribasso_spread", "flag_vince_minimo", "flag_progettazione_esterna", "asta_elettronica", "flag_scomputo", "flag_proc_accelerata", "cod_esito")


def award_lags(t: DataFrame, published: str = "data_pubblicazione", lot: str = "importo_lotto") -> DataFrame:
    """Add the lag from the tender to the award, and how far the award's amount is from the discounted lot amount."""
    expected = F.col(lot) * (1 - F.col("ribasso_aggiudicazione") / 100)
    return t.withColumns({
        "lag_aggiudicazione_giorni": lag_days(F.col(published), F.col("data_aggiudicazione_definitiva")),
        "delta_coerenza_pct": F.when(F.col(lot) > 0, F.abs(F.col("importo_aggiudicazione") - expected) / F.col(lot)),
    })


def awards(raw: DataFrame, base: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One award per cig with bids, discounts, lags, flags and how far its amount is from the discounted lot amount."""
    t = award_rows(raw, targets).join(base.select("cig", F.col("data_pubblicazione").alias("_p"), F.col("importo_lotto").alias("_lot")), "cig", "left")
    return award_lags(t, "_p", "_lot").drop("_p", "_lot")


def with_outcome(base: DataFrame, awarded: DataFrame) -> DataFrame:
    """Contracts whose tender did not end without an award, or whose award's own outcome says that it was awarded."""
    saved = awarded.filter(F.col("cod_esito").isin(*AWARDED))
    return unless_overridden(base, F.col("esito").isin(*NO_AWARD), saved, "cig")


def stands():
    """with_outcome as a condition on rows of contracts, one a cig, with their award beside them; those without a cig stay."""
    ended = F.coalesce(F.col("esito").isin(*NO_AWARD), F.lit(False))
    return ~ended | F.coalesce(F.col("cod_esito").isin(*AWARDED), F.lit(False)) | F.col("cig").isNull()


def winners(raw: DataFrame) -> DataFrame:
    """The leading firm's kind of subject, else the first row's."""
    leads = F.coalesce(F.upper(F.trim("ruolo")) == "MANDATARIA", F.lit(False))
    t = pick_one(raw, ["cig"], leads.desc(), *file_order(raw, F.col("id_aggiudicazione"), F.col("codice_fiscale")))
    return t.select("cig", subject_kind(F.col("tipo_soggetto")).alias("tipo_soggetto_agg"))


def authorities(base: DataFrame, raw: DataFrame, null_matches: bool = False) -> DataFrame:
    """(cig, natura_giuridica_SA) by AUSA code, else by fiscal code."""
    table = raw.select(plain_code(F.col("codice_ausa")).alias("ausa"), F.trim("codice_fiscale").alias("cf"), legal_form(F.col("natura_giuridica_descrizione")).alias("natura_giuridica_SA"))
    keys = base.select("cig", plain_code(F.col("codice_ausa")).alias("_ausa"), F.trim("cf_amministrazione_appaltante").alias("_cf"))
    return coalesce_lookup(keys, table, [("_ausa", "ausa"), ("_cf", "cf")], "natura_giuridica_SA", null_matches).select("cig", "natura_giuridica_SA")


def budgets(raw: DataFrame) -> DataFrame:
    """Overrun and reserve ratios within [0, 10], all over the tender's core sum, and the tender's security amount.

    Amounts are plain numbers here, with a decimal point; sums of nothing but nulls are null, the core sum of such sums 0.
    """
    core = ["importo_sicurezza", "importo_forniture", "importo_lavori", "importo_progettazione", "importo_servizi", "ulteriori_oneri_non_soggetti_ribasso"]
    sums = []
    for event in ("BASE_ASTA", "CONSUNTIVO"):
        here = F.col("descrizione_evento") == event
        sums += [F.sum(F.when(here, F.trim(c).try_cast("double"))).alias(f"{event}_{c}") for c in [*core, "somme_a_disposizione"]]
        sums.append(F.count_if(here).alias(event))
    t = raw.filter(F.col("descrizione_evento").isin("BASE_ASTA", "CONSUNTIVO")).groupBy(F.trim("cig").alias("cig")).agg(*sums)
    total = lambda event: F.when(F.col(event) > 0, row_sum(*[F.col(f"{event}_{c}") for c in core]))
    share = lambda a: ratio(a, total("BASE_ASTA"), 0, 10)
    return t.select("cig", share(F.col("BASE_ASTA_somme_a_disposizione")).alias("pct_riserva_base"), share(total("CONSUNTIVO")).alias("pct_overrun_core"), share(F.col("CONSUNTIVO_somme_a_disposizione")).alias("pct_riserva_consumata"), F.col("BASE_ASTA_importo_sicurezza").alias("sicurezza_base_asta"), total("BASE_ASTA").alias("somma_base_asta"))


def start_rows(raw: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Dates, planned days and delivery flags: of the row of the known target award, else of the first row."""
    t = raw.withColumns({c: moment(F.col(c)) for c in ("data_stipula_contratto", "data_termine_contrattuale", "data_inizio_effettiva")})
    known = F.lit(False)
    if targets is not None:
        t = t.join(targets.select("cig", F.col("id_aggiudicazione").alias("_target")), "cig", "left")
        known = F.coalesce(F.trim("id_aggiudicazione") == F.col("_target"), F.lit(False))
    t = pick_one(t, ["cig"], known.desc(), *file_order(raw, F.col("id_aggiudicazione"), F.col("data_stipula_contratto").asc_nulls_last()))
    flag = lambda c: F.trim(c).try_cast("double").cast("tinyint").alias(c)
    return t.select("cig", F.col("data_inizio_effettiva").alias("inizio"), F.col("data_termine_contrattuale").alias("termine"), "data_stipula_contratto", lag_days(F.col("data_inizio_effettiva"), F.col("data_termine_contrattuale")).alias("durata_pianificata_giorni"), flag("consegna_frazionata"), flag("consegna_sotto_riserva"))


def signing_lag(t: DataFrame) -> DataFrame:
    """Add the lag from award to signing."""
    return t.withColumn("lag_stipula_aggiudicazione_giorni", lag_days(F.col("data_aggiudicazione_definitiva"), F.col("data_stipula_contratto")))


def starts(raw: DataFrame, awarded: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Lag from award to signing, planned days and delivery flags: of the row of the known target award, else of the first row."""
    return signing_lag(start_rows(raw, targets).join(awarded.select("cig", "data_aggiudicazione_definitiva"), "cig", "left")).drop("data_aggiudicazione_definitiva")


def _within(c):
    """A date moved into 2000 to 2040."""
    edge = lambda x: F.lit(x).cast("timestamp")
    return F.when(c.isNotNull(), F.least(F.greatest(c, edge("2000-01-01")), edge("2040-01-01")))


def variants(raw: DataFrame, minor: tuple[float, ...] = MINOR_VARIANTS) -> DataFrame:
    """Number, whether any is substantial (a null reason counts), and the first approval, moved into 2000 to 2040."""
    big = F.coalesce(~F.col("cod_motivo_variante").try_cast("double").isin(list(minor)), F.lit(True))
    return raw.groupBy("cig").agg(F.count("*").alias("n_varianti"), F.max(big.cast("int")).alias("flag_variante_sostanziale"), F.min(_within(moment(F.col("data_approvazione_variante"), low="1678-01-01", high="2262-01-01"))).alias("prima_variante"))


def variant_timing(wide: DataFrame) -> DataFrame:
    """Add when the first variant came: days from the award (none below zero), share of the planned time, whether after
    its end, and overrun.

    Contracts without a start or a variant have nulls; overrun counts only where there is a variant. The last three are
    defined here, as their names say, since no published step makes them.
    """
    return wide.withColumns({
        "delta_prima_variante_giorni": lag_days(_within(F.col("data_aggiudicazione_definitiva")), F.col("prima_variante")),
        "pct_vita_prima_variante": ratio(days_between(F.col("inizio"), F.col("prima_variante")), F.col("durata_pianificata_giorni"), 0, 10),
        "flag_variante_oltre_termine": (F.col("prima_variante") > F.col("termine")).cast("int"),
        "pct_overrun_variante": F.when(F.col("n_varianti") > 0, F.col("pct_overrun_core")),
    })


def suspensions(raw: DataFrame) -> DataFrame:
    """Number, days of completed suspensions (none below zero), and whether a judicial authority ordered any."""
    days = days_between(moment(F.col("data_sospensione"), low="1678-01-01", high="2262-01-01"), moment(F.col("data_ripresa"), low="1678-01-01", high="2262-01-01"))
    court = F.coalesce(F.col("descrizione_motivo") == "INTERVENTO AUTORITA' GIUDIZIARIA", F.lit(False))
    return raw.groupBy("cig").agg(F.count("*").alias("n_sospensioni"), F.coalesce(F.sum(F.when(days.isNotNull(), F.greatest(days, F.lit(0)))), F.lit(0)).alias("durata_totale_sospensioni_gg"), F.max(court.cast("int")).alias("flag_sosp_giudiziaria"))


def progress(raw: DataFrame) -> DataFrame:
    """Number of reports, any delay, any extension; without reports, the delay stays null after the join."""
    late = F.coalesce(F.col("flag_ritardo") == "IN RITARDO", F.lit(False))
    longer = F.coalesce(F.trim("giorni_proroga").try_cast("double") > 0, F.lit(False))
    return raw.groupBy("cig").agg(F.count("*").alias("n_sal"), F.max(late.cast("int")).alias("flag_in_ritardo"), F.max(longer.cast("int")).alias("flag_proroga"))


def works(raw: DataFrame) -> DataFrame:
    """The most telling kind of a contract's works, by code; acquisition counts as none."""
    kind = look_up(F.trim("cod_tipo_lavorazione").try_cast("double"), {float(k): v for k, v in by_class(WORK_KINDS).items()})
    return first_by_priority(raw.withColumn("tipo_lavorazione_macro", kind), ["cig"], "tipo_lavorazione_macro", WORKS, none=["ACQUISIZIONE"])


def tests_passed(raw: DataFrame) -> DataFrame:
    """The outcome of the first row of each contract, as it stands."""
    return pick_one(raw, ["cig"], *file_order(raw, F.col("esito_collaudo").asc_nulls_last())).select("cig", "esito_collaudo")


def subcontracted(awards_raw: DataFrame, listed: DataFrame) -> DataFrame:
    """(cig, flag_subappalto 1): contracts whose first award says so, or that are listed among the subcontracts."""
    first = pick_one(awards_raw, ["cig"], *file_order(awards_raw, F.col("id_aggiudicazione").asc_nulls_last(), F.col("flag_subappalto")))
    said = first.filter("flag_subappalto = 'True'").select(F.trim("cig").alias("cig"))
    return said.union(listed.select(F.trim("cig").alias("cig"))).distinct().withColumn("flag_subappalto", F.lit(1))


def context(raw: DataFrame) -> DataFrame:
    """Context by province and year, of those alone that contracts() can give: 1000 codes of three digits in 18 years.

    That is few enough for every task to have it, so that the wide table is not dealt anew by province and then by cig again.
    """
    there = F.col("codice_provincia").between(0, 999) & F.col("anno").between(*YEARS)
    return raw.filter(there).select("codice_provincia", "anno", "tasso_disoccupazione", "reddito_irpef_procapite", "tasso_omicidi_100k")


def wide_table(tables: dict[str, DataFrame], labels: DataFrame | None = None, filter_outcomes: bool = True) -> DataFrame:
    """All features of every contract; tables that are missing leave their features out.

    tables are raw, by the names of the published files; labels has (cig, label). With filter_outcomes, contracts without
    an award go, unless the award's outcome overrules it. Condemned contracts take the award that their end names.
    Contracts and awards are each reduced once; what needs both is made from the joined row.
    """
    base = contracts(tables["cig"])
    targets = award_targets(labels.filter("label = 1"), tables["fine-contratto"]) if labels is not None and "fine-contratto" in tables else None
    parts: list[DataFrame] = []
    awarded = "aggiudicazioni" in tables
    if "aggiudicatari" in tables:
        parts.append(winners(tables["aggiudicatari"]))
    if "stazioni-appaltanti" in tables:
        parts.append(authorities(base, tables["stazioni-appaltanti"]))
    started = "avvio-contratto" in tables and awarded
    if started:
        parts.append(start_rows(tables["avvio-contratto"], targets))
    for name, build in (("quadro-economico", budgets), ("varianti", variants), ("sospensioni", suspensions), ("stati-avanzamento", progress), ("lavorazioni", works), ("collaudo", tests_passed)):
        if name in tables:
            parts.append(build(tables[name]))
    if "subappalti" in tables and awarded:
        parts.append(subcontracted(tables["aggiudicazioni"], tables["subappalti"]))
    wide = base
    if awarded:
        wide = award_lags(attach(base, award_rows(tables["aggiudicazioni"], targets)))
        wide = wide.filter(stands()) if filter_outcomes else wide
    wide = attach(wide, *parts)
    wide = signing_lag(wide) if started else wide
    have = set(wide.columns)
    zero = [c for c in ("n_varianti", "n_sospensioni", "n_sal", "flag_variante_sostanziale", "flag_sosp_giudiziaria", "durata_totale_sospensioni_gg", "flag_proroga", "flag_subappalto") if c in have]
    wide = wide.fillna(0, zero)
    if "sicurezza_base_asta" in have:
        wide = wide.withColumns({"importo_sicurezza_bando": F.col("importo_sicurezza"), "importo_sicurezza": F.coalesce("importo_sicurezza", "sicurezza_base_asta")})
    if "n_sospensioni" in have:
        wide = wide.withColumn("flag_sospensione", (F.col("n_sospensioni") > 0).cast("int"))
        if "durata_pianificata_giorni" in have:
            wide = wide.withColumn("pct_durata_sospesa", F.when(F.col("n_sospensioni") == 0, 0.0).otherwise(ratio(F.col("durata_totale_sospensioni_gg"), F.col("durata_pianificata_giorni"), 0, 10)))
    if {"inizio", "prima_variante", "pct_overrun_core"} <= have:
        wide = variant_timing(wide)
    if "contesto_province" in tables:
        wide = wide.join(F.broadcast(context(tables["contesto_province"])), ["codice_provincia", "anno"], "left")
    return wide.join(labels.select("cig", "label"), "cig", "left") if labels is not None else wide.withColumn("label", F.lit(None).cast("int"))


def audit_frame(tables: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """The wide table with what its sanity checks compare: rows a contract, its number of awards, its authority's code and
    whether that is known. Every part has one row a key before it is joined."""
    wide = wide_table(tables, labels)
    rows = F.when(F.col("cig").isNotNull(), F.count("*").over(Window.partitionBy("cig")))
    counts = tables["aggiudicazioni"].groupBy(F.trim("cig").alias("cig")).agg(F.count("*").alias("n_awards"))
    known = tables["stazioni-appaltanti"].select(plain_code(F.col("codice_ausa")).alias("ausa")).filter("ausa IS NOT NULL").distinct().withColumn("ausa_known", F.lit(1))
    return attach(wide.withColumns({"n_rows": rows, "ausa": plain_code(F.col("codice_ausa"))}), counts).join(known, "ausa", "left")
