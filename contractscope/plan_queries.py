"""Registered queries of the label and feature plans: raw procurement tables made from the star schema, with SQL beside.

A raw table is one SELECT that Spark and DuckDB both read; all its columns are text, as in the published files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractscope.operators import boost, intervals, panel, pu, sanity, scoring, shap, tuning
from contractscope.plans import datasets, features, labels
from contractscope.queries import FEATURES, _features, _once, query, r6, scored, t

_CIG = "'Z' || lpad(CAST({k} AS STRING), 9, '0')"
_SEAT = "CASE WHEN o_orderkey % 11 = 0 THEN ' Consiglio  di Stato' ELSE 'tar r' || CAST(o_custkey % 3 AS STRING) END"
_NO = "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) END"
_DAY = "substr(CAST({c} AS STRING), 1, 10)"

TABLES = ("orders", "lineitem", "supplier", "region")
RAW = {
    "ricorsi": f"""SELECT CASE WHEN o_orderkey % 17 = 0 THEN '0000000000' WHEN o_orderkey % 3 = 0 THEN {_CIG.format(k='o_orderkey')} || '; ' || {_CIG.format(k='o_orderkey + 1')} WHEN o_orderkey % 5 = 0 THEN 'short'
        ELSE lower({_CIG.format(k='o_orderkey')}) END AS CODICE_CIG, {_NO} AS NUMERO_RICORSO, {_SEAT} AS NOME_SEDE, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS STRING) ELSE 'x' END AS ANNO_DEPOSITO_RICORSO FROM {{orders}}""",
    "sentenze": f"""SELECT CASE WHEN o_orderkey % 4 <> 3 THEN {_NO} END AS NUMERO_RICORSO, {_SEAT} AS NOME_SEDE, {_DAY.format(c='l_shipdate')} AS DATA_PUBBLICAZIONE, CASE l_linenumber + o_orderkey % 3 WHEN 1 THEN 'Accoglie  il ricorso' WHEN 2 THEN 'RESPINGE' WHEN 3 THEN 'Dichiara la nullità'
        WHEN 4 THEN 'Respinge l''appello' WHEN 5 THEN 'Rimette al TAR' ELSE 'Altro' END AS ESITO_PROVVEDIMENTO, 'il 3/2/2011' AS DATA_DEPOSITO_RICORSO,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS STRING) END AS ANNO_DEPOSITO_RICORSO, '2012' AS ANNO_PUBBLICAZIONE FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey""",
    "ordinanze": f"""SELECT CASE WHEN o_orderkey % 2 = 1 THEN {_NO} END AS NUMERO_RICORSO, {_SEAT} AS NOME_SEDE, {_DAY.format(c='o_orderdate')} AS DATA_PUBBLICAZIONE, CASE o_orderkey % 3 WHEN 0 THEN 'Accoglie' WHEN 1 THEN 'Rigetta la domanda cautelare' ELSE 'Altro' END AS ESITO_PROVVEDIMENTO,
        CAST(NULL AS STRING) AS DATA_DEPOSITO_RICORSO, CAST(year(o_orderdate) AS STRING) AS ANNO_DEPOSITO_RICORSO, '2012' AS ANNO_PUBBLICAZIONE FROM {{orders}}""",
    "fine": f"""SELECT {_CIG.format(k='o_orderkey')} AS cig, CASE WHEN o_orderkey % 19 = 0 THEN '4.0' WHEN o_orderkey % 3 = 0 THEN 'x' END AS cod_motivo_risoluzione, CASE WHEN o_orderkey % 23 = 0 THEN '6' END AS cod_motivo_interruzione_anticipata, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 4 + 1 AS STRING) || ' ' END AS id_aggiudicazione FROM {{orders}}""",
    "etichette": f"SELECT {_CIG.format(k='o_orderkey')} AS cig, CASE o_custkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label FROM {{orders}}",
    "cig": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS _row, CASE WHEN l_linenumber % 2 = 1 THEN ' 1' ELSE '0' END AS flag_prevalente, CASE WHEN l_partkey % 13 = 0 THEN ' ' WHEN l_partkey % 13 <> 1 THEN lpad(CAST(l_partkey % 100 AS STRING), 2, '0') || '000000-' || CAST(l_linenumber AS STRING) END AS cod_cpv,
        {_DAY.format(c='o_orderdate')} || ' 10:00:00' AS data_pubblicazione, CASE WHEN l_linenumber > 1 THEN {_DAY.format(c='l_shipdate')} || ' 09:30:00' WHEN l_partkey % 2 = 0 THEN '1899-01-01' ELSE 'garbage' END AS data_scadenza_offerta, {_DAY.format(c='l_shipdate')} AS data_ultimo_perfezionamento,
        CASE WHEN l_partkey % 3 <> 0 THEN {_DAY.format(c='l_shipdate + INTERVAL 1 DAY * (l_partkey % 40)')} END AS data_comunicazione_esito, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS importo_complessivo_gara, CASE WHEN l_partkey % 17 = 0 THEN '0' ELSE replace(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING), '.', ',') END AS importo_lotto,
        CASE l_partkey % 9 WHEN 0 THEN CAST(CAST(l_extendedprice * 2 AS DECIMAL(18, 2)) AS STRING) WHEN 1 THEN NULL WHEN 2 THEN 'x' WHEN 3 THEN '0' ELSE CAST(CAST(l_tax * 1000 AS DECIMAL(18, 2)) AS STRING) END AS importo_sicurezza, CASE WHEN l_returnflag = 'R' THEN '1' WHEN l_returnflag = 'A' THEN '7' END AS flag_urgenza,
        CASE WHEN l_returnflag = 'R' THEN '0' WHEN l_returnflag = 'A' THEN ' 1.0' END AS flag_delega, CASE l_partkey % 4 WHEN 0 THEN '3' WHEN 1 THEN '-1' WHEN 2 THEN 'x' END AS flag_prev_ripetizioni, CASE l_linenumber WHEN 3 THEN 'Q1' WHEN 1 THEN '' END AS cig_accordo_quadro,
        CASE l_suppkey % 3 WHEN 0 THEN 'legge' WHEN 1 THEN '' END AS tipo_appalto_riservato, CASE WHEN l_linestatus = 'O' THEN 'settori speciali' ELSE 'ORDINARI' END AS settore, split_part('1|2|3.0|4|5|6|7|8|9|10|11|12|13|14|15|16|17|18|19|20|21|90|999|22|x|| 1', '|', CAST(l_partkey % 27 + 1 AS INT)) AS cod_modalita_realizzazione,
        split_part('1|2 |3| 4|5|6|7|8|9|10|11|12|13|14|15|16|17|18|19|20|21|22|23|24|25|26|27|28|29|30|32|33|34|35|36|37|38|40|97|98|99|114|122|999|x|', '|', CAST(l_partkey % 46 + 1 AS INT)) AS cod_tipo_scelta_contraente,
        CASE WHEN l_orderkey % 3 <> 0 THEN 'Aggiudicata ' ELSE split_part('AGGIUDICATA|annullata dalla SA|Revocata|gara deserta|IN_CORSO|in corso|procedura in corso|bando ancora in corso|non ancora aperta|senza esito|non aggiudicata|NON_AGGIUDICATA|nessun vincitore|Chiusa: nessun vincitore|proposta di aggiudicazione|Altro esito|', '|', CAST(l_partkey % 17 + 1 AS INT)) END AS esito,
        CASE WHEN l_partkey % 11 <> 0 THEN CAST(year(o_orderdate) + 22 AS STRING) WHEN l_partkey % 2 = 0 THEN '1990' END AS anno_pubblicazione, CASE l_partkey % 19 WHEN 0 THEN 'A-12' WHEN 1 THEN '1,5' WHEN 2 THEN '' ELSE CAST((l_partkey % 112) * 1000 + 7 AS STRING) || '.0' END AS luogo_istat,
        CASE WHEN l_suppkey % 4 <> 0 THEN '000' || CAST(l_suppkey AS STRING) || '.0' END AS codice_ausa, 'CF' || CAST(l_suppkey % 50 AS STRING) AS cf_amministrazione_appaltante, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey % 5 AS STRING) || '.0' END AS n_lotti_componenti,
        split_part('LAVORI|SERVIZI|FORNITURE', '|', CAST(l_partkey % 4 + 1 AS INT)) AS oggetto_principale_contratto, split_part('Sezione centrale|sezione regionale LAZIO|Sezione X|Roma|', '|', CAST(l_partkey % 5 + 1 AS INT)) AS sezione_regionale, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey % 3 AS STRING) END AS cod_strumento_svolgimento,
        CASE WHEN l_partkey % 7 = 0 THEN '2' END AS cod_motivo_urgenza FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "sa": """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'CF' || CAST(s_suppkey AS STRING) END AS codice_fiscale, CASE WHEN s_suppkey % 3 > 0 THEN '00' || CAST(s_suppkey AS STRING) END AS codice_ausa, split_part('Comune|Enti ospedalieri|enti pubblici economici|Azienda speciale|Azienda speciale di cui al dlgs 267|ente|Ente ecclesiastico|ente ecclesiastico civilmente riconosciuto|Fondazione X|ENTE MORALE|Consorzio|Consorzi ai sensi|consorzi di bonifica|societa'' per azioni|Societa semplice|Cooperativa|GEIE|Boh|Associazioni tra professionisti|Associazione Y|Casse mutue|Ordine e collegio',
        '|', CAST(s_suppkey % 23 + 1 AS INT)) AS natura_giuridica_descrizione FROM {supplier}""",
    "agg": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS _row, ' ' || CAST(l_linenumber AS STRING) AS id_aggiudicazione, CASE WHEN l_linenumber > 1 THEN {_DAY.format(c='l_shipdate')} END AS data_aggiudicazione_definitiva,
        replace(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING), '.', ',') AS importo_aggiudicazione, CAST(l_partkey % 8 AS STRING) AS numero_offerte_ammesse, CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey % 6 AS STRING) END AS numero_offerte_escluse, CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey % 10 AS STRING) END AS num_imprese_offerenti,
        CASE WHEN l_partkey % 12 = 0 THEN '-3' ELSE CAST(CAST(l_discount * 400 AS INT) AS STRING) END AS ribasso_aggiudicazione, CASE WHEN l_partkey % 3 <> 0 THEN '41' END AS massimo_ribasso, '4,0005' AS minimo_ribasso, CASE l_linenumber % 3 WHEN 0 THEN 'p' WHEN 1 THEN ' ' END AS cig_prog_esterna, CASE WHEN l_returnflag = 'N' THEN 'x' ELSE '' END AS cod_modo_riaggiudicazione,
        CASE WHEN l_linenumber = 2 THEN '1.0' END AS asta_elettronica, '0' AS flag_scomputo, CASE WHEN l_partkey % 6 = 0 THEN '1' WHEN l_partkey % 6 = 1 THEN 'x' END AS flag_proc_accelerata, CASE l_partkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'true' END AS flag_subappalto, split_part('1|1.0|5|5.0|2|3|', '|', CAST(l_partkey % 7 + 1 AS INT)) AS cod_esito FROM {{lineitem}}""",
    "vincitori": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS _row, CAST(l_linenumber AS STRING) AS id_aggiudicazione, CASE l_linenumber % 4 WHEN 3 THEN ' mandataria' WHEN 1 THEN 'MANDANTE' END AS ruolo, 'F' || CAST(l_suppkey AS STRING) AS codice_fiscale,
        split_part('Impresa singola x|impresa|Ditta individuale|MONOSOGGETTIVO|ATI y|RTI|RTI z|Consorzio a|un consorzio|GEIE consorzio|Stazione appaltante|x|', '|', CAST(l_partkey % 13 + 1 AS INT)) AS tipo_soggetto FROM {{lineitem}}""",
    "quadro": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, CASE WHEN l_linenumber % 4 IN (1, 2) THEN 'BASE_ASTA' WHEN l_linenumber % 4 = 3 THEN 'CONSUNTIVO' ELSE 'Base_asta' END AS descrizione_evento, CASE WHEN l_partkey % 3 = 0 THEN CAST(CAST(l_tax * 100 AS DECIMAL(18, 2)) AS STRING) WHEN l_partkey % 3 = 1 THEN '1,5' END AS importo_sicurezza,
        CAST(CAST(l_quantity AS INT) AS STRING) AS importo_forniture, CASE WHEN l_partkey % 4 = 0 THEN '100.5' END AS importo_lavori, CAST(NULL AS STRING) AS importo_progettazione, 'x' AS importo_servizi, CASE WHEN l_partkey % 5 = 0 THEN '-70' END AS ulteriori_oneri_non_soggetti_ribasso,
        CASE WHEN l_returnflag <> 'A' THEN CAST(CAST(l_discount * 1000 AS INT) AS STRING) END AS somme_a_disposizione FROM {{lineitem}}""",
    "avvio": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS _row, CAST(l_linenumber AS STRING) AS id_aggiudicazione, CASE WHEN l_partkey % 5 <> 0 THEN {_DAY.format(c='l_shipdate + INTERVAL 1 DAY * (l_partkey % 40)')} END AS data_stipula_contratto, CASE WHEN l_partkey % 7 <> 0 THEN {_DAY.format(c='l_shipdate + INTERVAL 1 DAY * (l_partkey % 40) + INTERVAL 1 DAY * (l_partkey % 900 - 20)')} END AS data_termine_contrattuale,
        CASE WHEN l_partkey % 3 <> 0 THEN {_DAY.format(c='l_shipdate + INTERVAL 1 DAY * (l_partkey % 60 - 20)')} END AS data_inizio_effettiva, split_part('1|0|1.0|x|', '|', CAST(l_partkey % 5 + 1 AS INT)) AS consegna_frazionata, split_part('0|2|', '|', CAST(l_partkey % 3 + 1 AS INT)) AS consegna_sotto_riserva FROM {{lineitem}} WHERE l_linestatus = 'F'""",
    "varianti": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, split_part('17|18|19.0|22|96|98|99|1|2|6|16|x|', '|', CAST(l_partkey % 13 + 1 AS INT)) AS cod_motivo_variante, CASE WHEN l_partkey % 6 <> 0 THEN {_DAY.format(c='l_shipdate + INTERVAL 1 DAY * (l_partkey % 40) + INTERVAL 1 DAY * (l_partkey % 3000)')} WHEN l_partkey % 12 = 0 THEN '2055-05-05' END AS data_approvazione_variante FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "sospensioni": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, {_DAY.format(c='l_shipdate')} AS data_sospensione, CASE WHEN l_linenumber > 1 THEN {_DAY.format(c='l_shipdate + INTERVAL 1 DAY * (l_partkey % 200 - 30)')} END AS data_ripresa, split_part('INTERVENTO AUTORITA'' GIUDIZIARIA|intervento autorita'' giudiziaria|MOTIVI GIUDIZIARI|', '|', CAST(l_partkey % 4 + 1 AS INT)) AS descrizione_motivo FROM {{lineitem}} WHERE l_discount > 0.08""",
    "sal": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, split_part('IN RITARDO|in ritardo|PUNTUALE|', '|', CAST(l_partkey % 4 + 1 AS INT)) AS flag_ritardo, split_part('2.5|2,5|0| 7|x', '|', CAST(l_partkey % 6 + 1 AS INT)) AS giorni_proroga FROM {{lineitem}} WHERE l_returnflag <> 'A'""",
    "lavorazioni": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, split_part('1|2|3|4|5|6.0|7|8|9|10|11|12|13|14|15|x|', '|', CAST(l_partkey % 17 + 1 AS INT)) AS cod_tipo_lavorazione FROM {{lineitem}}""",
    "collaudo": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS _row, CASE l_partkey % 3 WHEN 0 THEN 'POSITIVO' WHEN 1 THEN 'NEGATIVO' END AS esito_collaudo FROM {{lineitem}} WHERE l_linestatus = 'F'""",
    "subappalti": f"""SELECT ' ' || {_CIG.format(k='l_orderkey')} AS cig FROM {{lineitem}} WHERE l_quantity > 40""",
    "partecipanti": f"""SELECT {_CIG.format(k='l_orderkey')} AS cig, 'F' || CAST(l_suppkey AS STRING) || ' ' AS codice_fiscale FROM {{lineitem}} WHERE l_quantity > 25""",
    "contesto": """SELECT CAST(s_suppkey AS INT) AS codice_provincia, CAST(2014 + r_regionkey AS INT) AS anno, CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 37) * CAST(0.5 AS DOUBLE) END AS tasso_disoccupazione, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(14000 + 1000 * (s_suppkey % 17) AS DOUBLE) END AS reddito_irpef_procapite, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 6 - 1) * CAST(0.3 AS DOUBLE) END AS tasso_omicidi_100k FROM {supplier} JOIN {region} ON s_suppkey <= 111""",
}


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = RAW[name]
    return spark.sql(text, **{x: t(spark, d, x) for x in TABLES if "{" + x + "}" in text})


def _sql(*names: str) -> str:
    return ", ".join(f"{n} AS ({RAW[n].format(**{x: x for x in TABLES})})" for n in names)


_TIDY = r"nullif(regexp_replace(upper(trim({c})), '\s+', ' ', 'g'), '')"
_SECOND = "coalesce(contains(seat, 'CONSIGLIO DI STATO') OR seat = 'CDS' OR starts_with(seat, 'CDS '), false)"
_UID = "coalesce(seat, '') || '|' || coalesce(CAST(y AS STRING), '') || '|' || coalesce(no, '')"
_APPEALS = f"""appeals AS (SELECT DISTINCT cig, {_UID} AS uid, {_SECOND} AS second FROM (SELECT upper(trim(unnest(string_split(CODICE_CIG, ';')))) AS cig, {_TIDY.format(c='NOME_SEDE')} AS seat, {_TIDY.format(c='NUMERO_RICORSO')} AS no,
    TRY_CAST(ANNO_DEPOSITO_RICORSO AS INTEGER) AS y FROM ricorsi) WHERE length(cig) = 10 AND cig <> '0000000000' AND no IS NOT NULL)"""
_RULINGS = rf"""{{n}} AS (SELECT {_UID} AS uid, outcome, published, {_SECOND} AS second FROM (SELECT {_TIDY.format(c='NOME_SEDE')} AS seat, {_TIDY.format(c='NUMERO_RICORSO')} AS no,
    coalesce(TRY_CAST(ANNO_DEPOSITO_RICORSO AS INTEGER), CAST(nullif(regexp_extract(DATA_DEPOSITO_RICORSO, '\b(20\d\d)\b', 1), '') AS INTEGER), TRY_CAST(ANNO_PUBBLICAZIONE AS INTEGER)) AS y,
    trim(regexp_replace(regexp_replace(translate(lower(trim(ESITO_PROVVEDIMENTO)), 'àáâãäåèéêëìíîïòóôõöùúûüçñý', 'aaaaaaeeeeiiiiooooouuuucny'), '[''’`\-]', ' ', 'g'), '\s+', ' ', 'g')) AS outcome, CAST(DATA_PUBBLICAZIONE AS TIMESTAMP) AS published FROM {{raw}}) WHERE no IS NOT NULL)"""
_LATEST = "{n} AS (SELECT uid, outcome, published FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY published DESC NULLS LAST, outcome) AS k FROM {of} WHERE NOT second) WHERE k = 1)"
_DECIDED = ", ".join([
    _sql("ricorsi", "sentenze", "ordinanze", "fine"), _APPEALS, _RULINGS.format(n="j", raw="sentenze"), _RULINGS.format(n="o", raw="ordinanze"), _LATEST.format(n="fj", of="j"), _LATEST.format(n="fo", of="o"),
    "wj AS (SELECT uid FROM fj WHERE outcome IN ('accoglie il ricorso', 'dichiara la nullita'))", "won AS (SELECT uid FROM wj UNION ALL SELECT uid FROM fo WHERE outcome = 'accoglie' AND uid NOT IN (SELECT uid FROM wj))",
    "lj AS (SELECT uid FROM fj WHERE outcome = 'respinge')", "lost AS (SELECT uid FROM lj UNION ALL SELECT uid FROM fo WHERE outcome = 'rigetta la domanda cautelare' AND uid NOT IN (SELECT uid FROM lj))",
    "council AS (SELECT cig, CASE WHEN outcome IN ('respinge', 'respinge l appello') THEN 'undone' WHEN outcome = 'rimette al tar' THEN 'open' ELSE 'confirmed' END AS verdict FROM (SELECT cig, outcome, row_number() OVER (PARTITION BY cig ORDER BY published DESC NULLS LAST, appeals.uid, outcome) AS k FROM appeals JOIN j ON appeals.uid = j.uid AND j.second) WHERE k = 1)",
    "guilty AS (SELECT DISTINCT cig FROM appeals JOIN won ON appeals.uid = won.uid WHERE cig NOT IN (SELECT cig FROM council WHERE verdict = 'undone'))",
    "free AS (SELECT DISTINCT cig FROM appeals JOIN lost ON appeals.uid = lost.uid WHERE cig NOT IN (SELECT cig FROM appeals JOIN won ON appeals.uid = won.uid))",
])


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return labels.clean_appeals(raw(spark, d, "ricorsi")), labels.clean_rulings(raw(spark, d, "sentenze"), "judgment"), labels.clean_rulings(raw(spark, d, "ordinanze"), "order")


@query(f"WITH {_sql('ricorsi')}, {_APPEALS} SELECT * FROM appeals")
def label_appeals(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)[0]


@query(f"WITH {_sql('sentenze')}, {_RULINGS.format(n='j', raw='sentenze')}, {_LATEST.format(n='fj', of='j')} SELECT uid, outcome, strftime(published, '%Y-%m-%d') AS published FROM fj")
def label_latest_rulings(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned first-instance judgments, the latest of each case."""
    return labels.latest(_cases(spark, d)[1].filter("NOT second")).select("uid", "outcome", F.col("published").cast("date").cast("string").alias("published"))


@query(f"WITH {_DECIDED} SELECT cig, verdict FROM council")
def label_council_verdicts(spark: SparkSession, d: str) -> DataFrame:
    appeals, judgments, _ = _cases(spark, d)
    return labels.council_verdicts(judgments, appeals)


@query(f"WITH {_DECIDED} SELECT cig, 1 AS label FROM guilty UNION ALL SELECT cig, 0 FROM free")
def label_decided(spark: SparkSession, d: str) -> DataFrame:
    """Condemned and acquitted contracts, with orders where no judgment is, and reversals by the second instance."""
    return labels.decide(*_cases(spark, d)).select("cig", "label")


@query(f"""WITH {_DECIDED}, ended AS (SELECT DISTINCT cig FROM fine WHERE TRY_CAST(cod_motivo_risoluzione AS DOUBLE) = 4 OR TRY_CAST(cod_motivo_interruzione_anticipata AS DOUBLE) = 6)
    SELECT cig, 1 AS label, 'ruling' AS reason FROM guilty UNION ALL SELECT cig, 1, 'closure' FROM ended WHERE cig NOT IN (SELECT cig FROM guilty)
    UNION ALL SELECT cig, 0, 'ruling' FROM free WHERE cig NOT IN (SELECT cig FROM guilty) AND cig NOT IN (SELECT cig FROM ended)""")
def label_final(spark: SparkSession, d: str) -> DataFrame:
    return labels.final_labels(labels.decide(*_cases(spark, d)), raw(spark, d, "fine"))


@query(f"WITH {_DECIDED} SELECT count(*) FILTER (WHERE uid IN (SELECT uid FROM appeals)) AS matched, count(*) FILTER (WHERE uid NOT IN (SELECT uid FROM appeals)) AS unmatched FROM j")
def label_matches(spark: SparkSession, d: str) -> DataFrame:
    appeals, judgments, _ = _cases(spark, d)
    return labels.match_report(appeals, judgments)


# --- features ---

_DAYS = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000) AS BIGINT)"
_WHEN = "CASE WHEN TRY_CAST(trim({c}) AS TIMESTAMP) BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '2030-12-31' THEN TRY_CAST(trim({c}) AS TIMESTAMP) END"
_COMMA = r"TRY_CAST(replace(regexp_replace({c}, '\s', '', 'g'), ',', '.') AS DOUBLE)"
_NUMBER = "TRY_CAST(trim({c}) AS DOUBLE)"
_CODE = "CAST(TRY_CAST(trim({c}) AS DOUBLE) AS BIGINT)"


def _among(c: str, *values: object) -> str:
    return f"{c} IN ({', '.join(repr(v) for v in values)})"


def _holds(c: str, *words: str) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"


#: The published rules of each step, written for DuckDB; names of the parts are those of the queries' tables.
PARTS = {
    "lines": f"""lines AS (SELECT *, {_WHEN.format(c='data_pubblicazione')} AS p, {_WHEN.format(c='data_scadenza_offerta')} AS s, {_WHEN.format(c='data_ultimo_perfezionamento')} AS u, {_WHEN.format(c='data_comunicazione_esito')} AS m,
        {_COMMA.format(c='importo_lotto')} AS lot, {_COMMA.format(c='importo_sicurezza')} AS sec, {_CODE.format(c='cod_modalita_realizzazione')} AS mode, trim(cod_tipo_scelta_contraente) AS proc, substr(trim(cod_cpv), 1, 2) AS cpv, nullif(upper(trim(esito)), '') AS e,
        row_number() OVER (PARTITION BY cig ORDER BY _row) AS k FROM cig WHERE trim(flag_prevalente) = '1')""",
    "base": f"""base AS (SELECT cig, p, lot AS importo_lotto, {_COMMA.format(c='importo_complessivo_gara')} AS importo_complessivo_gara, {_DAYS.format(a='p', b='s')} AS finestra_offerta_giorni, {_DAYS.format(a='p', b='u')} AS lag_perfezionamento_giorni, {_DAYS.format(a='p', b='m')} AS lag_comunicazione_esito_giorni,
        CASE WHEN lot > 0 AND (sec > lot) IS NOT TRUE THEN sec / lot END AS importo_sicurezza_pct, CASE WHEN (sec > lot) IS NOT TRUE THEN sec END AS importo_sicurezza, {_CODE.format(c='n_lotti_componenti')} AS n_lotti_componenti, {_CODE.format(c='cod_strumento_svolgimento')} AS cod_strumento_svolgimento, {_CODE.format(c='cod_motivo_urgenza')} AS cod_motivo_urgenza,
        coalesce({_CODE.format(c='flag_urgenza')}, 0) AS flag_urgenza, {_CODE.format(c='flag_delega')} AS flag_delega, coalesce(CAST(least(greatest({_NUMBER.format(c='flag_prev_ripetizioni')}, 0), 1) AS INTEGER), 0) AS flag_ripetizioni, CASE WHEN cig_accordo_quadro <> '' THEN 1 ELSE 0 END AS flag_accordo_quadro, CASE WHEN tipo_appalto_riservato <> '' THEN 1 ELSE 0 END AS flag_appalto_riservato,
        CASE WHEN contains(upper(settore), 'SPECIALI') THEN 1 ELSE 0 END AS settore_speciale, oggetto_principale_contratto, CASE WHEN contains(upper(sezione_regionale), 'CENTRALE') THEN 'CENTRALE' WHEN {_holds('upper(sezione_regionale)', 'REGIONALE', 'SEZIONE')} THEN 'REGIONALE' END AS sezione_regionale,
        CASE WHEN mode = 1 THEN 'APPALTO' WHEN mode = 7 THEN 'ECONOMIA' WHEN {_among('mode', 2, 9, 11, 17, 18)} THEN 'ACCORDO_QUADRO' WHEN {_among('mode', 3, 4, 20, 21)} THEN 'CONCESSIONE' WHEN {_among('mode', 5, 6, 8, 12, 13)} THEN 'PPP' WHEN {_among('mode', 10, 14, 15, 16, 19, 90, 999)} THEN 'ALTRO' END AS modalita_realizzazione_macro,
        CASE WHEN {_among('proc', '1', '9', '14', '27', '28', '29', '30')} THEN 'APERTA' WHEN {_among('proc', '3', '4', '5', '16', '40')} THEN 'NEGOZIATA' WHEN {_among('proc', '2', '10', '11', '12', '15', '26', '32', '33', '97')} THEN 'RISTRETTA'
             WHEN {_among('proc', '6', '7', '8', '13', '18', '19', '20', '21', '22', '23', '24', '25', '34', '35', '36', '37', '38', '98', '99', '114')} THEN 'AFFIDAMENTO_DIRETTO' END AS tipo_scelta_4cls,
        CASE WHEN trim(cod_cpv) = '' OR cod_cpv IS NULL THEN NULL WHEN {_among('cpv', '30', '48', '72')} THEN 'IT' WHEN {_among('cpv', '33', '85')} THEN 'SANITA' WHEN {_among('cpv', '44', '45')} THEN 'LAVORI' WHEN {_among('cpv', '71', '73', '79')} THEN 'ING_PROF'
             WHEN {_among('cpv', '50', '51', '55', '60', '63', '64', '65', '66', '70', '75', '76', '77', '80', '90', '92', '98')} THEN 'SERVIZI' ELSE 'FORNITURE' END AS cpv_macro_categoria,
        CASE WHEN e = 'AGGIUDICATA' THEN e WHEN {_holds('e', 'ANNULLAT', 'REVOCAT')} THEN 'ANNULLATA' WHEN contains(e, 'DESERTA') THEN 'DESERTA' WHEN contains(e, 'IN_CORSO') OR e = 'IN CORSO' THEN 'IN_CORSO' WHEN {_holds('e', 'SENZA ESITO', 'NON AGGIUDICATA', 'NON_AGGIUDICATA')} THEN 'SENZA_ESITO'
             WHEN contains(e, 'NESSUN VINCITORE') AND contains(e, 'CHIUSA') THEN 'SENZA_ESITO' WHEN {_holds('e', 'ANCORA IN CORSO', 'NON ANCORA')} THEN 'IN_CORSO' WHEN contains(e, 'PROPOSTA') THEN 'PROPOSTA' ELSE e END AS esito,
        greatest(least(coalesce(TRY_CAST(anno_pubblicazione AS INTEGER), 2025) - 1, 2024), 2007) AS anno, CASE WHEN regexp_full_match(trim(luogo_istat), '[0-9.]+') THEN CAST(substr(lpad(CAST(CAST(TRY_CAST(luogo_istat AS DOUBLE) AS BIGINT) AS VARCHAR), 6, '0'), 1, 3) AS INTEGER) END AS codice_provincia, codice_ausa, cf_amministrazione_appaltante
        FROM lines WHERE k = 1)""",
    "targets": "targets AS (SELECT fine.cig, trim(id_aggiudicazione) AS id FROM fine JOIN etichette ON fine.cig = etichette.cig AND label = 1 WHERE id_aggiudicazione IS NOT NULL)",
    "awards": f"""picked AS (SELECT agg.*, row_number() OVER (PARTITION BY agg.cig ORDER BY CASE WHEN trim(id_aggiudicazione) = id THEN 0 WHEN cod_modo_riaggiudicazione = '' THEN 1 ELSE 2 END, data_aggiudicazione_definitiva NULLS LAST, _row) AS k FROM agg LEFT JOIN targets ON agg.cig = targets.cig),
        numbers AS (SELECT *, {_COMMA.format(c='numero_offerte_ammesse')} AS am, {_COMMA.format(c='numero_offerte_escluse')} AS ex, {_COMMA.format(c='num_imprese_offerenti')} AS fi, {_COMMA.format(c='ribasso_aggiudicazione')} AS rb, {_COMMA.format(c='massimo_ribasso')} AS hi, {_COMMA.format(c='minimo_ribasso')} AS lo, {_COMMA.format(c='importo_aggiudicazione')} AS paid,
            {_WHEN.format(c='data_aggiudicazione_definitiva')} AS w FROM picked WHERE k = 1),
        awards AS (SELECT numbers.cig, w, paid AS importo_aggiudicazione, am AS numero_offerte_ammesse, ex AS numero_offerte_escluse, fi AS num_imprese_offerenti, CASE WHEN greatest(coalesce(fi, 0), coalesce(am, 0) + coalesce(ex, 0)) > 0 THEN ex / greatest(coalesce(fi, 0), coalesce(am, 0) + coalesce(ex, 0)) END AS pct_offerte_escluse,
            rb AS ribasso_aggiudicazione, hi - rb AS ribasso_spread, coalesce(abs(rb - lo) < 0.001, false) AS flag_vince_minimo, coalesce(trim(cig_prog_esterna) <> '', false) AS flag_progettazione_esterna, CASE WHEN w >= p THEN {_DAYS.format(a='p', b='w')} END AS lag_aggiudicazione_giorni,
            CASE WHEN importo_lotto > 0 THEN abs(paid - importo_lotto * (1 - rb / 100)) / importo_lotto END AS delta_coerenza_pct, coalesce(CAST({_NUMBER.format(c='asta_elettronica')} AS INTEGER), 0) AS asta_elettronica, coalesce(CAST({_NUMBER.format(c='flag_scomputo')} AS INTEGER), 0) AS flag_scomputo,
            coalesce(CAST({_NUMBER.format(c='flag_proc_accelerata')} AS INTEGER), 0) AS flag_proc_accelerata, split_part(trim(cod_esito), '.', 1) AS cod_esito FROM numbers LEFT JOIN base ON numbers.cig = base.cig)""",
    "winners": f"""named AS (SELECT cig, upper(trim(tipo_soggetto)) AS v, row_number() OVER (PARTITION BY cig ORDER BY coalesce(upper(trim(ruolo)) = 'MANDATARIA', false) DESC, _row) AS k FROM vincitori),
        winners AS (SELECT cig, CASE WHEN starts_with(v, 'IMPRESA SINGOLA') OR {_among('v', 'IMPRESA', 'DITTA INDIVIDUALE', 'MONOSOGGETTIVO')} THEN 'SINGOLA' WHEN starts_with(v, 'ATI') OR v = 'RTI' THEN 'ATI' WHEN starts_with(v, 'CONSORZIO') OR (NOT starts_with(v, 'GEIE') AND contains(v, 'CONSORZIO')) THEN 'CONSORZIO'
            WHEN starts_with(v, 'GEIE') THEN 'GEIE' WHEN v = 'STAZIONE APPALTANTE' THEN 'SA' ELSE 'ALTRO' END AS tipo_soggetto_agg FROM named WHERE k = 1)""",
    "authorities": f"""forms AS (SELECT ltrim(codice_ausa, '0') AS a, codice_fiscale AS f, upper(trim(natura_giuridica_descrizione)) AS v FROM sa),
        kinds AS (SELECT a, f, CASE WHEN {_holds('v', 'OSPEDALIERI', 'CURA, SOGGIORNO', 'DI PREVIDENZA E DI ASSIST', 'ISTITUTO PUBBLICO DI ASSIST', 'CASSE MUTUE', 'AZIENDA PUBBLICA DI SERVIZI ALLE PERSONE')} THEN 'SANITARIO' WHEN contains(v, 'ENTI PUBBLICI ECONOMICI') THEN 'EPE'
            WHEN {_holds('v', 'AMMINISTRAZIONI PUBBLICHE', 'COMUNE', 'ORGANI ED AMMIN', 'UNIONE DI COMUNI', 'CONSORZIO INTERCOMUNALE', 'CONSORZIO DI CUI AL DLGS', 'CONSORZI AI SENSI', 'CONSORZIO AI SENSI', 'CONSORZIO DI DIRITTO PUBBLICO')} THEN 'PA_ISTITUZIONALE'
            WHEN {_holds('v', 'ALTRI ENTI ED ISTITUTI', 'AZIENDA SPECIALE', 'ORDINE E COLLEGIO', 'ASSOCIAZIONI TRA PROFESSIONISTI', 'ENTE MORALE')} OR {_among('v', 'ENTE', 'ENTE ECCLESIASTICO')} THEN 'PA_ENTE' WHEN {_holds('v', 'FONDAZION', 'ASSOCIAZION', 'ORGANIZZAZIONI SENZA', 'OPERE PIE', 'ECCLESIASTIC')} THEN 'NON_PROFIT'
            WHEN contains(v, 'CONSORZI') THEN 'CONSORZIO' WHEN {_holds('v', "SOCIETA'", 'SOCIETA ', 'COOPERATIV', 'GEIE')} THEN 'SOCIETA' ELSE 'ALTRO' END AS kind FROM forms),
        by_a AS (SELECT a, min(kind) AS kind FROM kinds WHERE a IS NOT NULL GROUP BY a), by_f AS (SELECT f, min(kind) AS kind FROM kinds WHERE f IS NOT NULL GROUP BY f),
        authorities AS (SELECT cig, coalesce(by_a.kind, by_f.kind) AS natura_giuridica_SA FROM base LEFT JOIN by_a ON ltrim(regexp_replace(codice_ausa, '\\.0$', ''), '0') = by_a.a LEFT JOIN by_f ON cf_amministrazione_appaltante = by_f.f)""".replace("\\\\", "\\"),
    "budgets": f"""amounts AS (SELECT cig, descrizione_evento AS e, sum({_NUMBER.format(c='importo_sicurezza')}) AS sec, coalesce(sum({_NUMBER.format(c='importo_sicurezza')}), 0) + coalesce(sum({_NUMBER.format(c='importo_forniture')}), 0) + coalesce(sum({_NUMBER.format(c='importo_lavori')}), 0) + coalesce(sum({_NUMBER.format(c='importo_servizi')}), 0)
            + coalesce(sum({_NUMBER.format(c='ulteriori_oneri_non_soggetti_ribasso')}), 0) AS core, sum({_NUMBER.format(c='somme_a_disposizione')}) AS rest FROM quadro GROUP BY ALL),
        both_events AS (SELECT coalesce(b.cig, c.cig) AS cig, b.sec AS sicurezza_base_asta, b.rest / nullif(b.core, 0) AS x, c.core / nullif(b.core, 0) AS y, c.rest / nullif(b.core, 0) AS z FROM (SELECT * FROM amounts WHERE e = 'BASE_ASTA') b FULL JOIN (SELECT * FROM amounts WHERE e = 'CONSUNTIVO') c ON b.cig = c.cig),
        budgets AS (SELECT cig, sicurezza_base_asta, CASE WHEN x BETWEEN 0 AND 10 THEN x END AS pct_riserva_base, CASE WHEN y BETWEEN 0 AND 10 THEN y END AS pct_overrun_core, CASE WHEN z BETWEEN 0 AND 10 THEN z END AS pct_riserva_consumata FROM both_events)""",
    "starts": f"""begun AS (SELECT avvio.*, row_number() OVER (PARTITION BY avvio.cig ORDER BY coalesce(trim(id_aggiudicazione) = id, false) DESC, _row) AS k, {_WHEN.format(c='data_stipula_contratto')} AS g, {_WHEN.format(c='data_termine_contrattuale')} AS f, {_WHEN.format(c='data_inizio_effettiva')} AS i FROM avvio LEFT JOIN targets ON avvio.cig = targets.cig),
        starts AS (SELECT begun.cig, i, f, CASE WHEN g >= w THEN {_DAYS.format(a='w', b='g')} END AS lag_stipula_aggiudicazione_giorni, CASE WHEN f >= i THEN {_DAYS.format(a='i', b='f')} END AS durata_pianificata_giorni, CAST({_NUMBER.format(c='consegna_frazionata')} AS INTEGER) AS consegna_frazionata,
            CAST({_NUMBER.format(c='consegna_sotto_riserva')} AS INTEGER) AS consegna_sotto_riserva FROM begun LEFT JOIN awards ON begun.cig = awards.cig WHERE k = 1)""",
    "variants": f"""variants AS (SELECT cig, count(*) AS n_varianti, max(CASE WHEN {_among('TRY_CAST(cod_motivo_variante AS DOUBLE)', 17, 18, 19, 22, 96, 98, 99)} THEN 0 ELSE 1 END) AS flag_variante_sostanziale, min(least(greatest(CAST(data_approvazione_variante AS TIMESTAMP), TIMESTAMP '2000-01-01'), TIMESTAMP '2040-01-01')) FILTER (WHERE data_approvazione_variante IS NOT NULL) AS first FROM varianti GROUP BY cig)""",
    "suspensions": """suspensions AS (SELECT cig, count(*) AS n_sospensioni, CAST(coalesce(sum(greatest(CAST(data_ripresa AS DATE) - CAST(data_sospensione AS DATE), 0)) FILTER (WHERE data_ripresa IS NOT NULL), 0) AS BIGINT) AS durata_totale_sospensioni_gg, max(CASE WHEN descrizione_motivo = 'INTERVENTO AUTORITA'' GIUDIZIARIA' THEN 1 ELSE 0 END) AS flag_sosp_giudiziaria FROM sospensioni GROUP BY cig)""",
    "progress": f"""progress AS (SELECT cig, count(*) AS n_sal, max(CASE WHEN flag_ritardo = 'IN RITARDO' THEN 1 ELSE 0 END) AS flag_in_ritardo, max(CASE WHEN {_NUMBER.format(c='giorni_proroga')} > 0 THEN 1 ELSE 0 END) AS flag_proroga FROM sal GROUP BY cig)""",
    "works": """coded AS (SELECT cig, TRY_CAST(cod_tipo_lavorazione AS DOUBLE) AS c FROM lavorazioni), works AS (SELECT cig, CASE min(CASE WHEN c IN (6, 7) THEN 1 WHEN c IN (8, 9, 10) THEN 2 WHEN c IN (11, 12, 13, 14) THEN 3 ELSE 4 END) WHEN 1 THEN 'COSTRUZIONE' WHEN 2 THEN 'RISANAMENTO' WHEN 3 THEN 'MANUTENZIONE' END AS tipo_lavorazione_macro FROM coded WHERE c BETWEEN 1 AND 14 GROUP BY cig)""",
    "tests": "tests AS (SELECT cig, esito_collaudo FROM (SELECT *, row_number() OVER (PARTITION BY cig ORDER BY _row) AS k FROM collaudo) WHERE k = 1)",
    "subs": "subs AS (SELECT trim(cig) AS cig FROM subappalti UNION SELECT cig FROM (SELECT *, row_number() OVER (PARTITION BY cig ORDER BY _row) AS k FROM agg) WHERE k = 1 AND flag_subappalto = 'True')",
    "wide": f"""kept AS (SELECT base.* FROM base LEFT JOIN awards ON base.cig = awards.cig WHERE NOT coalesce({_among('esito', 'DESERTA', 'NON_AGGIUDICATA', 'IN_CORSO')}, false) OR coalesce({_among('cod_esito', '1', '5')}, false)),
        wide AS (SELECT kept.* EXCLUDE (importo_sicurezza, p), coalesce(importo_sicurezza, sicurezza_base_asta) AS importo_sicurezza, label, awards.* EXCLUDE (cig, w), tipo_soggetto_agg, natura_giuridica_SA, pct_riserva_base, pct_overrun_core, pct_riserva_consumata, starts.* EXCLUDE (cig, i, f),
            coalesce(n_varianti, 0) AS n_varianti, coalesce(flag_variante_sostanziale, 0) AS flag_variante_sostanziale, coalesce(n_sospensioni, 0) AS n_sospensioni, coalesce(durata_totale_sospensioni_gg, 0) AS durata_totale_sospensioni_gg, coalesce(flag_sosp_giudiziaria, 0) AS flag_sosp_giudiziaria,
            CASE WHEN n_sospensioni > 0 THEN 1 ELSE 0 END AS flag_sospensione, CASE WHEN n_sospensioni IS NULL THEN 0.0 WHEN durata_totale_sospensioni_gg / nullif(durata_pianificata_giorni, 0) BETWEEN 0 AND 10 THEN durata_totale_sospensioni_gg / durata_pianificata_giorni END AS pct_durata_sospesa,
            coalesce(n_sal, 0) AS n_sal, flag_in_ritardo, coalesce(flag_proroga, 0) AS flag_proroga, tipo_lavorazione_macro, esito_collaudo, CASE WHEN subs.cig IS NULL THEN 0 ELSE 1 END AS flag_subappalto, CASE WHEN first > f THEN 1 WHEN first <= f THEN 0 END AS flag_variante_oltre_termine,
            CASE WHEN {_DAYS.format(a='i', b='first')} / nullif(durata_pianificata_giorni, 0) BETWEEN 0 AND 10 THEN {_DAYS.format(a='i', b='first')} / durata_pianificata_giorni END AS pct_vita_prima_variante, CASE WHEN n_varianti > 0 THEN pct_overrun_core END AS pct_overrun_variante, tasso_disoccupazione, reddito_irpef_procapite, tasso_omicidi_100k
            FROM kept LEFT JOIN etichette ON kept.cig = etichette.cig LEFT JOIN awards ON kept.cig = awards.cig LEFT JOIN winners ON kept.cig = winners.cig LEFT JOIN authorities ON kept.cig = authorities.cig LEFT JOIN budgets ON kept.cig = budgets.cig LEFT JOIN starts ON kept.cig = starts.cig LEFT JOIN variants ON kept.cig = variants.cig
            LEFT JOIN suspensions ON kept.cig = suspensions.cig LEFT JOIN progress ON kept.cig = progress.cig LEFT JOIN works ON kept.cig = works.cig LEFT JOIN tests ON kept.cig = tests.cig LEFT JOIN subs ON kept.cig = subs.cig LEFT JOIN contesto ON kept.codice_provincia = contesto.codice_provincia AND kept.anno = contesto.anno)""",
}
#: What each part is made from: raw tables, then parts in order.
NEEDS = {
    "base": (["cig"], ["lines", "base"]), "awards": (["cig", "fine", "etichette", "agg"], ["lines", "base", "targets", "awards"]), "winners": (["vincitori"], ["winners"]), "authorities": (["cig", "sa"], ["lines", "base", "authorities"]), "budgets": (["quadro"], ["budgets"]),
    "starts": (["cig", "fine", "etichette", "agg", "avvio"], ["lines", "base", "targets", "awards", "starts"]), "variants": (["varianti"], ["variants"]), "suspensions": (["sospensioni"], ["suspensions"]), "progress": (["sal"], ["progress"]), "works": (["lavorazioni"], ["works"]), "tests": (["collaudo"], ["tests"]),
    "subs": (["agg", "subappalti"], ["subs"]), "wide": (["cig", "fine", "etichette", "agg", "vincitori", "sa", "quadro", "avvio", "varianti", "sospensioni", "sal", "lavorazioni", "collaudo", "subappalti", "contesto"], [k for k in PARTS]),
}


def rule(part: str, columns: str) -> str:
    """SQL over a part and what it needs."""
    raws, parts = NEEDS[part]
    return f"WITH {_sql(*raws)}, {', '.join(PARTS[p] for p in parts)} SELECT {columns} FROM {part}"


def _plain(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns, doubles rounded and small integers as int."""
    kinds = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if kinds[c] == "double" else F.col(c).cast("int").alias(c) if kinds[c] == "tinyint" else F.col(c) for c in names])


def _rounded(names: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in names)


_BASE = ["cig", "importo_lotto", "importo_complessivo_gara", "finestra_offerta_giorni", "lag_perfezionamento_giorni", "lag_comunicazione_esito_giorni", "importo_sicurezza_pct", "importo_sicurezza", "n_lotti_componenti", "cod_strumento_svolgimento", "cod_motivo_urgenza", "flag_urgenza", "flag_delega", "flag_ripetizioni", "flag_accordo_quadro", "flag_appalto_riservato", "settore_speciale", "oggetto_principale_contratto", "sezione_regionale", "modalita_realizzazione_macro", "tipo_scelta_4cls", "cpv_macro_categoria", "esito", "anno", "codice_provincia"]
_AWARD = ["cig", "importo_aggiudicazione", "numero_offerte_ammesse", "numero_offerte_escluse", "num_imprese_offerenti", "pct_offerte_escluse", "ribasso_aggiudicazione", "ribasso_spread", "flag_vince_minimo", "flag_progettazione_esterna", "lag_aggiudicazione_giorni", "delta_coerenza_pct", "asta_elettronica", "flag_scomputo", "flag_proc_accelerata", "cod_esito"]
_DOUBLES = {"importo_lotto", "importo_complessivo_gara", "importo_sicurezza_pct", "importo_sicurezza", "importo_aggiudicazione", "numero_offerte_ammesse", "numero_offerte_escluse", "num_imprese_offerenti", "pct_offerte_escluse", "ribasso_aggiudicazione", "ribasso_spread", "delta_coerenza_pct", "pct_riserva_base", "pct_overrun_core", "pct_riserva_consumata", "pct_durata_sospesa", "pct_vita_prima_variante", "pct_overrun_variante", "tasso_disoccupazione", "reddito_irpef_procapite", "tasso_omicidi_100k"}


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return features.award_targets(raw(spark, d, "etichette").filter("label = 1"), raw(spark, d, "fine"))


@query(rule("base", _rounded(_BASE, _DOUBLES)))
def feature_contracts(spark: SparkSession, d: str) -> DataFrame:
    """The base table: one row per contract from its prevalent lines."""
    return _plain(features.contracts(raw(spark, d, "cig")), _BASE)


@query(rule("awards", _rounded(_AWARD, _DOUBLES)))
def feature_awards(spark: SparkSession, d: str) -> DataFrame:
    return _plain(features.awards(raw(spark, d, "agg"), features.contracts(raw(spark, d, "cig")), _targets(spark, d)), _AWARD)


@query(rule("winners", "*"))
def feature_winners(spark: SparkSession, d: str) -> DataFrame:
    return features.winners(raw(spark, d, "vincitori"))


@query(rule("authorities", "*"))
def feature_authorities(spark: SparkSession, d: str) -> DataFrame:
    """Legal form by one code, else by another; null codes match nothing."""
    return features.authorities(features.contracts(raw(spark, d, "cig")), raw(spark, d, "sa"))


@query(rule("budgets", "cig, round(sicurezza_base_asta, 6) AS sicurezza_base_asta, round(pct_riserva_base, 6) AS pct_riserva_base, round(pct_overrun_core, 6) AS pct_overrun_core, round(pct_riserva_consumata, 6) AS pct_riserva_consumata") + " WHERE cig IN (SELECT cig FROM amounts WHERE e IN ('BASE_ASTA', 'CONSUNTIVO'))")
def feature_budgets(spark: SparkSession, d: str) -> DataFrame:
    return _plain(features.budgets(raw(spark, d, "quadro")), ["cig", "sicurezza_base_asta", "pct_riserva_base", "pct_overrun_core", "pct_riserva_consumata"])


@query(rule("variants", "cig, n_varianti, flag_variante_sostanziale, strftime(first, '%Y-%m-%d') AS prima_variante"))
def feature_variants(spark: SparkSession, d: str) -> DataFrame:
    return features.variants(raw(spark, d, "varianti")).withColumn("prima_variante", F.col("prima_variante").cast("date").cast("string"))


@query(rule("suspensions", "*"))
def feature_suspensions(spark: SparkSession, d: str) -> DataFrame:
    return features.suspensions(raw(spark, d, "sospensioni"))


@query(rule("progress", "*"))
def feature_progress(spark: SparkSession, d: str) -> DataFrame:
    return features.progress(raw(spark, d, "sal"))


@query(rule("works", "*"))
def feature_works(spark: SparkSession, d: str) -> DataFrame:
    return features.works(raw(spark, d, "lavorazioni"))


@query(rule("tests", "*"))
def feature_tests(spark: SparkSession, d: str) -> DataFrame:
    return features.tests_passed(raw(spark, d, "collaudo"))


@query(rule("subs", "cig, 1 AS flag_subappalto"))
def feature_subcontracts(spark: SparkSession, d: str) -> DataFrame:
    return features.subcontracted(raw(spark, d, "agg"), raw(spark, d, "subappalti"))


_START = ["cig", "lag_stipula_aggiudicazione_giorni", "durata_pianificata_giorni", "consegna_frazionata", "consegna_sotto_riserva"]


@query(rule("starts", ", ".join(_START)))
def feature_starts(spark: SparkSession, d: str) -> DataFrame:
    targets = _targets(spark, d)
    awarded = features.awards(raw(spark, d, "agg"), features.contracts(raw(spark, d, "cig")), targets)
    return _plain(features.starts(raw(spark, d, "avvio"), awarded, targets), _START)


# --- the nested datasets, from raw columns only ---

FILES = {"cig": "cig", "aggiudicazioni": "agg", "aggiudicatari": "vincitori", "stazioni-appaltanti": "sa", "quadro-economico": "quadro", "avvio-contratto": "avvio", "fine-contratto": "fine", "varianti": "varianti", "sospensioni": "sospensioni", "stati-avanzamento": "sal", "lavorazioni": "lavorazioni", "collaudo": "collaudo", "subappalti": "subappalti", "contesto_province": "contesto"}
_SIGNS = "(lag_stipula_aggiudicazione_giorni IS NOT NULL OR n_sal > 0 OR n_varianti > 0 OR n_sospensioni > 0)"
STAGE_ROWS = {"M1": "true", "M2": "esito = 'AGGIUDICATA'", "M3": f"esito = 'AGGIUDICATA' AND {_SIGNS}"}
_COLUMNS = {"M1": ["cig", "label", *datasets.M1], "M2": ["cig", "label", *datasets.M1, *datasets.M2_MORE], "M3": ["cig", "label", *datasets.M1, *datasets.M2_MORE, *datasets.M3_MORE]}


def wide(spark: SparkSession, d: str, files: Iterable[str] = tuple(FILES)) -> DataFrame:
    """The wide table of all raw tables, or of some files."""
    return features.wide_table({file: raw(spark, d, FILES[file]) for file in files}, raw(spark, d, "etichette"))


def _native(stage: str) -> str:
    return rule("wide", _rounded(_COLUMNS[stage], _DOUBLES)) + f" WHERE {STAGE_ROWS[stage]}"


@query(_native("M1"))
def dataset_m1(spark: SparkSession, d: str) -> DataFrame:
    """Every contract with what is known when it is tendered."""
    return _plain(datasets.native(datasets.stages(wide(spark, d))["M1"], "M1"), _COLUMNS["M1"])


@query(_native("M2"))
def dataset_m2(spark: SparkSession, d: str) -> DataFrame:
    """Awarded contracts."""
    return _plain(datasets.native(datasets.stages(wide(spark, d))["M2"], "M2"), _COLUMNS["M2"])


@query(_native("M3"))
def dataset_m3(spark: SparkSession, d: str) -> DataFrame:
    """Contracts in execution."""
    return _plain(datasets.native(datasets.stages(wide(spark, d))["M3"], "M3"), _COLUMNS["M3"])


def _banded(c: str) -> str:
    whens = ["WHEN {} < 0 THEN '<0'".format(c)] if c in datasets.NEGATIVE else []
    for name, *limits in datasets.BANDS[c]:
        inside = f"{c} IN ({', '.join(map(str, limits[0]))})" if isinstance(limits[0], list) else " AND ".join([f"{c} > {limits[0]}"] * (limits[0] is not None) + [f"{c} <= {limits[1]}"] * (limits[1] is not None))
        whens.append(f"WHEN {inside} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE 'MISSING' END"


def _prepared(c: str) -> str:
    if c in datasets.BANDS:
        return _banded(c)
    if c in datasets.FLAGS:
        return f"CASE CAST({c} AS INTEGER) WHEN 1 THEN '1' WHEN 0 THEN '0' ELSE 'MISSING' END"
    if c in datasets.CODES:
        return f"coalesce(CAST({c} AS VARCHAR), 'MISSING')"
    if c in datasets.CONSTANTS:
        return f"round(coalesce({c}, {datasets.CONSTANTS[c]}), 6)" if c in _DOUBLES else f"coalesce({c}, {datasets.CONSTANTS[c]})"
    if c in datasets.MODES:
        return f"coalesce({c}, mode_{c})"
    if c == "importo_complessivo_gara":
        return f"round(coalesce({c}, med_{c}), 6)"
    if c in ("finestra_offerta_giorni", "lag_perfezionamento_giorni"):
        return f"coalesce(CAST({c} AS DOUBLE), round_even(med_{c}, 0))"
    if c == "tasso_disoccupazione":
        return f"CASE WHEN {c} IS NULL THEN 'MISSING' WHEN {c} <= qt[2] THEN 'Q1' WHEN {c} <= qt[3] THEN 'Q2' WHEN {c} <= qt[4] THEN 'Q3' ELSE 'Q4' END"
    if c == "importo_aggiudicazione":
        return f"CASE WHEN {c} = 0 THEN 'Q1' WHEN ({c} > 0) IS NOT TRUE THEN 'MISSING' WHEN ln(1 + {c}) <= qi[1] THEN 'Q1' WHEN ln(1 + {c}) <= qi[2] THEN 'Q2' WHEN ln(1 + {c}) <= qi[3] THEN 'Q3' ELSE 'Q4' END"
    if c in ("modalita_realizzazione_macro", "sezione_regionale", "cpv_macro_categoria", "tipo_soggetto_agg", "esito_collaudo"):
        return f"coalesce({c}, 'MISSING')"
    return f"round({c}, 6)" if c in _DOUBLES else c


_GONE = ("pct_overrun_core", "pct_riserva_consumata", "pct_overrun_variante", "pct_vita_prima_variante")
_MODE = "(SELECT {c} FROM wide WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_{c}"
_STATISTICS = f"""stats AS (SELECT median(importo_complessivo_gara) FILTER (WHERE importo_complessivo_gara > 0) AS med_importo_complessivo_gara, median(finestra_offerta_giorni) FILTER (WHERE finestra_offerta_giorni > 0) AS med_finestra_offerta_giorni,
    median(lag_perfezionamento_giorni) FILTER (WHERE lag_perfezionamento_giorni > 0) AS med_lag_perfezionamento_giorni, quantile_cont(tasso_disoccupazione, [0, 0.25, 0.5, 0.75, 1]) AS qt, quantile_cont(ln(1 + importo_aggiudicazione), [0.25, 0.5, 0.75]) FILTER (WHERE esito = 'AGGIUDICATA' AND importo_aggiudicazione > 0) AS qi,
    {', '.join(_MODE.format(c=c) for c in datasets.MODES)} FROM wide)"""


@query(rule("wide", "*").replace("SELECT * FROM wide", "") + f""", {_STATISTICS} SELECT {', '.join(f'{_prepared(c)} AS {c}' for c in _COLUMNS['M3'] if c not in _GONE)}, CASE WHEN pct_overrun_core IS NULL THEN 0 ELSE 1 END AS flag_consuntivo_presente FROM wide, stats WHERE {STAGE_ROWS['M3']}""")
def dataset_m3_preprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Contracts in execution, imputed and binned by statistics of all contracts."""
    stats = datasets.statistics(wide(spark, d, datasets.STATISTICS_FILES))
    made = datasets.preprocessed(datasets.stages(wide(spark, d))["M3"], "M3", stats)
    return _plain(made, made.columns)


# --- sanity checks ---

_AUDIT = rule("wide", "*").replace("SELECT * FROM wide", "").rstrip() + """, counts AS (SELECT cig, count(*) AS n_awards FROM agg GROUP BY cig), codes AS (SELECT DISTINCT ltrim(codice_ausa, '0') AS a FROM sa WHERE codice_ausa IS NOT NULL), rows AS (SELECT cig, count(*) AS n_rows FROM wide GROUP BY cig),
    audit AS (SELECT wide.*, n_rows, n_awards, w, base.p, i, f, begun.g, first, base.importo_sicurezza AS bando, amounts.sec AS budget, amounts.core, nullif(ltrim(regexp_replace(wide.codice_ausa, '[.]0$', ''), '0'), '') AS ausa, codes.a AS known, lines.sec > lines.lot AS over
        FROM wide JOIN rows ON wide.cig = rows.cig LEFT JOIN counts ON wide.cig = counts.cig JOIN base ON wide.cig = base.cig JOIN lines ON wide.cig = lines.cig AND lines.k = 1 LEFT JOIN awards ON wide.cig = awards.cig LEFT JOIN begun ON wide.cig = begun.cig AND begun.k = 1
        LEFT JOIN variants ON wide.cig = variants.cig LEFT JOIN amounts ON wide.cig = amounts.cig AND amounts.e = 'BASE_ASTA' LEFT JOIN codes ON nullif(ltrim(regexp_replace(wide.codice_ausa, '[.]0$', ''), '0'), '') = codes.a),
    bids AS (SELECT *, coalesce(numero_offerte_ammesse, 0) + coalesce(numero_offerte_escluse, 0) AS total, abs(num_imprese_offerenti - total) AS off FROM audit)"""
#: (rule, rows that are asked, rows that break it, most percent that is OK, status beyond).
_RULES = [
    ("SC-01 one row a contract", "true", "n_rows > 1", 0, "ERROR"), ("SC-02 award not before tender", "w IS NOT NULL", "w < p", 0, "HANDLED"), ("SC-03 coherence can be told", "true", "delta_coerenza_pct IS NULL", 90, "WARNING"), ("SC-03 coherence within 20%", "delta_coerenza_pct IS NOT NULL", "delta_coerenza_pct > 0.2", None, ""),
    ("SC-03 coherence within 50%", "delta_coerenza_pct IS NOT NULL", "delta_coerenza_pct > 0.5", None, ""), ("SC-05 security within the lot", "over IS NOT NULL", "over", 1, "WARNING"), ("SC-06a start before end", "i IS NOT NULL AND f IS NOT NULL", "i > f", 1, "WARNING"), ("SC-06b award before signing", "w IS NOT NULL AND g IS NOT NULL", "w > g", 10, "WARNING"),
    ("SC-09 lots and awards agree", "n_lotti_componenti IS NOT NULL AND n_awards IS NOT NULL", "n_lotti_componenti <> n_awards", None, ""), ("SC-10 authority is known", "ausa IS NOT NULL", "known IS NULL", 1, "WARNING"), ("SC-11 security as in the budget", "bando IS NOT NULL AND budget IS NOT NULL", "abs(bando - budget) > abs(bando) * 0.01", None, ""),
    ("SC-12 lot as in the budget", "importo_lotto IS NOT NULL AND core IS NOT NULL", "abs(importo_lotto - core) > abs(importo_lotto) * 0.05", None, ""), ("SC-13a awarded with award", "esito = 'AGGIUDICATA'", "importo_aggiudicazione IS NULL", None, ""),
    ("SC-13c condemned were awarded", "label = 1", "esito IN ('DESERTA', 'NON_AGGIUDICATA', 'IN_CORSO') AND coalesce(cod_esito NOT IN ('1', '5'), true)", 0, "WARNING"), ("SC-OFFERTE bids add up", "num_imprese_offerenti IS NOT NULL AND total > 0", "off <> 0", 20, "WARNING"), ("SC-OFFERTE bids within 2", "num_imprese_offerenti IS NOT NULL AND total > 0", "off > 2", None, ""),
    ("SC-OFFERTE bids within 10", "num_imprese_offerenti IS NOT NULL AND total > 0", "off > 10", None, ""), ("SC-VAR-1 variant after award", "first IS NOT NULL AND w IS NOT NULL", "first < w", None, ""),
]


def _judged(counts: str, most: float | None, otherwise: str) -> str:
    status = "'INFO'" if most is None else f"CASE WHEN coalesce(100.0 * broken / nullif(asked, 0), 0) <= {most} THEN 'OK' ELSE '{otherwise}' END"
    return f"SELECT rule, {status} AS status, asked, broken, round(coalesce(100.0 * broken / nullif(asked, 0), 0), 6) AS pct FROM ({counts})"


_SUITE = " UNION ALL ".join([
    *[_judged(f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {asked}) AS asked, count(*) FILTER (WHERE ({asked}) AND ({broken})) AS broken FROM bids", most, otherwise) for name, asked, broken, most, otherwise in _RULES],
    _judged("SELECT 'SC-07 winner took part' AS rule, count(*) FILTER (WHERE c.cig IS NOT NULL) AS asked, count(*) FILTER (WHERE c.cig IS NOT NULL AND q.cig IS NULL) AS broken FROM vincitori v LEFT JOIN (SELECT DISTINCT cig, trim(codice_fiscale) AS cf FROM partecipanti) q ON v.cig = q.cig AND v.codice_fiscale = q.cf LEFT JOIN (SELECT DISTINCT cig FROM partecipanti) c ON v.cig = c.cig", 10, "WARNING"),
    _judged("SELECT 'SC-08 on one list only' AS rule, count(*) AS asked, count(*) FILTER (WHERE n > 1) AS broken FROM (SELECT cig, count(DISTINCT label) AS n FROM etichette WHERE label IS NOT NULL GROUP BY cig)", 0, "ERROR"),
])


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return features.audit_frame({file: raw(spark, d, name) for file, name in FILES.items()}, raw(spark, d, "etichette"))


@query(_AUDIT + f", partecipanti AS ({RAW['partecipanti'].format(lineitem='lineitem')}) {_SUITE}")
def sanity_suite(spark: SparkSession, d: str) -> DataFrame:
    """All sanity checks of the wide table, the winners and the label lists, with how many rows each could judge."""
    told = raw(spark, d, "etichette")
    made = sanity.check(_audit(spark, d), sanity.contract_rules())
    made = made.unionByName(sanity.check(sanity.participant_frame(raw(spark, d, "vincitori"), raw(spark, d, "partecipanti")), sanity.participant_rules()))
    made = made.unionByName(sanity.check(sanity.list_frame(told.filter("label = 1"), told.filter("label = 0")), sanity.list_rules()))
    return made.withColumn("pct", r6("pct"))


@query(_AUDIT + " SELECT rule, CAST(rank AS INTEGER) AS rank, cig FROM (SELECT rule, cig, row_number() OVER (PARTITION BY rule ORDER BY cig) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS rule, cig FROM bids WHERE ({asked}) AND ({broken})" for name, asked, broken, _, _ in _RULES) + ")) WHERE rank <= 10")
def sanity_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first contracts that break each check."""
    return sanity.samples(_audit(spark, d), "cig", sanity.contract_rules())


@query(rule("wide", "esito, cod_esito, count(*) AS n") + " GROUP BY ALL")
def sanity_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """SC-16: contracts by outcome of tender and of award."""
    return wide(spark, d).groupBy("esito", "cod_esito").agg(F.count("*").alias("n"))


#: Features whose labelled values are compared: budgets, variants, suspensions, reports and subcontracts.
_CONTRASTS = ["pct_riserva_base", "pct_overrun_core", "pct_riserva_consumata", "n_varianti", "flag_variante_sostanziale", "n_sospensioni", "flag_sospensione", "durata_totale_sospensioni_gg", "pct_durata_sospesa", "flag_sosp_giudiziaria", "n_sal", "flag_in_ritardo", "flag_proroga", "flag_subappalto", "delta_coerenza_pct"]


@query(rule("wide", "*").replace("SELECT * FROM wide", "") + " " + " UNION ALL ".join(f"SELECT label, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median FROM wide WHERE label IS NOT NULL GROUP BY label" for c in _CONTRASTS))
def sanity_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median of execution features among condemned and among acquitted contracts."""
    return sanity.contrasts(wide(spark, d), "label", _CONTRASTS).withColumns({"mean": r6("mean"), "median": r6("median")})


# --- learners over folds and gammas ---

#: The gammas of the grid.
GAMMAS = (0.0, 0.05, 0.1, 0.2, 0.33, 0.5, 0.66, 0.8, 0.9, 1.0)


@query()
def boosted_grid(spark: SparkSession, d: str) -> DataFrame:
    """For each gamma: mean and deviation over folds of the out-of-fold metrics of boosted trees under the nnPU risk."""
    x = _features(spark, d).withColumn("stratum", F.coalesce(F.col("label").cast("string"), F.lit("U")))
    return boost.gamma_grid(_once(panel.stratified_folds(_once(x), ["stratum"], "doc_id")), "doc_id", FEATURES, GAMMAS, prior=0.5)[1]



@query()
def nested_cv_choices(spark: SparkSession, d: str) -> DataFrame:
    """For each outer fold the parameters that its other folds choose, and their mean lift over inner folds."""
    x = _features(spark, d).withColumn("stratum", F.coalesce(F.col("label").cast("string"), F.lit("U")))
    combos = tuning.grid(leaves=[7, 15, 31], least=[10, 20, 50])
    return tuning.nested_cv(_once(panel.stratified_folds(_once(x), ["stratum"], "doc_id")), "doc_id", FEATURES, combos, prior=0.5, inner_options={"rounds": 40, "rate": 0.1, "hold": 0.0}, rounds=200, rate=0.05)[1]


def _refitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Features of documents, and one boosted model of all of them."""
    x = _once(_features(spark, d))
    return x, boost.fit_models(x, "doc_id", FEATURES, "nnpu", [0.33], 0.5, fold=None)


@query()
def shap_importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute Shapley value of each feature over all documents."""
    x, models = _refitted(spark, d)
    return shap.importance(shap.explain(x, "doc_id", FEATURES, models), FEATURES)


@query()
def shap_rows(spark: SparkSession, d: str) -> DataFrame:
    """The two features that move each document's score most."""
    x, models = _refitted(spark, d)
    return shap.top_features(shap.explain(x, "doc_id", FEATURES, models), "doc_id", FEATURES, 2)


@query()
def score_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Rank and band of every document as an upload, of which some know no size and only English ones know `upper`."""
    x = _once(_features(spark, d))
    registry = {1: ["size", "odd"], 2: ["upper"]}
    reference = {k: x.select(F.col("doc_id").alias("_id"), "label", *[c for s in registry if s <= k for c in registry[s]]) for k in registry}
    lang = t(spark, d, "documents").select("doc_id", "lang")
    known = x.join(lang, "doc_id").select("doc_id", F.when(F.col("lang") != "fr", F.col("size")).alias("size"), "odd", F.when(F.col("lang") == "en", F.col("upper")).alias("upper"))
    return scoring.score_uploads(known, "doc_id", reference, registry, prior=0.5)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """Scored documents in four folds."""
    x = scored(spark, d).withColumn("stratum", F.coalesce(F.col("label").cast("string"), F.lit("U")))
    return panel.stratified_folds(x, ["stratum"], "doc_id")


@query()
def platt_by_fold(spark: SparkSession, d: str) -> DataFrame:
    """Platt scaling of each fold, their mean, and of all labelled documents."""
    return intervals.platt_table(_folded(spark, d))


@query()
def score_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Interval of every document's calibrated score over 200 replicates of the other folds' scaling, and at a prior of 0.02."""
    x = _folded(spark, d)
    rate = x.agg(F.avg(F.col("label").cast("double"))).first()[0]
    return intervals.intervals(intervals.calibrated_replicates(x, "doc_id"), "doc_id", F.col("probs"), 0.02, rate)


@query()
def pu_scorer_priors(spark: SparkSession, d: str) -> DataFrame:
    """Class priors from out-of-fold scores of positives against the rest: by positives' mean score, and by quantiles."""
    scores = _once(tuning.pu_scores(_once(_features(spark, d)), "doc_id", FEATURES))
    pu_ = scores.withColumn("label", F.when(F.col("label") == 1, 1))
    return pu.elkan_noto(pu_).select(F.lit("elkan_noto").alias("method"), "prior").unionByName(pu.blanchard(pu_).select(F.lit("quantile").alias("method"), "prior"))
