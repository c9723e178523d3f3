"""CSV recovery, the wide table, the nested datasets and ranks with unknown scores, on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from contractscope.operators import metrics, panel
from contractscope.plans import datasets, features
from contractscope.sources import tables


def test_recover_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('CIG;Esito;NOTE\nA1;citt\xe0;x\n\nB2;ok\nC3;a;b;c;d\n"D;4";"q""q";z\r\n'.encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿CIG;Esito;NOTE\nE5;perché;y\n".encode())
    (tmp_path / "c.csv").write_bytes(b"CIG;Esito;NOTE\nF6;\x81\xe9;\n")
    df = tables.recover_csv(spark, str(tmp_path))
    assert df.columns == ["CODICE_CIG", "ESITO_PROVVEDIMENTO", "NOTE", "_source_file"]
    assert sorted(map(tuple, df.collect())) == [("A1", "città", "x", "a.csv"), ("B2", "ok", "", "a.csv"), ("C3", "a", "b;c;d", "a.csv"), ("D;4", 'q"q', "z", "a.csv"), ("E5", "perché", "y", "b.csv"), ("F6", "\x81é", "", "c.csv")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_bytes(b"\n \n")
    assert tables.recover_csv(spark, str(tmp_path / "empty")).count() == 0


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Cig;A \n1;x\n")
    (tmp_path / "2.csv").write_text("cig;b\n2;y\n")
    df = tables.read_many_csv(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")])
    assert sorted(map(tuple, df.select("cig", "a", "b", "_source_file").collect())) == [("1", "x", None, "1.csv"), ("2", None, "y", "2.csv")]
    known, missing = tables.select_known(df, ["CIG", "zz"])
    assert (known.columns, missing) == (["CIG"], ["zz"])
    assert tables.read_text_csv(spark, str(tmp_path / "1.csv"), columns=["A"]).columns == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(" 1", "x "), ("1", "x"), (None, "y")], "c string, d string")
    assert [tuple(r) for r in tables.lookup_table(df, "c", "d").collect()] == [("1", "x")]
    path = tables.write_version(df, str(tmp_path), "v1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_version(df, str(tmp_path), "v1")
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep=";", header=True).count() == 3
    wide = spark.createDataFrame([("p", 1.0, 2.0)], "id string, `2001` double, `2002` double")
    assert sorted(map(tuple, tables.wide_years(wide, ["id"]).collect())) == [("p", 2001, 1.0), ("p", 2002, 2.0)]


def event_tables(spark):
    text = lambda names, rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    cig = "cig flag_prevalente cod_cpv data_pubblicazione data_scadenza_offerta data_ultimo_perfezionamento data_comunicazione_esito importo_complessivo_gara importo_lotto importo_sicurezza flag_urgenza flag_delega flag_prev_ripetizioni cig_accordo_quadro settore cod_modalita_realizzazione cod_tipo_scelta_contraente esito anno_pubblicazione luogo_istat codice_ausa cf_amministrazione_appaltante n_lotti_componenti oggetto_principale_contratto sezione_regionale cod_strumento_svolgimento cod_motivo_urgenza tipo_appalto_riservato"
    base = ["1", "45000000", "2015-01-01", "2015-02-01", "2015-01-05", "2015-03-11", "1000", "500,5", None, "1", "0", None, None, "ORDINARI", "1", "1", "AGGIUDICATA", "2015", "1001", "7.0", "CF", "1", "LAVORI", "Sezione regionale LAZIO", "1", None, "legge"]
    return {
        "cig": text(cig, [["A", *base], ["B", *base[:16], "DESERTA", *base[17:]], ["C", *base]]),
        "aggiudicazioni": text("cig id_aggiudicazione data_aggiudicazione_definitiva importo_aggiudicazione numero_offerte_ammesse numero_offerte_escluse num_imprese_offerenti ribasso_aggiudicazione massimo_ribasso minimo_ribasso cig_prog_esterna cod_modo_riaggiudicazione asta_elettronica flag_scomputo flag_proc_accelerata flag_subappalto cod_esito", [
            ["A", "1", "2015-03-01", "400", "3", "1", "4", "10", "12", "10", None, None, "1", "0", None, "False", "1"], ["C", "2", "2015-03-01", "300", "1", None, "1", "5", "5", "5", None, None, None, None, None, "False", "2.0"]]),
        "aggiudicatari": text("cig codice_fiscale id_aggiudicazione ruolo tipo_soggetto", [["A", "f", "1", None, "RTI"]]),
        "stazioni-appaltanti": text("codice_fiscale codice_ausa natura_giuridica_descrizione", [["CF", "007", "COMUNE"]]),
        "avvio-contratto": text("cig id_aggiudicazione data_stipula_contratto data_termine_contrattuale data_inizio_effettiva consegna_frazionata consegna_sotto_riserva", [["A", "1", "2015-04-01", "2015-07-10", "2015-04-01", "1", None]]),
        "quadro-economico": text("cig importo_sicurezza importo_forniture importo_lavori importo_progettazione importo_servizi ulteriori_oneri_non_soggetti_ribasso somme_a_disposizione descrizione_evento", [["A", "10", None, "90", None, None, None, "20", "BASE_ASTA"], ["A", "50", None, "100", None, None, None, "5", "CONSUNTIVO"]]),
        "varianti": text("cig data_approvazione_variante cod_motivo_variante", [["A", "2015-08-01", None], ["A", "2015-08-09", "17.0"]]),
        "sospensioni": text("cig data_sospensione data_ripresa descrizione_motivo", [["A", "2015-05-01", "2015-05-11", "INTERVENTO AUTORITA' GIUDIZIARIA"], ["A", "2015-06-01", None, None]]),
        "stati-avanzamento": text("cig flag_ritardo giorni_proroga", [["A", "IN RITARDO", "0"]]),
        "lavorazioni": text("cig cod_tipo_lavorazione", [["A", "7"], ["A", "2"]]),
        "collaudo": text("cig esito_collaudo", [["A", "POSITIVO"]]),
        "subappalti": text("cig", [["A"], ["A"]]),
        "contesto_province": spark.createDataFrame([(1, 2014, 8.5, 20000.0, 0.7)], "codice_provincia int, anno int, tasso_disoccupazione double, reddito_irpef_procapite double, tasso_omicidi_100k double"),
    }


def test_wide_table_and_datasets(spark):
    labels = spark.createDataFrame([("A", 1), ("B", 0)], "cig string, label int")
    assert sorted(r.cig for r in features.wide_table(event_tables(spark), labels).select("cig").collect()) == ["A", "C"]  # B has no award
    wide = features.wide_table(event_tables(spark), labels, filter_outcomes=False).cache()
    assert wide.count() == 3
    a = wide.filter("cig = 'A'").first()
    assert (a.n_varianti, a.flag_variante_sostanziale, a.flag_variante_oltre_termine, a.delta_prima_variante_giorni) == (2, 1, 1, 153)
    assert (a.durata_pianificata_giorni, a.pct_vita_prima_variante, a.pct_overrun_core, a.pct_overrun_variante) == (100, 1.22, 1.5, 1.5)
    assert (a.n_sospensioni, a.durata_totale_sospensioni_gg, a.pct_durata_sospesa, a.flag_sospensione) == (2, 10, 0.1, 1)
    assert (a.flag_subappalto, a.natura_giuridica_SA, a.tipo_soggetto_agg, a.n_sal, a.esito_collaudo, a.label, a.tasso_disoccupazione) == (1, "PA_ISTITUZIONALE", "ATI", 1, "POSITIVO", 1, 8.5)
    assert (a.pct_riserva_base, a.pct_riserva_consumata, a.importo_sicurezza, a.importo_sicurezza_pct) == (0.2, 0.05, 10.0, None)  # both over the tender's core; security from the budget
    assert (a.lag_comunicazione_esito_giorni, a.sezione_regionale, a.flag_appalto_riservato, a.tipo_lavorazione_macro, a.regione) == (69, "REGIONALE", 1, "COSTRUZIONE", "Piemonte")
    assert abs(a.delta_coerenza_pct - abs(400 - 500.5 * 0.9) / 500.5) < 1e-12
    c = wide.filter("cig = 'C'").first()
    assert (c.n_varianti, c.n_sal, c.flag_in_ritardo, c.flag_variante_oltre_termine, c.flag_subappalto, c.label) == (0, 0, None, None, 0, None)
    sets = datasets.stages(wide)
    assert {k: sorted(r.cig for r in v.select("cig").collect()) for k, v in sets.items()} == {"M1": ["A", "B", "C"], "M2": ["A", "C"], "M3": ["A"]}
    with pytest.raises(ValueError, match="flag_urgenza"):
        datasets.native(sets["M1"].drop("flag_urgenza"), "M1")
    stats = datasets.statistics(wide)
    for k, v in sets.items():
        assert datasets.native(v, k).count() == v.count()
    made = datasets.preprocessed(sets["M3"], "M3", stats).first()
    assert (made.flag_consuntivo_presente, made.reddito_irpef_procapite, made.numero_offerte_ammesse, made.esito_collaudo) == (1, "(18K-22K]", "3-5", "POSITIVO")
    dof = {r.feature: r.dof for r in datasets.degrees_of_freedom(datasets.preprocessed(sets["M2"], "M2", stats)).collect()}
    assert (dof["importo_lotto"], dof["numero_offerte_ammesse"]) == (1, 2)
    folds = {r.cig: r.fold for r in datasets.with_folds(sets).collect()}
    assert set(folds) == {"A", "B", "C"}
    wide.unpersist()


def test_definitions(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    said = {"Aggiudicata": "AGGIUDICATA", "gara deserta": "DESERTA", "in corso": "IN_CORSO", "procedura in corso": "PROCEDURA IN CORSO", "bando ancora in corso": "IN_CORSO", "non ancora": "IN_CORSO", "non aggiudicata": "SENZA_ESITO", "nessun vincitore": "NESSUN VINCITORE", "chiusa, nessun vincitore": "SENZA_ESITO", " ": None}
    assert {k: one(features.outcome_family(F.lit(k))) for k in said} == said
    assert [one(features.province(F.lit(x))) for x in ("58091.0", "1001", "A-12", "1,5", "")] == [58, 1, None, None, None]
    raw = spark.createDataFrame([("A", "17"), ("A", None), ("B", "17.0"), ("C", "1")], "cig string, cod_motivo_variante string").withColumn("data_approvazione_variante", F.lit(None).cast("string"))
    assert {r.cig: (r.n_varianti, r.flag_variante_sostanziale) for r in features.variants(raw).collect()} == {"A": (2, 1), "B": (1, 0), "C": (1, 1)}
    works = spark.createDataFrame([("A", "2"), ("A", "6"), ("B", "3.0"), ("C", "x"), ("D", "14")], "cig string, cod_tipo_lavorazione string")
    assert {r.cig: r.tipo_lavorazione_macro for r in features.works(works).collect()} == {"A": "COSTRUZIONE", "B": None, "D": "MANUTENZIONE"}
    assert [one(datasets.banded(F.lit(x).cast("double"), datasets.BANDS["numero_offerte_ammesse"])) for x in (0, 1, 4, 6, None)] == ["MISSING", "1", "3-5", "6+", "MISSING"]
    twice = spark.createDataFrame([("A", "1"), ("A", " 1")], "cig string, flag_prevalente string")
    with pytest.raises(ValueError, match="several"):
        features.contracts(twice, strict=True)


def test_known_awards_of_condemned_contracts(spark):
    condemned = spark.createDataFrame([("A ",), ("C",)], "cig string")
    ended = spark.createDataFrame([("A", "2 ", 1), ("A", "1", 2), ("B", "1", 3), ("C", None, 4)], "cig string, id_aggiudicazione string, _row int")
    targets = features.award_targets(condemned, ended)
    assert sorted(map(tuple, targets.collect())) == [("A", "2")]
    rows = [(c, a, "2015-01-01" if a == "1" else None, None, i) for i, (c, a) in enumerate((c, a) for c in "ABC" for a in ("1", "2"))]
    begun = spark.createDataFrame(rows, "cig string, id_aggiudicazione string, data_stipula_contratto string, data_termine_contrattuale string, _row int").withColumns({c: F.lit(None).cast("string") for c in ("data_inizio_effettiva", "consegna_frazionata", "consegna_sotto_riserva")})
    awarded = begun.select("cig", F.lit("2014-01-01").cast("timestamp").alias("data_aggiudicazione_definitiva")).distinct()
    assert {r.cig: r.lag_stipula_aggiudicazione_giorni for r in features.starts(begun, awarded, targets).collect()} == {"A": None, "B": 365, "C": 365}


def test_unknown_scores_stay(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, None, 1), (3, 0.1, 0), (4, 0.5, 1)], "id int, prob double, label int")
    rank = {r.id: r.percentile_rank for r in panel.percentile_rank(df, "prob").collect()}
    assert rank[2] is None and abs(rank[3] - 100 / 3) < 1e-9 and abs(rank[1] - 250 / 3) < 1e-9
    below = {r.id: r.share_below for r in panel.share_below(df, df, "prob").collect()}
    assert below == {1: 100 / 3, 2: None, 3: 0.0, 4: 100 / 3}
    p = {r.id: r.p_value for r in metrics.conformal_p_values(df, df).collect()}
    assert p == {1: 1.0, 2: None, 3: 1 / 3, 4: 1.0}
    empty = df.filter("false")
    assert panel.percentile_rank(empty, "prob").count() == metrics.conformal_p_values(empty, df).count() == 0


def test_running_sum_is_the_window_s(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), (F.col("id") % 5).alias("c"))
    for down in (False, True):
        rows = sorted(((r.x, r.c, r.s) for r in panel.running_sum(df, "x", "c", "s", down).collect()), reverse=down)
        total = 0
        for _, c, s in rows:
            total += c
            assert s == total
