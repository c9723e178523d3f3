"""Zipped CSV, workbooks and context tables on hand-made files."""

import io
import json
import zipfile

import pytest

from contractscope.sources import archives


def zipped(name, data, streamed=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, data)
    data = out.getvalue()
    return data[: data.index(b"PK\x01\x02")] if streamed else data  # without the directory


def workbook(rows, dates=()):
    """A minimal workbook: shared strings, an inline string, numbers, a date style; cells given as text or number."""
    words = sorted({c for r in rows for c in r if isinstance(c, str)})
    letter = lambda i: chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)

    def cell(i, j, c):
        if c is None:
            return ""
        if isinstance(c, str):
            return f'<c r="{letter(j)}{i + 1}" t="s"><v>{words.index(c)}</v></c>'
        style = ' s="1"' if (i, j) in dates else ""
        return f'<c r="{letter(j)}{i + 1}"{style}><v>{c}</v></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{w[:1]}</t></r><r><t>{w[1:]}</t></r></si>" for w in words) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, c) for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_member_of_whole_streamed_and_stored_archives():
    text = b"a;b\n1;2\n" * 500
    assert archives.member(zipped("x.CSV", text)) == text
    assert archives.member(zipped("x.csv", text, streamed=True)) == text
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x.csv", text)
    assert archives.member(out.getvalue()[: out.getvalue().index(b"PK\x01\x02")]) == text
    for bad in (b"", b"hello", zipped("x.txt", text), b"PK\x03\x04" + b"\0" * 4 + b"\x63\0" + b"\0" * 40):
        with pytest.raises(archives.BadArchive):
            archives.member(bad)


def test_monthly_parts(spark, tmp_path):
    (tmp_path / "cig_2020_01.zip").write_bytes(zipped("a.csv", 'CIG;Importo;Note\nA1;1,5;"x\ny"\n\nA2;;z\n'.encode("cp1252")))
    (tmp_path / "cig_2020_02.zip").write_bytes(zipped("b.csv", "﻿cig;note;Città\nB1;perché;Roma\n".encode(), streamed=True))
    (tmp_path / "cig_2020_03.zip").write_bytes(b"broken")
    df = archives.read_zipped_csv(spark, str(tmp_path))
    assert df.columns == ["cig", "città", "importo", "note", "_source_file", "_row"]
    assert sorted(map(tuple, df.collect())) == [("A1", None, "1,5", "x\ny", "cig_2020_01.zip", 0), ("A2", None, None, "z", "cig_2020_01.zip", 1), ("B1", "Roma", None, "perché", "cig_2020_02.zip", 0)]
    assert [tuple(r) for r in archives.bad_archives(spark, str(tmp_path)).collect()] == [("cig_2020_03.zip", "no archive")]
    with pytest.raises(Exception, match="no archive"):
        archives.read_zipped_csv(spark, str(tmp_path), strict=True).count()


def test_many_files_are_read_in_parallel(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"p{i:02}.zip").write_bytes(zipped("x.csv", "k;v\n" + "".join(f"{i};{j}\n" for j in range(i * 3000)), streamed=i % 2 == 1))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a partition a file
    df = archives.read_zipped_csv(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 4
    counts = {r["_source_file"]: r["count"] for r in df.groupBy("_source_file").count().collect()}
    assert counts == {f"p{i:02}.zip": i * 3000 for i in range(1, 12)}
    spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_workbooks(spark, tmp_path):
    rows = [["Name", "Day", "Value", None, "Far"], ["x y", 43831, 2, None, "end"], [None, 43831.5, 0.25], ["z"]]
    data = workbook(rows, dates={(1, 1), (2, 1)})
    assert list(archives.workbook_rows(data)) == [["Name", "Day", "Value", None, "Far"], ["x y", "2020-01-01", "2", None, "end"], [None, "2020-01-01 12:00:00", "0.25"], ["z"]]
    assert list(archives.workbook_rows(data, "Data")) == list(archives.workbook_rows(data, 0))
    with pytest.raises(archives.BadArchive):
        list(archives.workbook_rows(data, "Other"))
    (tmp_path / "a.xlsx").write_bytes(data)
    (tmp_path / "b.xlsx").write_bytes(workbook([["name", "More"], ["q", 7]]))
    got = sorted(((r.name, r.day, r.value, r.far, r.more, r._source_file) for r in archives.read_workbooks(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("x y", "2020-01-01", "2", "end", None, "a.xlsx"), (None, "2020-01-01 12:00:00", "0.25", None, None, "a.xlsx"), ("z", None, None, None, None, "a.xlsx"), ("q", None, None, None, "7", "b.xlsx")], key=repr)


def test_context_of_provinces(spark, tmp_path):
    (tmp_path / "bes.zip").write_bytes(zipped("x/Indicatori_per_provincia_2025.xlsx", workbook([["CODICE", "TERRITORIO", "SESSO", "W_GEO", "V2006", "V2007", "V2024"], ["07SIC001P", "Forlì-Cesena", "Totale", "ITH-040", 1, 0.5, "1,25"], ["07SIC001P", "Nord", "Totale", "ITC-000", 1, 1, 1], ["07SIC001P", "Forlì-Cesena", "Femmine", "ITH-040", 9, 9, 9], ["X", "Forlì-Cesena", "Totale", "ITH-040", 9, 9, 9], ["07SIC001P", "Valle d’Aosta", "Totale", "ITC-007", 1, "n.d.", 2]])))
    rows = archives.read_workbooks(spark, str(tmp_path), inside="Indicatori_per_provincia")
    places = spark.createDataFrame([("forli-cesena", 40), ("Valle d'Aosta", 7)], "name string, codice_provincia int")
    assert sorted(map(tuple, archives.homicides(rows, places).collect())) == [(7, 2024, 2.0), (40, 2007, 0.5), (40, 2024, 1.25)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "u.zip").write_bytes(zipped("u.csv", "ITTER107,SESSO,TITOLO_STUDIO,DURATA_DISOCCUPAZ,CLASSE_ETA,TIME_PERIOD,OBS_VALUE\nITC11,9,99,TOTAL,Y_GE15,2010,7.5\nITC11,1,99,TOTAL,Y_GE15,2010,1\nITC1,9,99,TOTAL,Y_GE15,2010,1\nITC12,9,99,TOTAL,Y15-74,2010,1\n"))
    told = archives.unemployment(archives.read_zipped_csv(spark, str(tmp_path / "s"), ","), spark.createDataFrame([("ITC11", 1), ("ITC12", 2)], "nuts string, codice_provincia int"), "Y_GE15")
    assert [tuple(r) for r in told.collect()] == [(1, 2010, 7.5)]
    paid = spark.createDataFrame([("1", "10", "1.000,5", None), ("1", "30", "2.000", "x"), ("0", "5", "5", "5"), ("2", "0", "9", "9")], "p string, n string, a string, b string")
    assert [tuple(r) for r in archives.income(paid, "p", "n", ["a", "b"], 2020).collect()] == [(1, 2020, 3000.5 / 40)]
    assert json.loads(archives.report_json(told)) == [{"codice_provincia": 1, "anno": 2010, "tasso_disoccupazione": 7.5}]
