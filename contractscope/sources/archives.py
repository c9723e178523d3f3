"""Zipped CSV parts, workbooks and statistical CSV: each file is one row of Spark's binary reader and is parsed in its task.

Files are found and read by Spark, so they may lie in any store that it reaches; a file is held whole by one task.
"""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractscope.functions.columns import number
from contractscope.sources.tables import decode, sniff


class BadArchive(ValueError):
    """A file that is no archive, or whose archive has nothing that fits."""


def member(data: bytes, suffix: str = ".csv", holds: str = "") -> bytes:
    """The first member whose name ends so and holds this text.

    An archive that was streamed and lacks its directory is read from its first local header instead: a stored member as
    it stands, a deflated one as far as its stream goes.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                if name.lower().endswith(suffix) and holds in name:
                    return z.read(name)
        raise BadArchive(f"no {suffix} in the archive")
    except zipfile.BadZipFile:
        pass
    if data[:4] != b"PK\x03\x04" or len(data) < 30:
        raise BadArchive("no archive")
    flags, method = struct.unpack_from("<HH", data, 6)
    size, name, extra = *struct.unpack_from("<I", data, 18), *struct.unpack_from("<H", data, 26), *struct.unpack_from("<H", data, 28)
    body = data[30 + name + extra :]
    if method == 0:
        return body[:size] if size and not flags & 8 else body
    if method != 8:
        raise BadArchive(f"compression {method} is unknown")
    try:
        return zlib.decompressobj(-15).decompress(body)
    except zlib.error as e:
        raise BadArchive(f"broken stream: {e}") from e


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of workbooks that are dates.
_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _place(ref: str) -> int:
    """Column number, from 0, of a cell's name."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of one sheet as text: whole numbers without a point, dates in ISO form, booleans as 1 and 0, errors as null.

    Rows that the file leaves out are not made up; cells that it leaves out are null.
    """
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        book, links = ET.fromstring(z.read("xl/workbook.xml")), ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise BadArchive(f"no workbook: {e}") from e
    with z:
        sheets = [(s.get("name"), s.get(_REL)) for s in book.iter(f"{_SHEET}sheet")]
        chosen = [r for i, (name, r) in enumerate(sheets) if sheet in (i, name)]
        if not chosen:
            raise BadArchive(f"no sheet {sheet}")
        target = next(r.get("Target") for r in links if r.get("Id") == chosen[0]).lstrip("/")
        words: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            words = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        dates: list[bool] = []
        if "xl/styles.xml" in z.namelist():
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{_SHEET}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)}
            cells = styles.find(f"{_SHEET}cellXfs")
            dates = [int(x.get("numFmtId") or 0) in _DATES | own for x in (cells if cells is not None else [])]
        since = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_SHEET}workbookPr")) else datetime(1899, 12, 30)

        def text(cell: ET.Element) -> str | None:
            kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            if value is None or value.text is None or kind == "e":
                return None
            if kind == "s":
                return words[int(value.text)]
            if kind in ("str", "b", "d"):
                return value.text
            x, style = float(value.text), int(cell.get("s") or 0)
            if style < len(dates) and dates[style]:
                at = since + timedelta(seconds=round(x * 86400))
                return at.strftime("%Y-%m-%d %H:%M:%S" if x % 1 else "%Y-%m-%d")
            return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)

        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag == f"{_SHEET}row":
                    out: list[str | None] = []
                    for cell in row.iter(f"{_SHEET}c"):
                        at = _place(cell.get("r") or "") if cell.get("r") else len(out)
                        out += [None] * (at - len(out)) + [text(cell)]
                    yield out
                    row.clear()


def csv_rows(data: bytes, sep: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a CSV file; quoted fields may span lines, blank lines are dropped."""
    text = decode(data)
    delimiter = sep or sniff(text[: text.find("\n")] if "\n" in text else text)
    for cells in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
        if any(c.strip() for c in cells):
            yield [c if c != "" else None for c in cells]


def _table(spark: SparkSession, path: str, rows: Callable[[bytes], Iterator[list[str | None]]], strict: bool, pattern: str | None) -> DataFrame:
    """All rows below each file's header, by name; two passes: one over the headers, one over the rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern or "*").load(path).select("path", "content")

    def header(read: Iterator[list[str | None]]) -> list[str]:
        return [(c or f"_{i}").strip().lower() for i, c in enumerate(next(read, []))]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                try:
                    yield pa.RecordBatch.from_arrays([pa.array(header(rows(data)), pa.string())], names=["name"])
                except BadArchive:
                    if strict:
                        raise

    found = files.mapInArrow(heads, "name string").groupBy("name").count().collect()
    names = sorted(r["name"] for r in found)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    read = rows(data)
                    own = header(read)
                except BadArchive:
                    continue
                file, start, done = path.rsplit("/", 1)[-1], 0, False
                while not done:
                    some = [r for _, r in zip(range(10_000), read)]
                    done = len(some) < 10_000
                    columns = [pa.array([r[own.index(n)] if n in own and own.index(n) < len(r) else None for r in some], pa.string()) for n in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([file] * len(some), pa.string()), pa.array(range(start, start + len(some)), pa.int64())], names=[*names, "_source_file", "_row"])
                    start += len(some)

    return files.mapInArrow(parse, "".join(f"`{n}` string, " for n in names) + "_source_file string, _row long")


def read_zipped_csv(spark: SparkSession, path: str, sep: str | None = ";", strict: bool = False, pattern: str | None = None) -> DataFrame:
    """Archives of one CSV each, such as a year's monthly parts, one below the other by column name.

    Every column is text, with _source_file and _row, the place in the file. Archives without a directory are recovered;
    with strict, one that cannot be read is an error, else it is left out (bad_archives names them).
    """
    return _table(spark, path, lambda data: csv_rows(member(data), sep), strict, pattern)


def read_workbooks(spark: SparkSession, path: str, sheet: str | int = 0, inside: str | None = None, strict: bool = True, pattern: str | None = None) -> DataFrame:
    """One sheet of each workbook, all text; `inside` names a part of the workbook's name within a zip archive."""
    return _table(spark, path, lambda data: workbook_rows(data if inside is None else member(data, ".xlsx", inside), sheet), strict, pattern)


def bad_archives(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, problem) of the archives that no CSV can be read from."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern or "*").load(path).select("path", "content")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    member(data)
                except BadArchive as e:
                    out.append((path.rsplit("/", 1)[-1], str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["file", "problem"])

    return files.mapInArrow(tell, "file string, problem string")


# --- what the context of provinces is made from ---


def unemployment(rows: DataFrame, places: DataFrame, age: str) -> DataFrame:
    """(codice_provincia, anno, tasso_disoccupazione) from a statistical CSV: both sexes, all degrees and durations, one age
    class, places of five characters; places has (nuts, codice_provincia)."""
    c = lambda name: F.col(name.lower())
    t = rows.filter((c("SESSO") == "9") & (c("TITOLO_STUDIO") == "99") & (c("DURATA_DISOCCUPAZ") == "TOTAL") & (c("CLASSE_ETA") == age) & F.startswith(c("ITTER107"), F.lit("IT")) & (F.length(c("ITTER107")) == 5))
    return t.join(places, c("ITTER107") == F.col("nuts")).select("codice_provincia", c("TIME_PERIOD").try_cast("int").alias("anno"), c("OBS_VALUE").try_cast("double").alias("tasso_disoccupazione"))


def plain_name(name: Column) -> Column:
    """A place's name in lower case, with plain apostrophes and without accents."""
    return F.translate(F.lower(F.trim(name)), "’‘àèéìòù", "''aeeiou")


def homicides(rows: DataFrame, places: DataFrame, first: int = 2007, last: int = 2024, code: str = "07SIC001P") -> DataFrame:
    """(codice_provincia, anno, tasso_omicidi_100k) from a sheet of indicators with a column V<year> a year.

    Rows of both sexes and of single provinces (a geographic code that is filled and does not end in -000); places has
    (name, codice_provincia), matched by plain name. Values that are no number are left out.
    """
    t = rows.filter((F.col("codice") == code) & (F.col("sesso") == "Totale"))
    if "w_geo" in rows.columns:
        t = t.filter(F.col("w_geo").isNotNull() & ~F.endswith("w_geo", F.lit("-000")))
    years = [c for c in rows.columns if re.fullmatch(r"v\d{4}", c) and first <= int(c[1:]) <= last]
    long = t.select(plain_name(F.col("territorio")).alias("_n"), *years).unpivot(["_n"], years, "_y", "_v")
    known = places.select(plain_name(F.col("name")).alias("_n"), "codice_provincia").distinct()
    made = long.join(known, "_n").select("codice_provincia", F.substring("_y", 2, 4).cast("int").alias("anno"), number(F.col("_v")).alias("tasso_omicidi_100k"))
    return made.filter("tasso_omicidi_100k IS NOT NULL")


def income(rows: DataFrame, province: str, payers: str, amounts: Sequence[str], year: int) -> DataFrame:
    """(codice_provincia, anno, reddito_irpef_procapite): all amounts of a province over its taxpayers; thousands have points."""
    value = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".").try_cast("double")
    total = F.lit(0.0)
    for c in amounts:
        total = total + F.coalesce(value(c), F.lit(0.0))
    t = rows.select(F.trim(province).try_cast("int").alias("codice_provincia"), value(payers).alias("_n"), total.alias("_t")).groupBy("codice_provincia").agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    return t.filter("codice_provincia > 0 AND _n > 0").select("codice_provincia", F.lit(year).alias("anno"), (F.col("_t") / F.col("_n")).alias("reddito_irpef_procapite"))


def report_json(df: DataFrame, most: int = 10_000) -> str:
    """A small result as JSON, for a report file; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str)
