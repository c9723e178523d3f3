"""Readers and writers: all-string CSV, files with varying headers, recovery of broken CSV rows, versioned results."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other spellings of the judicial tables' columns.
ALIASES = {
    "ANNO_DEPOSITO": "ANNO_DEPOSITO_RICORSO", "ANNO_DEP_RICORSO": "ANNO_DEPOSITO_RICORSO", "DATA_DEPOSITO": "DATA_DEPOSITO_RICORSO", "COD_CIG": "CODICE_CIG", "CIG": "CODICE_CIG",
    "NUM_RICORSO": "NUMERO_RICORSO", "NR_RICORSO": "NUMERO_RICORSO", "ESITO": "ESITO_PROVVEDIMENTO", "ESITO_PROV": "ESITO_PROVVEDIMENTO", "DATA_PUB": "DATA_PUBBLICAZIONE",
    "DATA_PUBBL": "DATA_PUBBLICAZIONE", "DATA_PUBBLICAZ": "DATA_PUBBLICAZIONE", "NUM_PROVVEDIMENTO": "NUMERO_PROVVEDIMENTO", "NR_PROVVEDIMENTO": "NUMERO_PROVVEDIMENTO",
}


def resolve(columns: Iterable[str], wanted: Sequence[str]) -> tuple[dict[str, str], list[str]]:
    """({wanted name: real name}, missing), without regard to case and blanks around names."""
    have = {c.strip().lower(): c for c in columns}
    return {w: have[w.lower()] for w in wanted if w.lower() in have}, [w for w in wanted if w.lower() not in have]


def header_name(name: str, aliases: Mapping[str, str] = ALIASES) -> str:
    """Upper case with underscores for blanks, hyphens and points; then the usual spelling."""
    tidy = re.sub(r"[\s\-.]+", "_", name.strip().lstrip("﻿").upper())
    return aliases.get(tidy, tidy)


def read_text_csv(spark: SparkSession, path: str, sep: str = ";", columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file or folder with every column a string and lower-case names; of `columns`, those that it has."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=False, escape='"')
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return df.select(*[resolve(df.columns, columns)[0][c] for c in resolve(df.columns, columns)[0]]) if columns else df


def read_many_csv(spark: SparkSession, paths: Sequence[str], sep: str = ";") -> DataFrame:
    """Files whose headers differ, one below the other by name, with _source_file; missing columns are null."""
    frames = [read_text_csv(spark, p, sep).withColumn("_source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)) for p in sorted(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sniff(head: str, delimiters: Sequence[str] = (";", ",", "\t", "|")) -> str:
    """The delimiter that cuts the header line into most fields; the first of equals."""
    return max(delimiters, key=lambda d: (len(next(csv.reader(io.StringIO(head), delimiter=d), [])), -list(delimiters).index(d)))


#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def decode(data: bytes, encodings: Sequence[str] = ENCODINGS) -> str:
    """Text by the first encoding that fits strictly."""
    for e in encodings:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode(encodings[0], "replace")


def recover_csv(spark: SparkSession, path: str, sep: str | None = None, most_files: int = 10_000) -> DataFrame:
    """Broken CSV: fields beyond the header's are rejoined into the last column, short rows padded, empty lines dropped.

    Files are cut into lines by Spark, which keeps their bytes, so they split over tasks; a quoted field may not span
    lines. A file's encoding is decided over the whole file: UTF-8 if all its lines are, else cp1252 if that fits, else
    latin-1. The header is the first line that is not blank; its delimiter is found if not given. Column names are
    normalised and _source_file is added; files are told apart by their whole path. The list of files in other encodings is
    sent to all tasks while it has at most most_files names, else joined. Lines equal to the header are dropped, so the files of a folder may each have it.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("line"), F.input_file_name().alias("_path"))
    first = lines.filter(F.trim(F.regexp_replace(F.decode("line", "ISO-8859-1"), "[\\r\ufeff]", "")) != "").first()
    if first is None:
        return spark.createDataFrame([], "_source_file string")
    head = decode(bytes(first["line"])).strip("\r\n").lstrip("\ufeff")
    delimiter = sep or sniff(head)
    names = [header_name(c) for c in next(csv.reader([head], delimiter=delimiter))]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [tuple(_fits(line or b"", e) for e in ENCODINGS[:2]) for line in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[i] for f in fits], pa.bool_()) for i in range(2))], names=["_path", "utf8", "cp1252"])

    chosen = F.when(F.bool_and("utf8"), ENCODINGS[0]).when(F.bool_and("cp1252"), ENCODINGS[1]).otherwise(ENCODINGS[2])
    encoding = lines.mapInArrow(fit, "_path string, utf8 boolean, cp1252 boolean").groupBy("_path").agg(chosen.alias("encoding"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, files = [], []
            for line, file, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = (line or b"").decode(code).strip("\r\n").lstrip("\ufeff")
                if not text.strip() or text == head:
                    continue
                cells = next(csv.reader([text], delimiter=delimiter))
                if len(cells) > len(names):
                    cells = [*cells[: len(names) - 1], delimiter.join(cells[len(names) - 1 :])]
                rows.append(cells + [""] * (len(names) - len(cells)))
                files.append(file.rsplit("/", 1)[-1])
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(files, pa.string())], names=[*names, "_source_file"])

    odd = encoding.filter(F.col("encoding") != ENCODINGS[0])
    if odd.limit(most_files + 1).count() <= most_files:  # lines stay where they are; a file is UTF-8 unless it is listed
        told = lines.join(F.broadcast(odd), "_path", "left").select("line", "_path", F.coalesce("encoding", F.lit(ENCODINGS[0])).alias("encoding"))
    else:
        told = lines.join(encoding, "_path").select("line", "_path", "encoding")
    return told.mapInArrow(parse, ", ".join(f"`{n}` string" for n in names) + ", _source_file string")


def _fits(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def select_known(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Projection to the wanted columns that exist, under their wanted names; and the missing ones."""
    found, missing = resolve(df.columns, wanted)
    return df.select(*[F.col(f"`{real}`").alias(name) for name, real in found.items()]), missing


def lookup_table(df: DataFrame, code: str, text: str) -> DataFrame:
    """Distinct pairs of a code, never null, and its text, sorted."""
    return df.select(F.trim(code).alias("code"), F.trim(text).alias("description")).filter("code IS NOT NULL").distinct().orderBy("code", "description")


def wide_years(df: DataFrame, ids: Sequence[str], value: str = "value") -> DataFrame:
    """Wide year columns to rows (ids, anno, value)."""
    years = [c for c in df.columns if re.fullmatch(r"\d{4}", c)]
    return df.unpivot(list(ids), years, "anno", value).withColumn("anno", F.col("anno").cast("int"))


def write_version(df: DataFrame, folder: str, version: str, partition_by: Sequence[str] = ()) -> str:
    """Write Parquet under folder/version, which must be new, so no step overwrites what it reads; returns the path."""
    path = f"{folder.rstrip('/')}/{version}"
    df.write.mode("error").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)
