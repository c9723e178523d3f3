"""Corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet into the shared
folder and reads them again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractscope.llm import jaccard, languages, packing, suffixes
from contractscope.llm.frames import remove, shared_dir, small_batches
from contractscope.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters go on, with lang as predicted; those without text or letters are rejected.

    Where no document has a lang to learn from, lang stays as it is. Repeated rows are kept, and so are rows without
    doc_id; an empty table gives an empty result.
    """
    small_batches(spark, 512)
    model = languages.train(docs, languages.learnable())
    told = languages.predict(docs.select(*COLUMNS), model).filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return told.withColumn("lang", F.coalesce(F.nullif("lang_pred", F.lit("und")), "lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word shingles the one with the smallest doc_id stays.

    Repeated rows shrink to one. A row without doc_id counts as a document before all others, named by its text's hash;
    texts without words are linked with nothing and stay.
    """
    small_batches(spark, 512)
    key = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(-(1 << 63)))
    named = docs.select(key.alias("_key"), *COLUMNS)
    kept = jaccard.similar(named.select(F.col("_key").alias("doc_id"), "text"), count_links=False).filter("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    return named.join(kept, "_key", "left_semi").dropDuplicates(["_key", "text"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every 100-byte string stays where it starts first; characters that lose bytes go whole, and so do emptied documents.

    Rows without doc_id come first; an empty table gives an empty result.
    """
    small_batches(spark, 512)
    left = suffixes.dedup(docs, ["doc_id", "lang", "source"])
    return left.withColumn("text", F.col("kept_text")).filter("text <> ''").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their places in sequences of 2048 tokens; a null text is its end alone."""
    small_batches(spark, 1000)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packed", packed)]

#: SQL cannot express a trained classifier or a tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again, and goes once the next one's is written."""
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
