"""Ranked lexical search: MaxScore over the posting lists of each shard of documents.

Every document is cut into terms once; of these, the terms that some item asks for are kept with their frequencies.
Corpus statistics come from that table. A task takes its documents in shards of bounded size and builds the posting
lists of each. For an item, lists are ordered by the most that they can add to a score. Those that together stay below
the lowest score still wanted are non-essential: only documents of the essential lists are looked at, and a
non-essential list is probed, from the highest bound down, only for documents that can still qualify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from contractscope.llm.frames import blocks, cut, free_shuffles, gathered, lean
from contractscope.llm.terms import WORDS_AND_DIGITS, terms_of


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times) of all items; equal rows count once, and rows of one item are one query."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, codes, at = terms_of(batch.column(1), WORDS_AND_DIGITS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), terms.take(pa.array(codes)).cast(pa.string())], names=["item", "term"])

    return items.select(item, text).distinct().mapInArrow(lean(run), f"item {kind}, term string").groupBy("item", "term").agg(F.count("*").alias("times"))


def frequencies(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, terms, times): each document's number of terms, and which of the vocabulary it has, how often.

    Documents without a term are left out. Narrow: no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for batch in gathered(batches, 1):
            terms, codes, at = terms_of(batch.column(1), WORDS_AND_DIGITS)
            n = np.bincount(at, minlength=batch.num_rows)
            place = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy()[codes]
            asked = place >= 0
            pairs, times = np.unique(at[asked] * len(known) + place[asked], return_counts=True)
            of, term = np.divmod(pairs, max(1, len(known)))
            begin = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32())
            some = pa.array(n > 0)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(begin, pa.array(term, pa.int32())), pa.ListArray.from_arrays(begin, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], names=["key", "n", "terms", "times"])

    return docs.select(key, text).mapInArrow(lean(run), f"key {kind}, n long, terms array<int>, times array<int>")


class Shard:
    """The posting lists of some documents, which are numbered by rising key."""

    def __init__(self, n: np.ndarray, terms: pa.ListArray, times: pa.ListArray, vocabulary: int, documents: int, length: int):
        m = 25 + 75 * n * documents // length
        size = np.diff(terms.offsets.to_numpy())
        doc = np.repeat(np.arange(len(n)), size)
        term, tf = terms.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")  # within a term, documents stay in order
        self.doc = doc[order]
        self.worth = (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))[order]
        self.begin = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.n_docs = len(n)
        self.most = np.zeros(vocabulary, np.int64)
        have = np.flatnonzero(np.diff(self.begin))
        if len(have):
            self.most[have] = np.maximum.reduceat(self.worth, self.begin[have])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1, first: int = 1024) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of all that may be among the k best with scores from `least` on.

        weights: what one unit of a term's worth adds to the score. Documents are taken in ranges, each twice as long as
        the one before it, so that later ones meet a higher threshold.
        """
        bound = weights * self.most[terms]
        order = np.argsort(bound, kind="stable")[np.count_nonzero(bound == 0) :]
        terms, weights, upto = terms[order], weights[order], np.cumsum(bound[order])
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, wide, seen = 0, first, 0
        while low < self.n_docs and len(terms):
            high = min(self.n_docs, low + wide)
            essential = int(np.searchsorted(upto, least))  # the lists before it stay below the threshold together
            total = np.zeros(high - low, np.int64)
            for t, w in zip(terms[essential:], weights[essential:], strict=True):
                a, z = self.begin[t] + np.searchsorted(self.doc[self.begin[t] : self.begin[t + 1]], (low, high))
                total[self.doc[a:z] - low] += w * self.worth[a:z]
                seen += int(z - a)
            found = np.flatnonzero(total)
            for i in range(essential - 1, -1, -1):
                found = found[total[found] + upto[i] >= least]
                if not len(found):
                    break
                a, z = self.begin[terms[i]], self.begin[terms[i] + 1]
                at = a + np.searchsorted(self.doc[a:z], found + low)
                hit = (at < z) & (self.doc[np.minimum(at, z - 1)] == found + low)
                total[found[hit]] += weights[i] * self.worth[at[hit]]
                seen += len(found)
            found = found[total[found] >= least]
            docs, scores = np.concatenate([docs, found + low]), np.concatenate([scores, total[found]])
            if len(docs) > k:
                keep = np.sort(np.lexsort((docs, -scores))[:k])
                docs, scores = docs[keep], scores[keep]
            if len(docs) >= k:
                least = max(least, int(scores.min()))
            low, wide = high, 2 * wide
        return docs, scores, seen


def search(counted: DataFrame, asked: dict, weights: np.ndarray, documents: int, length: int, k: int, item_type: DataType, per_shard: int = 1 << 15) -> DataFrame:
    """(item, key, score): the k best of each task for each item; asked: item -> (terms, times).

    A task holds one shard of at most per_shard documents and about as many postings times 64, and k rows an item. What
    its earlier shards have found sets the threshold of later ones.
    """
    kind = counted.schema["key"].dataType.simpleString()
    names, arrow_type = list(asked), to_arrow_type(item_type)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, postings = rows + batch.num_rows, postings + len(batch.column(2).flatten())
            if rows >= per_shard or postings >= 64 * per_shard:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, postings = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in names]
        keys = None
        for table in shards(batches):
            table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")], null_placement="at_end"))
            new = table["key"].combine_chunks()
            shard = Shard(table["n"].to_numpy(), table["terms"].combine_chunks(), table["times"].combine_chunks(), len(weights), documents, length)
            before = len(keys) if keys is not None else 0
            keys = new if keys is None else pa.concat_arrays([keys, new])
            for i, name in enumerate(names):
                terms, times = asked[name]
                old, had = kept[i]
                least = max(1, int(had.min())) if len(had) >= k else 1
                found, scores, _ = shard.best(terms, weights[terms] * times, k, least)
                kept[i] = (np.concatenate([old, found + before]), np.concatenate([had, scores]))
            # only the keys of documents that are still wanted stay
            order = pc.rank(keys, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
            for i, (at, scores) in enumerate(kept):
                best = np.lexsort((order[at], -scores))[:k]
                kept[i] = (at[best], scores[best])
            wanted = np.unique(np.concatenate([at for at, _ in kept]))
            keys = keys.take(pa.array(wanted))
            kept = [(np.searchsorted(wanted, at), scores) for at, scores in kept]
        if keys is not None:
            for name, (at, scores) in zip(names, kept, strict=True):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), arrow_type), keys.take(pa.array(at)), pa.array(scores, pa.int64())], names=["item", "key", "score"])

    return counted.mapInArrow(lean(run), f"item {item_type.simpleString()}, key {kind}, score long")


def top(found: DataFrame, k: int, spread: int = 64) -> DataFrame:
    """(item, rank, key, score): the k best rows of each item, equal scores by rising key, null keys last.

    Tasks are first put together in groups, so that an item's rows, however many tasks found some, never meet all at once.
    """
    best = [F.desc("score"), F.asc_nulls_last("key")]
    first = Window.partitionBy("item", "_group").orderBy(*best)
    some = found.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(spread))).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k).select("item", "rank", "key", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text", per_block: int = 200_000) -> DataFrame:
    """(item, rank, key, score): each item's k best documents with a score above 0.

    Statistics cover all documents. A null or empty text has no terms; such a document counts nowhere, and such an item
    has no rows. Repeated documents are documents of their own, each with its row; equal scores go by rising key, null
    keys last. Equal rows of items count once, others of the same id are one query. Empty tables give an empty result,
    and other columns are not looked at. Items are dealt by a hash of their id into blocks of about per_block terms, and
    of these only one block at a time is sent to the tasks; each block reads the documents once.
    """
    spark = docs.sparkSession
    free_shuffles(spark)
    query = cut(item_terms(items, item, text))
    kind = query.schema["item"].dataType.simpleString()
    key_kind = docs.schema[key].dataType.simpleString()
    n_blocks = blocks(query.count(), per_block)
    out = None
    for b in range(n_blocks):
        rows = query.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()
        vocabulary = sorted({r["term"] for r in rows})
        place = {t: i for i, t in enumerate(vocabulary)}
        counted = cut(frequencies(docs, vocabulary, key, text))
        sums = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not rows or not sums["documents"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.floor(1000 * np.log((2 * sums["documents"] + 2) / (2 * df + 1))).astype(np.int64)
        asked: dict = {}
        for r in rows:
            asked.setdefault(r["item"], []).append((place[r["term"]], r["times"]))
        asked = {i: tuple(np.array(sorted(x), np.int64).T) for i, x in asked.items()}
        found = top(search(counted, asked, weights, sums["documents"], sums["length"], k, query.schema["item"].dataType), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item {kind}, rank int, key {key_kind}, score long")
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
