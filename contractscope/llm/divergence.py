"""Source divergence audit: how much each source of a language differs from the others, and by which terms.

Sort-based streaming: rows (lang, term, source, document) are dealt by their key and sorted within partitions, and one
scan over the runs of equal keys gives document frequencies and counts. Rows are put together before they are dealt:
a task counts some megabytes of documents at a time and names such a block of documents by one number. A first scan
makes one row of each (lang, term, source); a second one, over (lang, term), keeps the terms with enough documents; a
third one adds up, per run, what the pairs of sources that both have the term differ by.

Shares are p(c) = 1 + floor(10^9 * (c + 1) / (N + V)) for a count c, so all terms that a source lacks have one share
p0. With f(p, q) = floor((p - q)^2 / q), the sum over all V kept terms for sources a and b is therefore
V f(p0a, p0b), plus f(pa, p0b) - f(p0a, p0b) for each term of a, plus f(p0a, pb) - f(p0a, p0b) for each term of b (both
from the number of terms of each count), plus f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b) for each term of both.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractscope.llm.frames import cut, free_shuffles, gathered, lean
from contractscope.llm.terms import WORDS, terms_of

_ROW = "lang string, term string, source string, document long, docs long, count long"


def counted(docs: DataFrame, block_bytes: int = 1 << 24) -> DataFrame:
    """(lang, term, source, document, docs, count): what each block of documents has; a null lang, source or text is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, 2, block_bytes):
            terms, codes, at = terms_of(batch.column(2), WORDS)
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            width = max(1, len(terms))
            each, times = np.unique(at * width + codes, return_counts=True)  # one entry a document and term
            key = group[each // width] * width + each % width
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if not len(first):
                continue
            groups, term = np.divmod(key[first], width)
            of_lang, of_source = np.divmod(groups, max(1, len(source.dictionary)))
            columns = [lang.dictionary.take(pa.array(of_lang)), terms.take(pa.array(term)).cast(pa.string()), source.dictionary.take(pa.array(of_source)), pa.array(np.full(len(first), block), pa.int64())]
            columns += [pa.array(np.diff(first, append=len(key)), pa.int64()), pa.array(np.add.reduceat(times, first), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "document", "docs", "count"])
            block += 1

    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(lean(run), _ROW)


def starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where a new run of the first `keys` columns begins; the rows are sorted by them."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for i in range(keys):
        column = table.column(i).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def scan(batches: Iterator[pa.RecordBatch], keys: int, use: Callable[[pa.Table, np.ndarray], pa.Table], shrink: bool = False) -> Iterator[pa.Table]:
    """use(rows, where runs begin) of all whole runs, batch by batch; a run that may go on waits for the next batch.

    With shrink, what waits is use() of it, so that a run of any length waits as one row.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        begin = starts(rows, keys)
        if len(begin) > 1:
            yield use(rows.slice(0, begin[-1]), begin[:-1])
        held = rows.slice(begin[-1])
        if shrink:
            held = use(held, np.zeros(1, np.int64))
    if held is not None:
        yield use(held, np.zeros(1, np.int64))


def by_source(rows: DataFrame) -> DataFrame:
    """One row of each (lang, term, source), from rows of blocks."""

    def use(t: pa.Table, begin: np.ndarray) -> pa.Table:
        sums = {c: pa.array(np.add.reduceat(t[c].to_numpy(), begin)) for c in ("docs", "count")}
        some = t.take(pa.array(begin))
        return some.set_column(4, "docs", sums["docs"]).set_column(5, "count", sums["count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in scan(batches, 3, use, shrink=True):
            yield from t.to_batches()

    keys = ["lang", "term", "source"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "document").mapInArrow(lean(run), _ROW)


def kept_terms(rows: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, source, count, total, first): the rows of terms that at least `least` documents of the language have.

    total is the term's count in the language; first is 1 on one row of each term. A task holds one batch and one run,
    which has one row a source.
    """

    def use(t: pa.Table, begin: np.ndarray) -> pa.Table:
        size = np.diff(begin, append=len(t))
        docs, total = (np.add.reduceat(t[c].to_numpy(), begin) for c in ("docs", "count"))
        first = np.zeros(len(t), np.int64)
        first[begin] = 1
        made = pa.table([*[t[c] for c in ("lang", "term", "source", "count")], pa.array(np.repeat(total, size)), pa.array(first)], names=["lang", "term", "source", "count", "total", "first"])
        return made.filter(pa.array(np.repeat(docs >= least, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in scan(batches, 2, use):
            yield from t.to_batches()

    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(lean(run), "lang string, term string, source string, count long, total long, first long")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (n + v)), exact for all counts; null where n + v is 0."""
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(n + v > 0, 1 + F.call_function("div", over, F.nullif(n + v, F.lit(0)).cast("decimal(20,0)")))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared_terms(rows: DataFrame, most_cells: int = 1 << 20, most_pairs: int = 1 << 18) -> DataFrame:
    """(lang, source, item, value): for each ordered pair of sources, partial sums over the terms that both have.

    rows: (lang, term, source, p, p0). Runs of one size are taken together, at most most_cells pairs at a time; a task
    holds at most about most_pairs sums before it gives them out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = defaultdict(int)

        def out() -> Iterator[pa.RecordBatch]:
            if sums:
                columns = [*zip(*sums, strict=True), list(sums.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),), strict=True)], names=["lang", "source", "item", "value"])
                sums.clear()

        def add(a: np.ndarray, b: np.ndarray, p: np.ndarray, p0: np.ndarray, group: np.ndarray, names: list) -> None:
            """Pairs of rows a and b."""
            value = _apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b])
            key = group[a] * len(names) + group[b]
            found, at = np.unique(key, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, at, value)
            for k, v in zip(found.tolist(), total.tolist(), strict=True):
                x, y = names[k // len(names)], names[k % len(names)]
                sums[(*x, y[1])] += v

        for t in scan(batches, 2, lambda rows, begin: rows):
            begin = starts(t, 2)
            size = np.diff(begin, append=len(t))
            p, p0 = (t[c].to_numpy() for c in ("p", "p0"))
            pair = pa.table([t["lang"], t["source"]], names=["lang", "source"])
            lang, source = (pair[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            used, group = np.unique(code, return_inverse=True)
            names = [(lang.dictionary[int(u) // len(source.dictionary)].as_py(), source.dictionary[int(u) % len(source.dictionary)].as_py()) for u in used]
            for k in np.unique(size[size > 1]).tolist():
                runs = begin[size == k]
                many, rows_at_once = max(1, most_cells // (k * k)), max(1, most_cells // k)
                for m in range(0, len(runs), many):
                    for r in range(0, k, rows_at_once):
                        left = np.arange(r, min(k, r + rows_at_once))
                        a = np.repeat(left, k)
                        b = np.tile(np.arange(k), len(left))
                        a, b = a[a != b], b[a != b]
                        some = runs[m : m + many][:, None]
                        add((some + a).ravel(), (some + b).ravel(), p, p0, group, names)
                        if len(sums) > most_pairs:
                            yield from out()
        yield from out()

    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(lean(run), "lang string, source string, item string, value long")


def audit(docs: DataFrame, least: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of a language and a source, even one without terms.

    Part `pair`: every other source of the language, with the sum of f over all kept terms. Part `term`: the terms that
    the source has with a larger share than the language, to rank most_terms. Ranks go by falling value, then by item in
    UTF-8 order. Null lang, source and text are ''. Repeated rows are documents of their own; an empty table gives an
    empty result; other columns are not looked at. A frequent word or a large source is spread by (lang, term, source),
    and has one row a block of documents there, then one row a source.
    """
    free_shuffles(docs.sparkSession)
    kept = cut(kept_terms(by_source(counted(docs)), least))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("count").alias("n_lang"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    totals = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "n_lang"])
    totals = cut(totals.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v"))))
    rows = kept.join(totals, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))

    own = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("h"))
    other = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"), "v")
    met = own.join(other, "lang").filter("source <> item")
    h, p, p0, o0 = (F.col(c) for c in ("h", "p", "p0", "o0"))
    there = met.select("lang", "source", "item", (h * (apart(p, o0) - apart(p0, o0))).alias("value"))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (h * (apart(o0, p) - apart(o0, p0))).alias("value"))
    none = totals.select("lang", "source", "p0").join(other, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * apart(p0, o0), F.lit(0)).alias("value"))
    both = shared_terms(rows.select("lang", "term", "source", "p", "p0"))
    pairs = none.unionByName(there).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    more = rows.withColumn("q", share(F.col("total"), F.col("n_lang"), F.col("v"))).filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumns({"rank": F.row_number().over(order), "part": F.lit("pair")}).select(*names).unionByName(terms.withColumn("part", F.lit("term")).select(*names))
