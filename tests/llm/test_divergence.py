"""The source audit against brute force and SQL; scans over runs that span batches."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contractscope.llm import divergence, queries
from tests.compare import both

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least=3, most=200):
    counts, has, groups = defaultdict(Counter), defaultdict(set), defaultdict(set)
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            counts[lang, source][t] += 1
            has[lang, t].add(i)
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang, sources in groups.items():
        kept = sorted(t for (l, t), d in has.items() if l == lang and len(d) >= least)
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(rows, 1)]
    return sorted(out)


def test_equals_sql(spark):
    names, rows, sql_names, sql_rows = both(spark, "/root/testdata/sf0.001", queries.op13_divergence, queries.SQL["op13_divergence"])
    assert names == sql_names and rows == sql_rows and len(rows) > 1000


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_odd_rows(spark, block, monkeypatch):
    rng = random.Random(5)
    words = ["the", "The", "of", "é", "日本", "x1y", "z-z", "w"]
    docs = [(" ".join(rng.choices(words, [20, 3, 9, 2, 2, 2, 1, 1], k=rng.randint(0, 20))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", "é", None])) for _ in range(300)]
    docs += [(None, "en", "none"), ("", "xx", "alone"), ("only twice", "yy", "a"), ("only twice", "yy", "b"), ("hot " * 30_000, "en", "a"), ("hot", "en", "b"), ("hot", "en", "b")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "text string, lang string, source string, count int").repartition(7)
    monkeypatch.setattr(divergence.counted, "__defaults__", (block,))
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_ranks_end_at_the_limit(spark):
    docs = [(f"w{chr(97 + i // 26)}{chr(97 + i % 26)} " * (1 + i % 3), "en", "s") for i in range(300)] * 3 + [("other", "en", "t")] * 3
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == brute(docs)
    assert divergence.audit(df).filter("part = 'term'").agg(F.max("rank")).first()[0] == 200
    assert divergence.audit(df.limit(0)).count() == 0


def test_runs_span_batches():
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 40, 500))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(500, np.int64))], names=["k", "n"])

    def use(t, begin):
        return pa.table([t["k"].take(pa.array(begin)), pa.array(np.add.reduceat(t["n"].to_numpy(), begin))], names=["k", "n"])

    want = [tuple(map(int, x)) for x in zip(*np.unique(key, return_counts=True), strict=True)]
    for size in (1, 7, 500):
        for shrink in (False, True):
            got = pa.concat_tables(list(divergence.scan((rows.slice(i, size) for i in range(0, 500, size)), 1, use, shrink)))
            assert list(zip(got["k"].to_pylist(), got["n"].to_pylist(), strict=True)) == want


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(10**12, 7 * 10**13, 10**8), (0, 0, 0)], "c long, n long, v long")
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == [1 + 10**9 * (10**12 + 1) // (7 * 10**13 + 10**8), None]
