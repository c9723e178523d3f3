"""Ranked lexical search against brute force and SQL, and that MaxScore reads fewer postings than there are."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from contractscope.llm import lexical, queries
from contractscope.llm.terms import WORDS, WORDS_AND_DIGITS, terms_of
from tests.compare import both

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, []).extend(terms(t))
    for i, q in asked.items():
        found = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                found.append((-s, d is None, d, s))
        out += [(i, r, d, s) for r, (_, _, d, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_terms_of():
    texts = pa.array(["Ab1 é-É  x", None, "", "日本\x7f語\x00A_b", "  z"])
    for fold, pattern in ((WORDS_AND_DIGITS, TERM), (WORDS, re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"))):
        names, codes, at = terms_of(texts, fold)
        names = names.to_pylist()
        want = [(i, w) for i, t in enumerate(texts.to_pylist()) for w in pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        assert [(a, names[c]) for a, c in zip(at.tolist(), codes.tolist(), strict=True)] == want
    assert len(terms_of(texts.slice(3, 1), WORDS)[1]) == 4


def test_equals_sql(spark):
    names, rows, sql_names, sql_rows = both(spark, "/root/testdata/sf0.001", queries.op12_lexical, queries.SQL["op12_lexical"])
    assert names == sql_names and rows == sql_rows and len(rows) > 100


@pytest.mark.parametrize("per_block", [200_000, 6])
def test_odd_rows(spark, per_block):
    rng = random.Random(3)
    vocabulary = ["a", "bb", "C1", "é", "日本", "x", "9"]
    docs = [(i, " ".join(rng.choices(vocabulary, [30, 9, 5, 3, 2, 2, 1], k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(5, "a bb"), (5, "a bb"), (None, "é x"), (None, None), (200, None), (201, ""), (202, "-- .."), (203, "rare " * 20_000)]
    items = [(1, "a A bb"), (2, None), (3, ""), (4, "é é 日本-x"), (4, "9"), (4, "9"), (5, "nowhere"), (None, "c1 RARE"), (6, "x x x 9 rare")]
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, score string")
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id int, text string, rank int")
    got = lexical.ranked(d.repartition(5), i, per_block=per_block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.ranked(d.limit(0), i).count() == lexical.ranked(d, i.limit(0)).count() == 0


def test_many_shards_and_postings_left_unread(spark):
    rng = np.random.default_rng(0)
    n, vocabulary = 6000, 40
    share = 0.6 / np.arange(1, vocabulary + 1)
    has = rng.random((n, vocabulary)) < share
    lists = [np.flatnonzero(r) for r in has]
    begin = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
    flat = np.concatenate(lists)
    tf = rng.integers(1, 5, len(flat))
    length = np.maximum(1, np.add.reduceat(np.append(tf, 0), begin.to_numpy()[:-1]) * has.any(axis=1))
    shard = lexical.Shard(length, pa.ListArray.from_arrays(begin, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(begin, pa.array(tf, pa.int32())), vocabulary, n, int(length.sum()))
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * has.sum(axis=0) + 1))).astype(np.int64)
    asked = np.array([0, 1, 2, 20, 35])
    docs, scores, seen = shard.best(asked, weights[asked], 10)
    plain = np.zeros(n, np.int64)
    for t in asked:
        a, z = shard.begin[t], shard.begin[t + 1]
        plain[shard.doc[a:z]] += weights[t] * shard.worth[a:z]
    best = np.lexsort((np.arange(n), -plain))[:10]
    assert dict(zip(docs.tolist(), scores.tolist(), strict=True)) == dict(zip(best.tolist(), plain[best].tolist(), strict=True))
    assert seen < 0.6 * sum(shard.begin[t + 1] - shard.begin[t] for t in asked)
