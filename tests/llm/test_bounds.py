"""Search by sorted lists, samples at any size, the language kernel, and the pipeline's stages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contractscope.llm import languages, queries, vectors


@pytest.mark.parametrize("kind, most", [("skewed", 0.3), ("even", 1.0), ("equal", 1.0), ("sparse", 0.6)])
def test_sorted_lists_stop_early_and_are_exact(kind, most):
    rng = np.random.default_rng(0)
    c = {"skewed": rng.normal(size=(3000, 24)) * 0.6 ** np.arange(24), "even": rng.normal(size=(3000, 24)), "equal": rng.integers(-2, 3, (3000, 24)), "sparse": rng.normal(size=(3000, 24)) * (rng.random((3000, 24)) < 0.1)}[kind]
    c = np.floor(256 * c).astype(np.int64)
    c[-40:] = c[:40]  # ties
    lists, read = vectors.SortedLists(c), 0
    for i in range(0, 400, 20):
        rows, scores, cells = lists.best(c[i], 5, slice(i, i + 2))
        read += cells
        full = c @ c[i]
        full[i : i + 2] = -(10**15)
        best = np.lexsort((np.arange(len(c)), -full))[:5]
        got = np.lexsort((rows, -scores))[:5]
        assert rows[got].tolist() == best.tolist() and scores[got].tolist() == full[best].tolist()
    assert read <= most * 20 * c.size


def test_unread_cells_take_no_part():
    c = np.floor(256 * np.random.default_rng(1).normal(size=(2000, 8)) * 0.4 ** np.arange(8)).astype(np.int64)
    lists = vectors.SortedLists(c)
    q = np.array([9, 0, 2, 1, 0, 1, 0, 0])
    rows, scores, cells = lists.best(q, 3)
    assert cells < 2000 * 4  # components of 0 have no list
    spoilt = vectors.SortedLists(c)
    depth = cells // 4
    spoilt.value = spoilt.value.copy()
    spoilt.value[depth:-1] = 10**9  # only the ends of lists and what was read may be looked at
    assert [x.tolist() for x in spoilt.best(q, 3)[:2]] == [rows.tolist(), scores.tolist()]


def test_repeated_ids_of_the_query(spark):
    rows = [(0, [1.0, 1.0])] * 4 + [(i, [float(i), 0.5]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in vectors.exact_top_k(vectors.to_levels(vectors.usable(df)), k=12).orderBy("rank").collect()]
    assert got == [(0, 8)] * 4 + [(0, 7)] * 4 + [(0, 6)] * 4  # each of the query's rows has its list


def test_samples_are_never_empty():
    for rows in (10**9, 10**10, 10**12, 10**15):
        for wanted in (390, 9000):
            assert abs(vectors.sample_edge(wanted, rows) / 2**62 * rows - wanted) < 1
    assert vectors.sample_edge(1, 10**30) == 1 and vectors.sample_edge(10, 5) == 1 << 62


def test_language_columns_of_the_result_s_names(spark):
    df = spark.createDataFrame([(None, "abc", "x", 5.0, 1), (2, "--", "y", 6.0, 2), (2, "--", "y", 6.0, 2)], "doc_id long, text string, lang_pred string, score double, `a b` int")
    rows = languages.predict(df, None).collect()
    assert len(rows) == 3 and all(r.lang_pred == "und" and r.score == 0.0 for r in rows) and rows[0]["a b"] == 1
    assert [r[0] for r in df.select(languages.learnable()).collect()] == [True, *[r[0] for r in df.select(languages.learnable()).collect()][1:]]
    assert languages.predict(df.limit(0), None).count() == 0


def naive_presence(text):
    """The n-grams of 1 to 4 bytes that a text has, each hashed as the operator does, one at a time."""
    out = np.zeros(sum(languages.SIZES), np.float32)
    data = languages._FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    at = 0
    for n, size in enumerate(languages.SIZES, 1):
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 257 + int(b)) % 2**32
            out[at + (code if n == 1 else (code * 2654435761 % 2**32) >> (32 - size.bit_length() + 1))] = 1
        part = out[at : at + size]
        part /= np.sqrt(max(part.sum(), 1) * len(languages.SIZES))
        at += size
    return out


def test_presence_and_ridge_equal_their_definitions():
    rng = random.Random(1)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))).encode() for alphabet in ("abcde ", "xyz éü") for _ in range(12)]
    rows = languages.presence(texts)
    assert np.allclose(rows, np.stack([naive_presence(t) for t in texts]), atol=1e-6)
    names = ["a"] * 12 + ["x"] * 12
    model = languages.fit(rows, names, n_landmarks=24)  # with all rows as landmarks, kernel ridge regression itself
    k = (rows @ rows.T).astype(float)
    target = np.where(np.array(names)[:, None] == np.array(["a", "x"]), 1.0, -1.0)
    alpha = np.linalg.solve(k + 1e-3 * 24 * np.eye(24), target)
    assert np.allclose(model.scores(texts), k @ alpha, atol=2e-3)


# --- the pipeline's stages ---


def corpus():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passage = text(40)
    docs = [(i, text(rng.randint(1, 60)), "en" if i % 2 else "de", f"s{i % 3}") for i in range(30)]
    docs += [(30 + i, docs[i][1] + (" tail" if i % 2 else ""), "en", "s0") for i in range(8)]  # exact and near copies
    docs += [(40 + i, text(20) + " " + passage + " " + text(5), "en", "s1") for i in range(5)]
    docs += [(60, "", "en", "s"), (61, None, "en", "s"), (62, "12 34", None, None), (63, docs[3][1], "en", "s"), (63, docs[3][1], "en", "s"), (None, text(30), "en", "s"), (None, None, None, None)]
    return [(*d, len(d[1] or "")) for d in docs]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_near_duplicates_stage(spark):
    docs = corpus()
    named = [d for d in docs if d[0] is not None]
    kept = {}
    for d in named:
        kept.setdefault((d[0], d[1]), d)
    rows = list(kept.values())
    sets = [shingles(d[1]) for d in rows]
    name = list(range(len(rows)))
    find = lambda i: i if name[i] == i else find(name[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                name[find(i)] = find(j)
    first = {}
    for i, d in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d[0]), d[0])
    want = sorted((d[0], d[1]) for i, d in enumerate(rows) if first[find(i)] == d[0] and d[1] is not None)
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None and r.text is not None) == want
    assert sum(r.doc_id is None for r in got) == 2 and any(r.doc_id == 61 for r in got)  # rows without doc_id, and without text, stay


def test_repeated_passages_stage(spark):
    docs = corpus()
    got = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(docs, SCHEMA), "").collect()}
    seen, want = set(), set()
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (d[1] or "").encode()
        gone = np.zeros(len(data), bool)
        mine = []
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
            mine.append(s)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode()
        if left:
            want.add((d[0], left, len(left)))
    assert got == want


def test_language_and_packing_stages(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = languages.train(docs, languages.learnable())
    told = sorted((r.doc_id, r.text, r.lang_pred) for r in languages.predict(docs, model).filter(F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull()).collect())
    got = corpus_pipeline.language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got if r.doc_id is not None) == told and sum(r.doc_id is None for r in got) == 1
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    want = sorted((d[0] is None, d[0] or 0, len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids) + 1) for d in corpus())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in rows) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    end = {}
    for s, offset, length in places:
        assert offset == end.get(s, 0) and offset + length <= 2048
        end[s] = offset + length


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_whole_run_keeps_what_the_stages_keep(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(r.doc_id) for r in docs.collect())
    assert hashlib.sha256("".join(sorted(str(r.ids_crc32) for r in got)).encode()).hexdigest() == hashlib.sha256("".join(sorted(str(r.ids_crc32) for r in corpus_pipeline.packed(spark, docs, "").collect())).encode()).hexdigest()
