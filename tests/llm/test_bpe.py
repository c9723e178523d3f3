"""The BPE codec against the tokenizers library, on odd texts, long words and whole tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from contractscope.llm import bpe, queries

pytest.importorskip("tokenizers")
PATH = queries.tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = [
    None, "", " \t\n", "a", "It's DON'T we're I'll 's't", "Tom123&4.5%", "ΑΣ ΑΣ.", "İstanbul ıǅ", "café ﬁ ẛ̣", "한글 日本語 हिन्दी",
    "\U0001f469‍\U0001f469‍\U0001f467 ️!", "a b　c\x85d\x1ce\x00f", "<|endoftext|>", "x<|endoftext|>́y <|startoftext|><|endoftext|>", "<|endoftext", "ab" * 3000, "z" * 1025, "!?" * 700, "é" * 65, "²½٤",
]


def test_ids_and_texts_equal_the_library_s(spark, library):
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(ODD)] + [(3, "a", "k")], "doc_id int, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids, r.text
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_trees_side_by_side_equal_a_tree_alone():
    codec = bpe.Codec.of(PATH)
    words = ["strawberries", "internationalization", "aaaaaaaaaaaaaaa", "xq", "q", "thethethethe" * 5]
    some = [codec._symbols(w) for w in words]
    assert [x.tolist() for x in codec.merges.merge_all(some)] == [codec.merges.merge_one(x) for x in some]


def test_leftmost_lowest_rank_first():
    m = bpe.Merges([(0, 0, 1), (1, 1, 2), (0, 1, 3)])
    assert m.merge_one([0, 0, 0, 0, 0]) == [2, 0]
    assert m.merge_one([0, 0, 0]) == [1, 0]
    assert [x.tolist() for x in m.merge_all([[0] * 5, [0] * 3, [], [0]])] == [[2, 0], [1, 0], [], [0]]


def test_long_word_and_emptied_tables(library):
    codec = bpe.Codec(PATH, most=3)
    import pyarrow as pa

    long = "abcdefghij" * 20_000
    for text in (long, "one two three four five", "one two", long + " six"):
        assert codec.encode(pa.array([text])).to_pylist()[0] == library.encode(text, add_special_tokens=False).ids


def test_decode_of_null_and_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, 99_999_999, -4])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got[1] is None and got[2] == "" and got[3] and " " not in got[3]
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="word BPE"):
        bpe.Codec(queries.tokenizer_file("byte_bpe_50k.json"))


def test_query_equals_the_library_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_query_has_one_python_pass(spark):
    made = queries.op11_bpe(spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    df = spark.createDataFrame([(1, "Hello <|endoftext|> W\u00f6rld 12"), (2, None), (3, "")], "k int, text string")
    two = bpe.decode(bpe.encode(df, PATH), PATH).select("k", "ids", "decoded").orderBy("k").collect()
    assert bpe.encode_and_decode(df, PATH).orderBy("k").collect() == two
    assert bpe.encode_and_decode(df.limit(0), PATH).count() == 0
