"""Each training-data operator against brute force, and its edge cases: nulls, empty and long texts, repeats, no rows."""

import collections
import hashlib
import random
import re
import struct
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contractscope.llm import chat, frames, graph, jaccard, languages, packing, pages, queries, sentencepiece_fst, suffixes, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "and", "house", "river", "stone", "light", "water", "green", "Ärger", "été", "niño", "run", "far", "old", "new"]


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_shared_dir_on_a_cluster():
    held = {}
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: held.get("dir"), getConf=lambda: {}, setCheckpointDir=lambda x: held.update(dir=x))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.shared_dir(types.SimpleNamespace(sparkContext=context, conf={}))
    context.master = "local-cluster[3,2,3000]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.shared_dir(types.SimpleNamespace(sparkContext=context, conf={}))
    context.getConf = lambda: {"spark.checkpoint.dir": "/shared/here"}
    frames.shared_dir(types.SimpleNamespace(sparkContext=context, conf={}))
    assert held == {"dir": "/shared/here"}


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(5)
    passage, base = words(rng, 40), words(rng, 120)
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(1, 150))
        if i % 5 == 0:
            text = text + "\n" + passage + "\n" + words(rng, 10)
        if i % 7 == 0:
            parts = base.split(" ")
            for _ in range(rng.randint(0, 12)):
                parts[rng.randrange(len(parts))] = "Changed" + str(rng.randrange(99))
            text = " ".join(parts)
        rows.append((i, text, ["en", "de", None][i % 3], "src0", len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "src1", 0), (102, " \n\t ", "en", "src1", 4), (103, base, "en", "src0", 1), (104, base, "en", "src0", 1), (105, "ab" * 3000, "de", "src0", 1), (106, "... 123 !!", "de", "src0", 1), (107, words(rng, 4000), "de", "src0", 1), (107, "twice the same", "en", "src0", 1), (107, "twice the same", "en", "src0", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def table(spark, documents, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    documents.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows_of(documents):
    return [(r.doc_id, r.text) for r in documents.collect() if r.doc_id != 107]


# --- 1 ---


def removed(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                cover[i] += 1
                cover[i + 100] -= 1
            seen.add(data[i : i + 100])
        gone = np.cumsum(cover)[: len(data)] > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes_match_brute_force(documents):
    got = suffixes.dedup(documents.filter("doc_id <> 107")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows_of(documents))


def test_suffixes_string_by_string(spark):
    rng = random.Random(1)
    passage = words(rng, 20)
    rows = [(i, words(rng, 8) + passage[: rng.randint(60, len(passage))] + words(rng, 8)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.encode("text", "UTF-8").alias("text"))
    found = suffixes.marks(suffixes.surroundings(docs, suffixes.repeated(suffixes.anchors(docs))), most=3, batch_rows=7)
    every = suffixes.later_strings(found).collect()
    assert found.filter("string IS NOT NULL").count() > 0
    cover = collections.defaultdict(set)
    for r in every:
        cover[r.doc_id].update(range(r.start, r.end))
    want = removed(rows)
    assert {d: len(cover[d]) for d, _ in rows} == {d: want[d][1] for d, _ in rows}


def test_suffixes_rows_of_one_document(documents):
    got = suffixes.dedup(documents.filter("doc_id = 107 AND text LIKE 'twice%'")).collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(14, 0)] * 2
    long = documents.filter("doc_id = 103")
    assert [(r.n_removed) for r in suffixes.dedup(long.union(long)).collect()] == [0, 0]


def test_suffix_sorting():
    rng = random.Random(3)
    for _ in range(60):
        m = rng.choice([10, 40, 68, 100])
        base = [bytes(rng.choice(b"ab") for _ in range(m)) for _ in range(3)]
        rows = []
        for _ in range(rng.randint(1, 40)):
            b = bytearray(rng.choice(base))
            b[rng.randrange(m)] = rng.choice(b"abc")
            rows.append(bytes(b))
        order, prefix = suffixes.sort_suffixes(np.array([list(r) for r in rows], np.uint8))
        done = [rows[i] for i in order]
        assert done == sorted(rows)
        assert prefix.tolist()[1:] == [next((k for k in range(m) if a[k] != b[k]), m) for a, b in zip(done, done[1:])]


# --- 2 and 7 ---


def vectors_frame(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[200:230] = x[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (420, []), (440, [float("nan")] * 8), (450, [0.0] * 8), (460, [None] * 8), (480, [float("inf")] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x


def test_exact_top_k(spark):
    df, x = vectors_frame(spark)
    got = collections.defaultdict(list)
    levels = vectors.to_levels(vectors.usable(df))
    for r in vectors.exact_top_k(levels, every=50, per_query_block=3, per_block=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    f = np.concatenate([np.floor(256 * x.astype(float)).astype(int), np.zeros((1, 8), int)])
    ids = np.array([*range(300), 450])
    for q in [*range(0, 300, 50), 450]:
        s = f @ f[np.flatnonzero(ids == q)[0]]
        want = [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert got.pop(q) == want
    assert not got


def test_nearest(spark):
    df, x = vectors_frame(spark)
    got = collections.defaultdict(list)
    for r in vectors.nearest(vectors.usable(df, zero_too=False), per_block=100, rerank=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        hits += len(set(want) & {v for v, _ in got[q]})
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert len(got) == 15 and hits >= 0.9 * 300


def test_vectors_without_rows(spark):
    df, _ = vectors_frame(spark)
    none = vectors.usable(df.filter("false"))
    assert vectors.nearest(none).count() == 0 and vectors.exact_top_k(vectors.to_levels(none)).count() == 0
    one = vectors.usable(df.filter("vec_id = 0"))
    assert vectors.nearest(one).count() == 0 and vectors.exact_top_k(vectors.to_levels(one)).count() == 0


# --- 3 ---


def test_language(spark):
    rng = random.Random(4)
    sample = {"aa": ["labor", "mirum", "casta", "dolen"], "bb": ["xhosk", "wurtz", "grolk", "plivv"]}
    rows = [(i, " ".join(rng.choice(sample[k]) for _ in range(20)), k, "s", 1) for i in range(80) for k in ["aa" if i % 2 else "bb"]]
    rows += [(900, None, "aa", None, 0), (901, "12 ...", "bb", None, 0), (902, "", None, None, 0), (903, "xhosk " * 30_000, None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = languages.train(docs, languages.learnable())
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict(docs, model, ["doc_id"]).collect()}
    assert all(got[r[0]][0] == r[2] for r in rows[:80])
    assert [got[i][0] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert languages.train(docs.filter("false"), languages.learnable()) is None
    assert languages.predict(docs.filter("doc_id < 3"), None, ["doc_id"]).filter("lang_pred = 'und'").count() == 3


# --- 4 ---


def test_sentencepiece_is_the_library_s(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.tokenizer_file("piece_bpe_32k.model")
    model, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer.of(path)
    rng = random.Random(6)
    texts = ["", " ", "Hello  world\n\nfoo\t bar ", "ﬁ ①é é x　y", "a\x00b\r\n", "</s> [INST] 12345", "a" * 300, "🎉 日本語", "ab" * 5000, " a  b   c ", "▁x ▁"]
    texts += ["".join(rng.choice('abcdeth in onst ="\n.,é') for _ in range(rng.randint(1, 50))) for _ in range(2000)]
    for some in (texts, [t for t in texts if "\0" not in t]):
        ids, begin = fst.encode_all(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [model.encode(t) for t in some]
        assert [x.decode() for x in fst.decode_all(ids, begin)] == [t.replace("▁", " ") for t in some]
    rows = spark.createDataFrame([*enumerate(texts[:10]), (98, None), (0, "")], "doc_id long, text string").withColumn("n_ids", F.lit("other"))
    made = sentencepiece_fst.encode(rows, path)
    back = collections.Counter((r.doc_id, r.text) for r in sentencepiece_fst.decode(made, path).collect())
    assert back == collections.Counter([*enumerate(texts[:10]), (98, ""), (0, "")])
    assert made.filter("NOT decoded_same").count() == 0 and sentencepiece_fst.encode(rows.filter("false"), path).count() == 0


def _message(*fields):
    """A protocol buffer message of (number, value) fields: whole numbers, floats, bytes."""
    def number(n):
        return bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += number(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += number(k << 3) + number(v)
        else:
            out += number(k << 3 | 2) + number(len(v)) + v
    return out


def _model(kind, pieces, fallback, **normaliser):
    every = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []), *((p, w, 1) for p, w in pieces)]
    parts = [(1, _message((1, p.encode()), (2, w), (3, k))) for p, w, k in every]
    return _message(*parts, (2, _message((3, kind), (35, int(fallback)))), (3, _message((1, b"identity"), (3, normaliser.get("prefix", 1)), (4, normaliser.get("one_space", 0)), (5, 1))))


@pytest.mark.parametrize("kind, fallback, one_space", [(1, True, 0), (1, False, 1), (2, True, 0), (2, False, 1)])
def test_sentencepiece_models(kind, fallback, one_space):
    """Hand-made models of both kinds, with and without byte fallback, against the library."""
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(kind)
    pieces = ["▁", "a", "b", "c", "▁▁", "ab", "bc", "▁a", "abc", "ca", "▁ab", "aa", "aaa", "cab", "▁abc", "bb", "bca", "aabb", "ba", "▁b"]
    if kind == 2:
        weights = [-float(pieces.index(p)) for p in pieces]
    else:
        weights = [-rng.randint(8, 72) / 8 for _ in pieces]  # sums are exact, so ties are ties
    data = _model(kind, zip(pieces, weights), bool(fallback), one_space=one_space)
    model, fst = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_fst.Transducer.compile(data)
    texts = ["".join(rng.choice("aaabbbcc  é") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert fst.encode(t) == model.encode(t), t


def test_sentencepiece_normaliser():
    """Rules are read from a model's double-array trie, and the longest match is rewritten."""
    rules = {"ﬁ": "fi", "ﬁx": "FIX", "①": "1"}
    fst = sentencepiece_fst.Transducer({"f": 0, "i": 1, "1": 2, "x": 3, "▁": 4}, dict.fromkeys("fi1x▁", 0.0), [], [b"f", b"i", b"1", b"x", b" "], 9, True, rules)
    assert fst.normalise("aﬁ ﬁxﬁ①") == "▁afi▁FIXfi1"
    # keys a and ab, by the published layout: label in the low byte, bit 8 for a key's end, offset from bit 10 on
    units = [0] * 1024
    units[0] = 256 << 10
    units[256 ^ ord("a")] = ord("a") | 1 << 8 | (256 ^ ord("a") ^ 512) << 10
    units[512] = 1 << 31 | 0
    units[512 ^ ord("b")] = ord("b") | 1 << 8 | (512 ^ ord("b") ^ 768) << 10
    units[768] = 1 << 31 | 2
    assert sentencepiece_fst.rewrite_rules(struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"X\0yz\0") == {"a": "X", "ab": "yz"}


# --- 5 ---


def test_chat_layouts_and_round_trip(spark):
    nasty = "a\\b </s> <|end|>\n[INST]\\<|turn|>user\n <s"
    layouts = {
        "messages array<struct<role: string, content: string>>": [("user", nasty), ("assistant", "x")],
        "conversations array<struct<`from`: string, value: string>>": [("human", nasty), ("gpt", "x")],
    }
    for schema, value in layouts.items():
        df = spark.createDataFrame([(1, value)], f"conv_id long, {schema}")
        rows = chat.format_turns(chat.to_turns(df)).orderBy("turn").collect()
        assert [chat.parse_segment(r.segment) for r in rows] == [("user", nasty), ("assistant", "x")]
        inside = rows[0].segment[len("<|turn|>user\n") : -len("<|end|>\n")]
        assert not any(c in inside for c in chat.CONTROLS)
    flat = spark.createDataFrame([(1, "do", None, "done"), (2, "do", "it", None)], "conv_id long, instruction string, input string, output string")
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.to_turns(flat).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "do"), (1, 1, "assistant", "done"), (2, 0, "user", "do\n\nit"), (2, 1, "assistant", "")]
    with pytest.raises(ValueError):
        chat.to_turns(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, None, None, "odd"), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.to_turns(df))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nyes\nassistant\n\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 3, hashlib.sha256(b"yes").hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    assert chat.read_back(chat.format_turns(chat.to_turns(df.filter("false")))).count() == 0


# --- 6 ---


def test_packing(documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(documents, path, 256).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in documents.collect())
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(lengths, 256) <= len(bins) <= packing.lower_bound(lengths, 256) + 2
    assert packing.pack_documents(documents.filter("false"), path).count() == 0


def test_words_are_the_tokenizer_s():
    path = queries.tokenizer_file("word_bpe_49k.json")
    words_ = packing.WordCache(path, most=30)
    texts = ["Don't I'LL héé é ΑΣ Σ. <|endoftext|>x a..b a.,b 12,3.4 İx ǅ a_b _ ½ ² ①", "x" * 3000, "", "a b\x1cc\x85d  e", "a.b,c . , .", "ﬁn ſ K", None, *("w" + str(i) for i in range(50))]
    want = [words_.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, begin = words_.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == want
    rng = random.Random(2)
    signs = [*"abZ'. ,-12_eßİΣ中हि²Ⅷำᅡᄀ\t\n", "\u0301", "\u20dd", "'s", "'re", "\U0001f600", "\U0001d400", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    ids, begin = words_.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [e.ids for e in words_.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_pieces_hold_the_tokenizer_s_ids(documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in documents.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r.doc_id, k, a, len(ids[a : a + 200]), zlib.crc32(ids[a : a + 200].tobytes())) for k, a in enumerate(range(0, len(ids), 200))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pieces(documents, path, 200).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("kind", ["uniform", "short", "big"])
def test_packing_in_many_parts(spark, kind):
    """Parts with gaps exchange their items; the result is close to what one part gives."""
    rng = np.random.default_rng(4)
    lengths = {"uniform": rng.integers(1, 2049, 24_000), "short": rng.integers(1, 300, 24_000), "big": rng.integers(500, 1100, 24_000)}[kind]
    items = spark.createDataFrame([(i, int(x), "o") for i, x in enumerate(lengths)], "doc_id long, length long, offset string")
    rows = packing.pack(items, 2048, 1000).select("doc_id", "length", "sequence_id", "offset").toPandas()
    assert sorted(rows["doc_id"]) == list(range(len(lengths)))
    rows = rows.sort_values(["sequence_id", "offset"])
    before = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    assert (before == rows["offset"]).all() and (before + rows["length"] <= 2048).all()
    assert rows["sequence_id"].nunique() <= 1.005 * packing.best_fit(lengths, 2048)[2]


def test_lower_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 101, 60)
        _, _, n = packing.best_fit(lengths, 100)
        assert -(-lengths.sum() // 100) <= packing.lower_bound(lengths, 100) <= n
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


# --- 8 ---


def test_pages(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We use cookies, a lot of them.</div><article><h1>A &amp; B</h1><p>One  <b>two</b>\n three.<p>Short.</p><script>var a='</p>'</script><form><input name=q>Sign up</form></article><div id=comments><p>First comment, and it is long.</p></div><footer>End</footer>"
    assert pages.main_text(html) == "A & B\n\nOne two three.\n\nShort."
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>x</nav>") == ""
    plain = "<div class=menu>Home</div><div><p>" + "Long text here. " * 9 + "</p><p>" + "More of the text. " * 9 + "</p></div><div class='sidebar'>Side</div>"
    assert pages.main_text(plain) == ("Long text here. " * 9).strip() + "\n\n" + ("More of the text. " * 9).strip()
    assert pages.main_text("<<<p>&#x;&nope;<b") is not None
    df = spark.createDataFrame([(1, "u", html, "x"), (1, "u", html, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.n_chars) for r in pages.extract(df).collect()) == [(1, 29), (1, 29), (2, 0)]
    assert pages.extract(df.filter("false")).count() == 0


@pytest.mark.parametrize(
    "start",
    [
        "<head><title>x</title><body>",
        "<html><head><meta charset=utf-8><title>x</title>",
        "<head><style>p{}</style><noscript><img src=x></noscript><body>",
        "<body><p class=notice>Cookies are used.",
        "<body><p class=notice>Cookies <b>are used.",
        "<body><ul><li class=share>Share<div><li></ul>",
        "<body><dl><dt class=share>Share<dd></dl>",
        "<body><table><tr class=ad><td>x<tr><td>",
        "<body><table><tr><td class=ad><p>x<td>",
        "<body><select><option>a<option>b</select>",
        "<body><datalist><option>a<option>b</datalist>",
        "<body><h2 class=share>Share<h2>",
    ],
)
def test_pages_end_elements_by_implication(start):
    body = "Long text of the page. " * 9
    assert pages.main_text(f"{start}<div>{body}</div><div>{body}</div>") == body.strip() + "\n\n" + body.strip()


def test_pages_text_ends_head():
    assert pages.main_text("<head><title>x</title>" + "Long text of the page. " * 9).startswith("Long text")
    assert pages.main_text("<head><template><p>" + "Long text of the page. " * 9 + "</template></head>") == ""


# --- 9 ---


def components_of(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    name = {d: d for d in sets}
    while True:
        before = dict(name)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
        if before == name:
            return {d: (len(s), name[d]) for d, s in sets.items()}


def test_jaccard(documents, monkeypatch):
    want = components_of(rows_of(documents))
    for small in (16, 2):
        monkeypatch.setattr(jaccard, "SMALL", small)
        got = jaccard.similar(documents.filter("doc_id <> 107")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert jaccard.similar(documents.filter("false")).count() == 0
    assert jaccard.similar(documents.filter("doc_id = 107")).count() == 3


def test_jaccard_family(spark):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(i) for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = "x" + str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(rows)


def test_sketches_bound_overlaps():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 700, 9000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for m in (max(1, int(0.8 * n)), n, int(1.3 * n)):
            both = rng.integers(0, min(m, n) + 1)
            y = np.concatenate([x[:both], rng.integers(0, 1 << 63, m - both).astype(np.uint64)])
            room = jaccard._room([jaccard._sketch(x)], [jaccard._sketch(y)], np.array([min(m, n)]))[0]
            assert both <= room <= min(m, n)
    far = rng.integers(0, 1 << 63, (2, 9000)).astype(np.uint64)
    assert jaccard._room([jaccard._sketch(far[0])], [jaccard._sketch(far[1])], np.array([9000]))[0] < 0.75 * 9000


def test_jaccard_through_groups(spark, monkeypatch):
    """Families of near copies that share their rarest shingles, met in large meetings only."""
    monkeypatch.setattr(jaccard, "SMALL", 1)
    rng = random.Random(11)
    families = [[rng.choice(WORDS) + str(i) + "f" + str(f) for i in range(60)] for f in range(3)]
    shared = ["s" + str(i) for i in range(40)]
    rows = []
    for i in range(90):
        w = list(families[i % 3])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = "x" + str(rng.randrange(10**6))
        rows.append((i, " ".join(shared + w if i % 2 else w + shared)))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), most_last=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(rows)


def shingles_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def links_of(rows):
    """Every document's number of links: other sets of shingles with which its own is linked."""
    sets = {d: frozenset(shingles_of(x)) for d, x in rows}
    kinds = set(sets.values()) - {frozenset()}
    return {d: sum(175 * len(s & k) >= 75 * (len(s) + len(k)) for k in kinds if k != s) if s else 0 for d, s in sets.items()}


def test_jaccard_counts_all_links(spark, monkeypatch):
    """Families larger than a small meeting, of several sizes, in one block and in many."""
    rng = random.Random(21)
    rows = []
    for f, n in enumerate((60, 20, 3)):
        base = [rng.choice(WORDS) + str(i) + "f" + str(f) for i in range(80)]
        for _ in range(n):
            w = list(base[: rng.choice((80, 80, 70))])
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
            rows += [(len(rows), " ".join(w))]
    rows += [(1000, rows[0][1]), (1001, None), (1002, "")]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), links_of(rows)
    assert max(want.values()) > 40
    for small in (16, 1):
        monkeypatch.setattr(jaccard, "SMALL", small)
        got = jaccard.similar(docs).collect()
        assert {r.doc_id: r.n_links for r in got} == want
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(rows)
        uncounted = jaccard.similar(docs, count_links=False)
        assert uncounted.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(uncounted.collect()) == sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_blocks_count_links(spark):
    rng = np.random.default_rng(4)
    base, sets = np.arange(100), []
    for i in range(900):
        s = rng.choice(base, rng.integers(60, 101), replace=False) + 1000 * (i % 2)
        sets.append(np.unique(np.concatenate([s, rng.integers(10**6, 10**9, rng.integers(0, 30))])))
    have = [set(s.tolist()) for s in sets]
    want = collections.Counter()
    for i in range(900):
        for j in range(i):
            if i % 2 == j % 2 and 175 * len(have[i] & have[j]) >= 75 * (len(have[i]) + len(have[j])):
                want.update((i, j))
    members = spark.createDataFrame([(i, len(s), i % 2) for i, s in enumerate(sets)], "set long, n int, g long")
    held = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "set long, tokens array<long>")
    got = jaccard._counted(members, held, 75).groupBy("set").agg(F.sum("n_links").alias("n")).filter("n > 0").collect()
    assert {r.set: r.n for r in got} == dict(want)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


# --- 10 ---


def test_urls(spark):
    cases = [("http://A.Example.NET/en/x?q", "allow", "example.net/en/"), ("https://example.net/de/", "block", "net/"), ("http://m.example.com/de/1", "block", "example.com/de/"), ("http://notexample.com/de/1", "allow", None), ("http://x.org/fr/", "allow", "org/fr/"), ("http://x.net", "allow", None), ("x", "allow", None), (None, "allow", None), ("http://x.com/a.example.net/en/", "allow", None), ("http://net/?", "block", "net/"), ("http://x.net/" + "a" * 50_000, "block", "net/")]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in urls.filter_urls(df, queries.URL_RULES).collect()}
    assert got == {i: (v, r) for i, (_, v, r) in enumerate(cases)}
    assert urls.filter_urls(df.filter("false"), queries.URL_RULES).count() == 0


def test_url_globs():
    rules = [urls.Rule("block", "a*.com", "/x?z/*end"), *(urls.Rule("block", f"h{i}.de", "/") for i in range(40))]
    auto = urls.Automaton(rules)
    assert auto.words > 2
    texts = [(b"abc.com", b"/xyz/the end"), (b"s.a.com", b"/xyz/end/more"), (b"abc.org", b"/xyz/end"), (b"h39.de", b"/p"), (b"h399.de", b"/")]
    assert auto.run(texts).tolist() == [0, 0, -1, 40, -1]


# --- pipeline ---


def test_pipeline(spark, table, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{table}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, table)
        assert out.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert set(before) - set(after) == {d for d, t in texts.items() if not re.search(r"[^\W\d_]", t or "")}
        elif name == "near_duplicates":
            assert 104 not in after and len(after) < len(before)
        else:
            assert sum(map(len, after.values())) < sum(map(len, before.values()))
    assert {r.doc_id for r in corpus_pipeline.run(spark, table).collect()} == {r.doc_id for r in docs.collect()}
