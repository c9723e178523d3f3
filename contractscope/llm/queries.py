"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractscope.llm import bpe, chat, divergence, jaccard, languages, lexical, packing, pages, sentencepiece_fst, suffixes, urls, vectors
from contractscope.llm.frames import small_batches

#: The rules that the URL query applies.
URL_RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that occur earlier."""
    small_batches(spark, 512)
    return suffixes.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    return vectors.nearest(vectors.usable(_read(spark, sf_dir, "embeddings"), zero_too=False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from documents that are not held out."""
    small_batches(spark, 512)
    docs = _read(spark, sf_dir, "documents")
    model = languages.train(docs, languages.learnable())
    return languages.predict(docs, model, ["doc_id"]).select("doc_id", (~languages.learnable()).alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives the text back."""
    small_batches(spark, 500)
    return sentencepiece_fst.encode(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, formatted and read back."""
    small_batches(spark, 2000)
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, [("user", control), ("assistant", control)])], "conv_id long, messages array<struct<role: string, content: string>>")
    turns = chat.to_turns(_read(spark, sf_dir, "conversations")).unionByName(chat.to_turns(extra))
    return chat.read_back(chat.format_turns(turns))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    small_batches(spark, 1000)
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose vec_id is divisible by 50."""
    return vectors.exact_top_k(vectors.to_levels(vectors.usable(_read(spark, sf_dir, "embeddings"))))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    small_batches(spark, 500)
    return pages.extract(_read(spark, sf_dir, "pages"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links by word shingles."""
    small_batches(spark, 512)
    return jaccard.similar(_read(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    small_batches(spark, 4000)
    return urls.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    small_batches(spark, 512)
    path = tokenizer_file("word_bpe_49k.json")
    made = bpe.encode_and_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    small_batches(spark, 2000)
    return lexical.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source of every language differs from the others, and by which terms."""
    small_batches(spark, 20_000)
    return divergence.audit(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffixes": op1_suffixes, "op2_neighbours": op2_neighbours, "op3_language": op3_language, "op4_sentencepiece": op4_sentencepiece, "op5_chat": op5_chat, "op6_pack": op6_pack, "op7_topk": op7_topk, "op8_html": op8_html, "op9_jaccard": op9_jaccard, "op10_urls": op10_urls, "op11_bpe": op11_bpe, "op12_lexical": op12_lexical, "op13_divergence": op13_divergence}


_CONTROL = "'</s>[INST] ok [/INST]'"

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

SQL = {
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS f FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.f, c.f), lambda x: x[1] * x[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op13_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, {_WORD}) AS terms FROM documents),
        t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
        c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
        g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, CAST(1 + (1000000000 * CAST(coalesce(c, 0) + 1 AS HUGEINT)) // (g.n + v.v) AS BIGINT) AS p,
              CAST(1 + (1000000000 * CAST(kept.total + 1 AS HUGEINT)) // (v.n + v.v) AS BIGINT) AS q
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
        more AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM more)
        SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
        UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM ranked WHERE rank <= 200
    """,
    "op12_lexical": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
        dt AS (SELECT row, doc_id, unnest(regexp_extract_all({_FOLDED}, {_TERM})) AS term FROM d),
        tf AS (SELECT row, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
        len AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
        g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
        m AS (SELECT row, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM len, g),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_FOLDED}, {_TERM})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
        s AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op10_urls": r"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(v, h, p)),
        fits AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
                 FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
    """,
    "op5_chat": f"""
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', {_CONTROL} UNION ALL SELECT -1, 1, 'assistant', {_CONTROL}),
        lens AS (SELECT *, length(replace(replace(replace(replace(text, '\\', '\\\\'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')) AS esc FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(esc + length(role) + 17) AS BIGINT) AS formatted_chars
        FROM lens GROUP BY conv_id
    """,
}
