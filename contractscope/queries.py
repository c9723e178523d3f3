"""Registered queries: each applies the library's operators to the star-schema tables, with the equivalent SQL beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contractscope.functions import columns as C
from contractscope.operators import forensics, metrics, neural, panel, pu, rows, scoring, tabular

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> Column:
    return F.round(c, 6)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their quality as label, if any, and a score with ties."""
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 200 / 200.0).alias("score"), "lang", "toxic")


SCORED = "SELECT d.doc_id, quality AS label, (n_chars % 200) / 200.0 AS score, lang, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


# --- wide tables, rows per key, joins ---


@query("""
    WITH l AS (SELECT l_orderkey, count(*) AS n_lines, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_return, sum(nullif(l_discount, 0)) AS discount,
                      sum(l_extendedprice) AS price, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_custkey, c_mktsegment, coalesce(n_lines, 0) AS n_lines, any_return, round(discount, 6) AS discount, round(price / nullif(o_totalprice, 0), 6) AS price_ratio,
           CASE WHEN quantity IS NULL THEN 'MISSING' WHEN quantity <= 50 THEN '<=50' WHEN quantity <= 150 THEN '50-150' ELSE '150+' END AS quantity_bin,
           o_orderstatus = 'F' AND (coalesce(n_lines, 0) > 2 OR coalesce(any_return, 0) = 1) AS in_m3
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
""")
def wide_order_features(spark: SparkSession, d: str) -> DataFrame:
    """One wide row per order: line items reduced by one partial aggregation, attached by left joins."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("any_return"), F.sum(F.nullif("l_discount", F.lit(0.0))).alias("discount"), F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    base = rows.attach(t(spark, d, "orders"), lines, on="o_orderkey").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    n = F.coalesce("n_lines", F.lit(0))
    return base.select("o_orderkey", "o_custkey", "c_mktsegment", n.alias("n_lines"), "any_return", r6("discount").alias("discount"), r6(C.ratio(F.col("price"), F.col("o_totalprice"))).alias("price_ratio"), C.fixed_bins(F.col("quantity"), [50, 150], ["<=50", "50-150", "150+"]).alias("quantity_bin"), ((F.col("o_orderstatus") == "F") & ((n > 2) | (F.coalesce("any_return", F.lit(0)) == 1))).alias("in_m3"))


@query("""
    WITH a AS (SELECT l_orderkey AS cig, CAST(l_linenumber AS VARCHAR) AS id_aggiudicazione, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '' END AS mode, CASE WHEN l_discount > 0.02 THEN l_shipdate END AS day FROM lineitem),
    k AS (SELECT a.*, row_number() OVER (PARTITION BY cig ORDER BY CASE WHEN cig % 7 = 0 AND id_aggiudicazione = '2' THEN 0 WHEN mode = '' THEN 1 ELSE 2 END, day NULLS LAST, id_aggiudicazione, mode) AS k FROM a)
    SELECT cig, id_aggiudicazione, mode AS cod_modo_riaggiudicazione, strftime(day, '%Y-%m-%d') AS day FROM k WHERE k = 1
""")
def pick_award_row(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("cig"), F.col("l_linenumber").cast("string").alias("id_aggiudicazione"), F.when(F.col("l_returnflag") == "R", "1").otherwise("").alias("cod_modo_riaggiudicazione"), F.when(F.col("l_discount") > 0.02, F.col("l_shipdate")).alias("data_aggiudicazione_definitiva"))
    targets = lines.filter("cig % 7 = 0 AND id_aggiudicazione = '2'").select("cig", "id_aggiudicazione")
    return rows.pick_award(lines, targets, n_rows=lines.count()).select("cig", "id_aggiudicazione", "cod_modo_riaggiudicazione", F.col("data_aggiudicazione_definitiva").cast("date").cast("string").alias("day"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return rows.dedup_latest(t(spark, d, "events"), ["user_id"], "ts", F.col("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return rows.keep_first(t(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("""
    SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' END AS l_returnflag FROM lineitem GROUP BY 1
""")
def priority_category(spark: SparkSession, d: str) -> DataFrame:
    return rows.first_by_priority(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", ["R", "A", "N"], none=["N"])


@query("""
    WITH l AS (SELECT l_orderkey, max(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS late FROM lineitem GROUP BY 1) SELECT o_orderkey, late FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""")
def flag_three_state(spark: SparkSession, d: str) -> DataFrame:
    """1, 0, or null for orders without line items."""
    late = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_tax") > 0.07).cast("int")).alias("late"))
    return rows.attach(t(spark, d, "orders").select("o_orderkey"), late, on="o_orderkey")


_FALLBACK = """
    WITH s AS (SELECT CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS a, s_nationkey AS b, s_name FROM supplier), a AS (SELECT a, min(s_name) AS v FROM s GROUP BY 1), b AS (SELECT b, min(s_name) AS v FROM s GROUP BY 1),
    c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 150 END AS a, c_nationkey AS b FROM customer)
    SELECT c_custkey, coalesce(a.v, b.v) AS s_name FROM c LEFT JOIN a ON c.a {same} a.a LEFT JOIN b ON c.b {same} b.b
"""


def _fallback(spark: SparkSession, d: str, nulls: bool) -> DataFrame:
    table = t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("a"), F.col("s_nationkey").alias("b"), "s_name")
    base = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 150).alias("x"), F.col("c_nationkey").alias("y"))
    return rows.coalesce_lookup(base, table, [("x", "a"), ("y", "b")], "s_name", nulls).select("c_custkey", "s_name")


@query(_FALLBACK.format(same="="))
def join_fallback(spark: SparkSession, d: str) -> DataFrame:
    """First key, else second key; null keys match nothing."""
    return _fallback(spark, d, False)


@query(_FALLBACK.format(same="IS NOT DISTINCT FROM"))
def join_fallback_null_safe(spark: SparkSession, d: str) -> DataFrame:
    return _fallback(spark, d, True)


@query("""
    WITH y AS (SELECT c_nationkey AS nation, year(o_orderdate) AS anno, sum(o_totalprice) / count(*) AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT o_orderkey, c_nationkey AS nation, least(greatest(year(o_orderdate), 1994), 1996) AS anno, round(rate, 4) AS rate
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN y ON nation = c_nationkey AND y.anno = least(greatest(year(o_orderdate), 1994), 1996)
""")
def territory_join(spark: SparkSession, d: str) -> DataFrame:
    """Composite-key join on a place and a clamped year."""
    placed = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    rate = placed.groupBy("nation", F.year("o_orderdate").alias("anno")).agg((F.sum("o_totalprice") / F.count("*")).alias("rate"))
    return placed.withColumn("anno", C.clamp(F.year("o_orderdate"), 1994, 1996)).join(rate, ["nation", "anno"], "left").select("o_orderkey", "nation", "anno", F.round("rate", 4).alias("rate"))


@query("""
    WITH w AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS top FROM orders GROUP BY 1, 2)
    SELECT c_custkey, y AS year_used, round(top, 4) AS top FROM (SELECT c_custkey, o.y, o.top, row_number() OVER (PARTITION BY c_custkey ORDER BY (o.y = 1995) DESC NULLS LAST, o.y DESC NULLS LAST) AS k FROM customer LEFT JOIN o ON c_custkey = o_custkey) WHERE k = 1
""")
def latest_year_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The wanted year's row, else the latest year's."""
    yearly = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("anno")).agg(F.max("o_totalprice").alias("top")).withColumn("year_used", F.col("anno"))
    base = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("_id"), F.lit(1995).alias("anno"))
    return rows.latest_not_after(base, yearly, ["c_custkey"], "anno").select("c_custkey", "year_used", F.round("top", 4).alias("top"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_labels(spark: SparkSession, d: str) -> DataFrame:
    return rows.without(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) THEN 1 ELSE 0 END AS flag FROM orders")
def semi_flag(spark: SparkSession, d: str) -> DataFrame:
    return rows.present(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "flag")


@query("""
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    a, b = o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    count = lambda df, name: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count(a.union(b).distinct(), "union").unionByName(count(a.subtract(b), "minus")).unionByName(count(a.intersect(b), "both"))


@query("""
    WITH a AS (SELECT l_orderkey AS k, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT k, q, 1 AS label FROM a UNION ALL SELECT k, q, 0 FROM b WHERE k NOT IN (SELECT k FROM a)
""")
def label_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Of two lists with the same keys the first wins."""
    agg = lambda df, label: df.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("q")).withColumn("label", F.lit(label))
    lines = t(spark, d, "lineitem")
    return rows.first_wins(agg(lines.filter("l_returnflag = 'R'"), 1), agg(lines, 0), on=["k"])


@query("""
    SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 5) AND l_tax > 0.04))
""")
def outcome_override(spark: SparkSession, d: str) -> DataFrame:
    saved = t(spark, d, "lineitem").filter("l_linenumber IN (1, 5) AND l_tax > 0.04").select(F.col("l_orderkey").alias("o_orderkey"))
    return rows.unless_overridden(t(spark, d, "orders"), F.col("o_orderstatus") == "P", saved, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return rows.duplicates(t(spark, d, "lineitem"), ["l_orderkey"])


# --- panel and windows ---

_PANEL = """
    WITH s AS (SELECT user_id, CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) // 7 AS week, max(CASE WHEN value > 50 THEN value END) AS v FROM events GROUP BY 1, 2),
    u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, w.week FROM u, (SELECT unnest(range(0, 12)) AS week) w), j AS (SELECT p.*, s.v FROM p LEFT JOIN s USING (user_id, week))
"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    start = e.agg(F.min(F.to_date("ts")).alias("d0"))
    weekly = e.join(F.broadcast(start)).groupBy("user_id", F.expr("cast(datediff(to_date(ts), d0) div 7 as int)").alias("week")).agg(F.max(F.when(F.col("value") > 50, F.col("value"))).alias("v"))
    return panel.dense_panel(e.select("user_id").distinct(), 0, 11, "week").join(weekly, ["user_id", "week"], "left")


@query(_PANEL + "SELECT user_id, CAST(week AS INTEGER) AS week, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY week ROWS UNBOUNDED PRECEDING), 6) AS v FROM j")
def panel_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return panel.forward_fill(_panel(spark, d), ["user_id"], "week", ["v"]).select("user_id", "week", r6("v").alias("v"))


@query(_PANEL + """, n AS (SELECT user_id, week, first_value(v IGNORE NULLS) OVER w AS v, first_value(CASE WHEN v IS NOT NULL THEN week END IGNORE NULLS) OVER w AS hit FROM j WINDOW w AS (PARTITION BY user_id ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, CAST(week AS INTEGER) AS week, round(CASE WHEN hit - week <= 3 THEN v END, 6) AS v FROM n""")
def panel_backward_fill(spark: SparkSession, d: str) -> DataFrame:
    return panel.backward_fill(_panel(spark, d), ["user_id"], "week", ["v"], 3).select("user_id", "week", r6("v").alias("v"))


@query(_PANEL + """, m AS (SELECT user_id, week, v, CASE WHEN week <= 5 THEN CASE user_id WHEN 2 THEN 1 WHEN 4 THEN 3 WHEN 6 THEN 5 END END AS parent FROM j)
    SELECT m.user_id, CAST(m.week AS INTEGER) AS week, round(coalesce(o.v, m.v), 6) AS v FROM m LEFT JOIN j o ON m.parent = o.user_id AND m.week = o.week""")
def panel_parent_proxy(spark: SparkSession, d: str) -> DataFrame:
    """Users 2, 4 and 6 take the early values of those that they were split from."""
    return panel.parent_proxy(_panel(spark, d), {2: 1, 4: 3, 6: 5}, "user_id", "week", ["v"], 5).select("user_id", "week", r6("v").alias("v"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY md5('2025|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 50")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents in pseudo-random, reproducible order: a sampling operator."""
    return panel.sample_rows(t(spark, d, "documents"), 50, "doc_id").select("doc_id", "lang")


@query("""
    WITH x AS (SELECT quality, CASE WHEN n_chars > 400 THEN n_chars END AS a, CASE WHEN lang <> 'en' THEN lang END AS b FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT 100.0 * avg(CASE WHEN a IS NULL THEN 1 ELSE 0 END) FILTER (WHERE quality = 1) AS pa, 100.0 * avg(CASE WHEN a IS NULL THEN 1 ELSE 0 END) FILTER (WHERE quality = 0) AS na, 100.0 * avg(CASE WHEN b IS NULL THEN 1 ELSE 0 END) FILTER (WHERE quality = 1) AS pb, 100.0 * avg(CASE WHEN b IS NULL THEN 1 ELSE 0 END) FILTER (WHERE quality = 0) AS nb FROM x)
    SELECT 'a' AS feature, round(pa, 6) AS pct_p, round(na, 6) AS pct_n, round(pa - na, 6) AS delta FROM s UNION ALL SELECT 'b', round(pb, 6), round(nb, 6), round(pb - nb, 6) FROM s
""")
def missingness_signal(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 400, F.col("n_chars")).alias("a"), F.when(F.col("lang") != "en", F.col("lang")).alias("b"), F.lit(1).alias("c"))
    return forensics.missingness_signal(x, ["a", "b", "c"]).withColumns({c: r6(c) for c in ("pct_p", "pct_n", "delta")})


@query("SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER () * 100, 6) AS percentile_rank FROM part")
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return panel.percentile_rank(t(spark, d, "part"), "p_size").select("p_partkey", r6("percentile_rank").alias("percentile_rank"))


@query("""
    WITH s AS (SELECT p_partkey, (SELECT count(*) FROM part b WHERE b.p_size % 2 = 0 AND b.p_size < a.p_size) * 100.0 / (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS share FROM part a)
    SELECT p_partkey, round(share, 6) AS share_below, CASE WHEN share < 20 THEN 'low' WHEN share < 50 THEN 'medium' WHEN share < 80 THEN 'high' ELSE 'very high' END AS band FROM s
""")
def target_rank_band(spark: SparkSession, d: str) -> DataFrame:
    """Share of a reference population strictly below each row, and its risk band."""
    p = t(spark, d, "part")
    return panel.share_below(p, p.filter("p_size % 2 = 0").select("p_size"), "p_size").select("p_partkey", r6("share_below").alias("share_below"), panel.risk_band(F.col("share_below")).alias("band"))


_FOLDS = "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('2025|' || o_orderkey), o_orderkey) - 1) % 4 AS INTEGER) AS fold FROM {source}"


@query(f"""
    WITH i AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), o AS (SELECT * FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT')
    {_FOLDS.format(source="i")} UNION ALL {_FOLDS.format(source="o")}
""")
def hierarchical_folds(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return panel.nested_folds([o.filter("o_orderpriority = '1-URGENT'"), o], ["o_orderstatus"], "o_orderkey")


@query(f"""
    WITH f AS ({_FOLDS.format(source="orders")}), j AS (SELECT fold, o_totalprice AS x FROM orders JOIN f USING (o_orderkey))
    SELECT 'o_totalprice' AS feature, round(max(abs(m - mm) / sd), 6) AS balance FROM (SELECT fold, avg(x) AS m FROM j GROUP BY 1), (SELECT avg(x) AS mm, stddev_samp(x) AS sd FROM j)
""")
def fold_balance(spark: SparkSession, d: str) -> DataFrame:
    folds = panel.stratified_folds(t(spark, d, "orders"), ["o_orderstatus"], "o_orderkey")
    return panel.fold_balance(folds, ["o_totalprice"]).select("feature", r6("balance").alias("balance"))


# --- scalar functions ---


@query("""
    WITH w AS (SELECT o_orderkey, 'a' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS x, ' b' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' ' AS y FROM orders),
    i AS (SELECT o_orderkey, unnest([x, y]) AS id FROM w)
    SELECT o_orderkey, upper(trim(id)) AS id FROM i WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, upper(trim(x)) FROM w WHERE o_orderkey % 5 = 0
""")
def explode_ids(spark: SparkSession, d: str) -> DataFrame:
    """Cells with several identifiers, exploded; only valid ones stay. (Cells are made of keys, with blanks, short ones and a "none".)"""
    key = lambda letter, c: F.concat(F.lit(letter), F.lpad(F.col(c).cast("string"), 9, "0"))
    second = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), key("b", "o_custkey"), F.lit(" "))).otherwise("short")
    cells = t(spark, d, "orders").select("o_orderkey", F.concat(key("a", "o_orderkey"), F.lit(";"), second, F.lit("; ;0000000000")).alias("cell"))
    return cells.select("o_orderkey", F.explode(C.split_ids(F.col("cell"))).alias("id")).select("o_orderkey", C.valid_id(F.col("id")).alias("id")).filter("id IS NOT NULL")


@query("""
    SELECT doc_id, nullif(regexp_replace(upper(trim(lang || '  ' || source)), '[ \\t\\n\\r]+', ' ', 'g'), '') AS tidy,
           trim(regexp_replace(regexp_replace(translate(lower(trim(source || '-d''' || lang)), 'àáâãäåèéêëìíîïòóôõöùúûüçñý', 'aaaaaaeeeeiiiiooooouuuucny'), '[''’`-]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS outcome FROM documents
""")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", C.tidy(F.concat("lang", F.lit("  "), "source")).alias("tidy"), C.tidy_outcome(F.concat("source", F.lit("-d'"), "lang")).alias("outcome"))


@query("SELECT page_id, CAST(nullif(regexp_extract(url || ' 2019 x', '\\b(20[0-9][0-9])\\b', 1), '') AS INTEGER) AS year FROM pages")
def year_in_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", C.year_in(F.concat("url", F.lit(" 2019 x"))).alias("year"))


@query("""
    SELECT event_id, round(TRY_CAST(replace(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE replace(CAST(round(value, 2) AS VARCHAR), '.', ',') END, ',', '.') AS DOUBLE), 2) AS amount FROM events
""")
def decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.replace(F.round("value", 2).cast("string"), F.lit("."), F.lit(",")))
    return t(spark, d, "events").select("event_id", F.round(C.number(text), 2).alias("amount"))


@query("""
    SELECT p_partkey, CASE split_part(p_brand, '#', 2) WHEN '11' THEN 'A' WHEN '12' THEN 'A' WHEN '21' THEN 'B' ELSE NULL END AS class, CASE substr(p_type, 1, 2) WHEN 'ST' THEN 'COMMON' WHEN 'EC' THEN 'COMMON' WHEN 'PR' THEN 'FINE' ELSE 'OTHER' END AS prefix FROM part
""")
def category_maps(spark: SparkSession, d: str) -> DataFrame:
    brand = F.split_part("p_brand", F.lit("#"), F.lit(2))
    return t(spark, d, "part").select("p_partkey", C.look_up(brand, {"11": "A", "12": "A", "21": "B"}).alias("class"), C.prefix_class(F.col("p_type"), {"ST": "COMMON", "EC": "COMMON", "PR": "FINE"}, "OTHER").alias("prefix"))


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, days, CASE WHEN days >= 0 THEN days END AS lag FROM x
""")
def day_lags(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", C.days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"), C.lag_days(F.col("o_orderdate"), F.col("l_shipdate")).alias("lag"))


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS r FROM lineitem) SELECT l_orderkey, l_linenumber, round(r, 6) AS ratio, round(CASE WHEN r BETWEEN 0 AND 2 THEN r END, 6) AS capped FROM x
""")
def guarded_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(C.ratio(a, b)).alias("ratio"), r6(C.ratio(a, b, 0, 2)).alias("capped"))


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 7) AS q, l_tax, l_discount FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN greatest(coalesce(q, 0), 10 * l_tax + 20) > 0 THEN (10 * l_tax) / greatest(coalesce(q, 0), 20 + 10 * l_tax) END, 6) AS share, coalesce(abs(l_tax - l_discount) < 0.001, false) AS wins_low FROM x
""")
def bid_features(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").withColumn("q", F.nullif("l_quantity", F.lit(7.0)))
    return x.select("l_orderkey", "l_linenumber", r6(C.excluded_share(F.lit(20.0), 10 * F.col("l_tax"), F.col("q"))).alias("share"), C.near(F.col("l_tax"), F.col("l_discount")).alias("wins_low"))


# --- bins and imputation ---


@query("""
    SELECT p_partkey, CASE WHEN p_size <= 10 THEN '<=10' WHEN p_size <= 30 THEN '10-30' ELSE '30+' END AS size_bin,
           CASE WHEN nullif(p_size, 3) IS NULL THEN 'MISSING' WHEN p_size = 1 THEN '1' WHEN p_size = 2 THEN '2' WHEN p_size <= 5 THEN '3-5' ELSE '6+' END AS bids,
           CASE WHEN p_size = 3 THEN 'MISSING' WHEN p_size % 2 = 1 THEN '1' ELSE '0' END AS flag FROM part
""")
def fixed_bins(spark: SparkSession, d: str) -> DataFrame:
    size = F.nullif("p_size", F.lit(3))
    return t(spark, d, "part").select("p_partkey", C.fixed_bins(F.col("p_size"), [10, 30], ["<=10", "10-30", "30+"]).alias("size_bin"), C.exact_bins(size, {1: "1", 2: "2"}, [5], ["3-5", "6+"]).alias("bids"), C.flag_text(size % 2).alias("flag"))


@query("""
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'Q1' WHEN o_totalprice <= b THEN 'Q2' WHEN o_totalprice <= c THEN 'Q3' ELSE 'Q4' END AS bin FROM orders, q
""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    q = o.agg(F.percentile("o_totalprice", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")).first()["q"]
    return o.select("o_orderkey", C.quantile_bins(F.col("o_totalprice"), q).alias("bin"))


@query("""
    WITH x AS (SELECT c_custkey, c_acctbal AS v FROM customer), q AS (SELECT quantile_cont(ln(1 + v), 0.25) AS a, quantile_cont(ln(1 + v), 0.5) AS b, quantile_cont(ln(1 + v), 0.75) AS c FROM x WHERE v > 0)
    SELECT c_custkey, CASE WHEN v < 0 THEN 'MISSING' WHEN v = 0 THEN 'Q1' WHEN v <= exp(a) - 1 THEN 'Q1' WHEN v <= exp(b) - 1 THEN 'Q2' WHEN v <= exp(c) - 1 THEN 'Q3' ELSE 'Q4' END AS bin FROM x, q
""")
def log_quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    q = x.filter("v > 0").agg(F.percentile(F.log1p("v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first()["q"]
    log = C.quantile_bins(F.log1p("v"), [float("-inf"), *q, float("inf")])
    return x.select("c_custkey", F.when(F.col("v") > 0, log).when(F.col("v") == 0, "Q1").otherwise("MISSING").alias("bin"))


@query("""
    WITH x AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size END AS s, CASE WHEN p_size % 4 > 0 THEN p_brand END AS b FROM part), m AS (SELECT quantile_cont(s, 0.5) AS m FROM x), k AS (SELECT b FROM x WHERE b IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, b LIMIT 1)
    SELECT p_partkey, CAST(coalesce(s, m) AS DOUBLE) AS size, coalesce(x.b, k.b) AS brand FROM x, m, k
""")
def impute_median_mode(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).cast("double").alias("size"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("brand"))
    mode = x.agg(F.mode("brand", True)).first()[0]
    return pu.impute_median(x, ["size"]).withColumn("brand", F.coalesce("brand", F.lit(mode)))


@query("""
    WITH x AS (SELECT o_orderstatus AS s, nullif(o_orderpriority, '5-LOW') AS a, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS b FROM orders)
    SELECT s, 'a' AS "column", round(avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END), 6) AS rate FROM x GROUP BY 1 UNION ALL SELECT s, 'b', round(avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0 END), 6) FROM x GROUP BY 1
""")
def missing_rates(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("a"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("b"))
    return forensics.missing_rates(x, ["a", "b"], ["s"]).select("s", "column", r6("rate").alias("rate"))


@query("SELECT o_orderpriority AS value, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return pu.category_codes(t(spark, d, "orders"), "o_orderpriority")


@query("WITH m AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part WHERE p_size <= 25) SELECT p_partkey, round((p_retailprice - m) / s, 5) AS z FROM part, m")
def standardise(spark: SparkSession, d: str) -> DataFrame:
    return pu.standardise(t(spark, d, "part"), ["p_retailprice"], F.col("p_size") <= 25).select("p_partkey", F.round("p_retailprice", 5).alias("z"))


# --- metrics ---


@query(f"""
    WITH x AS ({SCORED}), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS p FROM x), k AS (SELECT unnest([0.01, 0.02, 0.05]) AS k),
    r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS i FROM x), th AS (SELECT k, (SELECT min(score) FROM r WHERE i = greatest(1, ceil(round(k * n, 9)))) AS th FROM k, n)
    SELECT CAST(k AS DOUBLE) AS k, round((SELECT count(*) FROM x WHERE label = 1 AND score >= th) / (k * p), 6) AS lift FROM th, n
""")
def lift_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lift_at(scored(spark, d), [0.01, 0.02, 0.05]).select("k", r6("lift").alias("lift"))


@query(f"""
    WITH x AS (SELECT * FROM ({SCORED}) WHERE label IS NOT NULL), g AS (SELECT lang, score, sum(label) AS p, count(*) AS n FROM x GROUP BY 1, 2),
    c AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS top FROM g)
    SELECT lang, round(CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN sum(p * tp / top) / sum(p) END, 6) AS pr_auc FROM c GROUP BY 1
""")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(scored(spark, d), ["lang"]).select("lang", r6("pr_auc").alias("pr_auc"))


@query(f"""
    WITH x AS (SELECT * FROM ({SCORED}) WHERE label IS NOT NULL), r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM x)
    SELECT lang, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS roc_auc FROM r GROUP BY 1
""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, d), ["lang"]).select("lang", r6("roc_auc").alias("roc_auc"))


@query(f"""
    WITH x AS (SELECT label, score AS p FROM ({SCORED}) WHERE label IS NOT NULL), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS c, avg(p) AS mp, avg(label) AS ml, sum((p - label) ** 2) AS se FROM x GROUP BY 1)
    SELECT round(sum(c * abs(mp - ml)) / sum(c), 6) AS ece, round(sum(se) / sum(c), 6) AS brier, CAST(sum(c) AS BIGINT) AS n FROM b
""")
def ece_brier(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(scored(spark, d), prob="score").select(r6("ece").alias("ece"), r6("brier").alias("brier"), "n")


@query(f"""
    WITH x AS (SELECT doc_id, 1 / (1 + exp(-(2.0 * score - 1.0))) AS p FROM ({SCORED}))
    SELECT doc_id, round(p, 6) AS p, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(0.02 / 0.98) - ln(0.3 / 0.7)))), 6) AS shifted FROM x
""")
def platt_prior_shift(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d).withColumn("p", metrics.platt(F.col("score"), 2.0, -1.0))
    return x.select("doc_id", r6("p").alias("p"), r6(metrics.prior_shift(F.col("p"), 0.02, 0.3)).alias("shifted"))


_CONFORMAL = f"""
    WITH x AS (SELECT doc_id, label, score AS prob FROM ({SCORED})), c AS (SELECT label, CASE WHEN label = 1 THEN 1 - prob ELSE prob END AS s FROM x WHERE label IS NOT NULL AND doc_id % 2 = 0),
    r AS (SELECT label, s, row_number() OVER (PARTITION BY label ORDER BY s) AS i, count(*) OVER (PARTITION BY label) AS n FROM c),
    q AS (SELECT max(s) FILTER (WHERE label = 1) AS q1, max(s) FILTER (WHERE label = 0) AS q0 FROM r WHERE i = floor(round(least(1.0, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1), 9)) + 1)
"""


def _conformal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = scored(spark, d).withColumnRenamed("score", "prob")
    return x, metrics.conformal_thresholds(x.filter("doc_id % 2 = 0"))


@query(_CONFORMAL + "SELECT round(q1, 6) AS q1, round(q0, 6) AS q0 FROM q")
def conformal_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _conformal(spark, d)[1].select(r6("q1").alias("q1"), r6("q0").alias("q0"))


@query(_CONFORMAL + """SELECT doc_id, CASE WHEN 1 - prob <= q1 AND prob <= q0 THEN '{0,1}' WHEN 1 - prob <= q1 THEN '{1}' WHEN prob <= q0 THEN '{0}' ELSE '{}' END AS "set" FROM x, q WHERE doc_id % 2 = 1""")
def conformal_sets(spark: SparkSession, d: str) -> DataFrame:
    x, q = _conformal(spark, d)
    return metrics.prediction_sets(x.filter("doc_id % 2 = 1"), q).select("doc_id", "set")


@query(_CONFORMAL + ", p AS (SELECT s FROM c WHERE label = 1) SELECT doc_id, round((1 + (SELECT count(*) FROM p WHERE s >= 1 - prob)) / ((SELECT count(*) FROM p) + 1.0), 6) AS p_value FROM x WHERE doc_id % 2 = 1")
def conformal_p_values(spark: SparkSession, d: str) -> DataFrame:
    x, _ = _conformal(spark, d)
    return metrics.conformal_p_values(x.filter("doc_id % 2 = 1"), x.filter("doc_id % 2 = 0")).select("doc_id", r6("p_value").alias("p_value"))


@query(_CONFORMAL + """, s AS (SELECT label, 1 - prob <= q1 AS in1, prob <= q0 AS in0 FROM x, q WHERE doc_id % 2 = 1 AND label IS NOT NULL)
    SELECT round(avg(CAST(CASE WHEN label = 1 THEN in1 ELSE in0 END AS INT)), 6) AS coverage, round(avg(CAST(in1 AS INT)) FILTER (WHERE label = 1), 6) AS coverage_1, round(avg(CAST(in0 AS INT)) FILTER (WHERE label = 0), 6) AS coverage_0,
           round(avg(CAST(in1 AS INT) + CAST(in0 AS INT)), 6) AS mean_size, round(avg(CAST(in1 AND in0 AS INT)), 6) AS share_both, round(avg(CAST(NOT in1 AND NOT in0 AS INT)), 6) AS share_empty FROM s""")
def conformal_coverage(spark: SparkSession, d: str) -> DataFrame:
    x, q = _conformal(spark, d)
    c = metrics.coverage(metrics.prediction_sets(x.filter("doc_id % 2 = 1"), q))
    return c.select(*[r6(k).alias(k) for k in c.columns])


# --- forensics ---


@query(f"""
    WITH x AS (SELECT label, score FROM ({SCORED}) WHERE label IS NOT NULL), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM x)
    SELECT 'score' AS feature, round(2 * (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) - 1, 6) AS delta FROM r
""")
def cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    return forensics.cliffs_delta(scored(spark, d), ["score"]).select("feature", r6("delta").alias("delta"))


@query(f"""
    WITH x AS (SELECT label, toxic FROM ({SCORED}) WHERE label IS NOT NULL), s AS (SELECT avg(toxic) FILTER (WHERE label = 1) AS p, avg(toxic) FILTER (WHERE label = 0) AS n FROM x)
    SELECT 'toxic' AS flag, round(p, 6) AS p_share, round(n, 6) AS n_share, round(CASE WHEN p > 0 AND n > 0 THEN log2(p / n) END, 6) AS log2_ratio FROM s
""")
def log2_ratio(spark: SparkSession, d: str) -> DataFrame:
    return forensics.log2_ratio(scored(spark, d), ["toxic"]).select("flag", *[r6(c).alias(c) for c in ("p_share", "n_share", "log2_ratio")])


@query("""
    WITH g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits FROM orders GROUP BY 1 HAVING count(*) >= 10), z AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM g)
    SELECT o_orderpriority, n, hits, round(p, 6) AS share, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS lower, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS upper FROM z
""")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    s = forensics.share_with_interval(t(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")
    return s.select("o_orderpriority", "n", "hits", *[r6(c).alias(c) for c in ("share", "lower", "upper")])


@query("""
    WITH g AS (SELECT o_orderstatus, CAST(substr(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM orders WHERE o_totalprice >= 1 GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderstatus) * 100 AS share, log10(1 + 1.0 / digit) * 100 AS expected FROM g),
    m AS (SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS n, avg(abs(share - expected)) / 100 AS mad FROM s GROUP BY 1)
    SELECT o_orderstatus, n, round(mad, 6) AS mad, CASE WHEN mad < 0.006 THEN 'close' WHEN mad < 0.012 THEN 'acceptable' WHEN mad < 0.015 THEN 'marginal' ELSE 'nonconforming' END AS verdict FROM m
""")
def benford(spark: SparkSession, d: str) -> DataFrame:
    v = forensics.benford_verdict(forensics.benford(t(spark, d, "orders"), "o_totalprice", ["o_orderstatus"]), ["o_orderstatus"])
    return v.select("o_orderstatus", "n", r6("mad").alias("mad"), "verdict")


@query("""
    WITH k AS (SELECT unnest([40000.0, 150000.0]) AS t) SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE o_totalprice > t * 0.9 AND o_totalprice <= t) AS below, count(*) FILTER (WHERE o_totalprice > t AND o_totalprice <= t * 1.1) AS above,
    round(count(*) FILTER (WHERE o_totalprice > t * 0.9 AND o_totalprice <= t) / greatest(count(*) FILTER (WHERE o_totalprice > t AND o_totalprice <= t * 1.1), 1), 6) AS ratio FROM orders, k GROUP BY t
""")
def bunching(spark: SparkSession, d: str) -> DataFrame:
    return forensics.bunching(t(spark, d, "orders"), "o_totalprice", [40000, 150000]).withColumn("ratio", r6("ratio"))


@query("""
    WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, l_quantity AS bidders, l_extendedprice AS win, l_discount * 100 AS disc, l_tax AS tax, l_linestatus FROM lineitem), s AS (SELECT g, quantile_cont(win, 0.5) AS w, quantile_cont(disc, 0.25) AS q FROM x GROUP BY 1)
    SELECT l_orderkey, l_linenumber, CAST(bidders <= 1 AS INT) + CAST(l_linestatus <> 'O' AS INT) + CAST(win < w AS INT) + CAST(tax > 0.06 AS INT) + CAST(disc < q AS INT) AS cri FROM x JOIN s USING (g)
""")
def red_flag_index(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("num_imprese_offerenti"), F.col("l_extendedprice").alias("finestra_offerta_giorni"), (F.col("l_discount") * 100).alias("ribasso_aggiudicazione"), (F.col("l_tax") > 0.06).cast("int").alias("flag_urgenza"), F.when(F.col("l_linestatus") == "O", "APERTA").otherwise("ALTRO").alias("tipo_scelta_4cls"))
    return forensics.red_flags(x, "g").select("l_orderkey", "l_linenumber", "cri")


@query("""
    WITH x AS (SELECT CASE WHEN l_quantity <= 2 AND l_discount * 100 < 5 THEN 'monopoly' WHEN l_quantity >= 5 AND l_tax * 100 < 2 THEN 'cover bidding' WHEN l_quantity >= 5 AND l_tax * 100 >= 2 THEN 'competitive' ELSE 'between' END AS zone,
           CAST(l_returnflag = 'R' AS INT) + CAST(l_linestatus = 'F' AS INT) + CAST(l_linenumber = 1 AS INT) AS severity FROM lineitem) SELECT zone, severity, count(*) AS n FROM x GROUP BY 1, 2
""")
def zones_and_severity(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: c.cast("int")
    x = t(spark, d, "lineitem").select(forensics.bid_zone(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100).alias("zone"), forensics.severity(one(F.col("l_returnflag") == "R"), one(F.col("l_linestatus") == "F"), one(F.col("l_linenumber") == 1)).alias("severity"))
    return x.groupBy("zone", "severity").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey), 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def share_in_group(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy("n_regionkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return g.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("n_regionkey"))))


@query("""
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT CASE WHEN o_totalprice <= a THEN 'Q1' WHEN o_totalprice <= b THEN 'Q2' WHEN o_totalprice <= c THEN 'Q3' ELSE 'Q4' END AS quartile, o_orderpriority, count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS rate FROM orders, q GROUP BY 1, 2 HAVING count(*) >= 20
""")
def quartile_heat(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    q = o.agg(F.percentile("o_totalprice", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")).first()["q"]
    g = o.groupBy(C.quantile_bins(F.col("o_totalprice"), q).alias("quartile"), "o_orderpriority").agg(F.count("*").alias("n"), r6(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("rate"))
    return g.filter("n >= 20")


@query("""
    SELECT 'M1' AS phase, count(*) AS n FROM orders UNION ALL SELECT 'M2', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'M3', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000
    UNION ALL SELECT 'M1 only', count(*) FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' UNION ALL SELECT 'M2 only', count(*) FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 150000
""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return forensics.funnel(o, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'F' AND o_totalprice > 150000"), "o_orderkey")


@query("""
    WITH s AS (SELECT * FROM supplier), r AS (SELECT max(s_acctbal) - min(s_acctbal) AS d FROM s), p AS (SELECT a.s_suppkey, b.s_suppkey AS other, (abs(a.s_acctbal - b.s_acctbal) / d + CASE WHEN a.s_nationkey = b.s_nationkey THEN 0 ELSE 1 END) / 2 AS distance FROM s a, s b, r WHERE a.s_suppkey <> b.s_suppkey)
    SELECT s_suppkey, CAST(rank AS INTEGER) AS rank, other, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, other) AS rank FROM p) WHERE rank <= 5
""")
def gower_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return forensics.gower_neighbours(t(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], ["s_nationkey"], 5).withColumn("distance", r6("distance"))


# --- small table operators ---


@query("SELECT user_id, coalesce(string_agg(DISTINCT event_type, ', ' ORDER BY event_type), '') AS kinds FROM events GROUP BY user_id")
def joined_set(spark: SparkSession, d: str) -> DataFrame:
    return tabular.joined_set(t(spark, d, "events"), ["user_id"], "event_type", "kinds")


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_quantity > 45 AND l_discount > 0.05) AS bulk FROM lineitem GROUP BY 1")
def any_of(spark: SparkSession, d: str) -> DataFrame:
    return tabular.any_of(t(spark, d, "lineitem"), ["l_orderkey"], returned=F.col("l_returnflag") == "R", bulk=(F.col("l_quantity") > 45) & (F.col("l_discount") > 0.05))


@query("""
    WITH x AS (SELECT quality AS label, lang AS value, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL)
    SELECT label, value, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM x
""")
def crosstab_by_label(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return tabular.crosstab(x, "quality", "lang").withColumn("share", r6("share"))


@query("SELECT l_suppkey, round(sum(l_extendedprice + l_tax) / sum(l_quantity), 6) AS unit_price FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 0")
def group_ratio(spark: SparkSession, d: str) -> DataFrame:
    return tabular.group_ratio(t(spark, d, "lineitem"), ["l_suppkey"], ["l_extendedprice", "l_tax"], "l_quantity", "unit_price").withColumn("unit_price", r6("unit_price"))


@query("SELECT CASE WHEN o_totalprice < 40000 THEN '<40k' WHEN o_totalprice < 150000 THEN '40k-150k' WHEN o_totalprice < 1000000 THEN '150k-1M' ELSE '>=1M' END AS band, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1")
def amount_bands(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(tabular.amount_band(F.col("o_totalprice")).alias("band")).filter("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 1 AND 25 AND l_discount > 0.01 AND l_discount < 0.09")
def range_filters(spark: SparkSession, d: str) -> DataFrame:
    return tabular.within(t(spark, d, "lineitem"), closed={"l_quantity": (1, 25)}, opened={"l_discount": (0.01, 0.09)}).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def features_onto_base(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return tabular.onto(n, t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["n"])


@query(f"""
    WITH x AS ({SCORED}), m AS (SELECT median(score) AS m FROM x),
    c AS (SELECT 'highest' AS "case", doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM x UNION ALL SELECT 'hard_positive', doc_id, score, row_number() OVER (ORDER BY score, doc_id) FROM x WHERE label = 1
          UNION ALL SELECT 'extreme_negative', doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) FROM x WHERE label = 0 UNION ALL SELECT 'median', doc_id, score, row_number() OVER (ORDER BY abs(score - m), doc_id) FROM x, m)
    SELECT "case", doc_id, score FROM c WHERE k = 1
""")
def telling_cases(spark: SparkSession, d: str) -> DataFrame:
    return tabular.telling_cases(scored(spark, d), "doc_id")


@query(f"""
    WITH x AS (SELECT doc_id, label, CAST(doc_id % 4 AS INTEGER) AS fold FROM ({SCORED})), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('42|' || doc_id), doc_id) AS k FROM x WHERE label IS NULL)
    SELECT doc_id, label, fold FROM x WHERE label IS NOT NULL UNION ALL SELECT doc_id, label, fold FROM r WHERE k <= 20
""")
def sample_per_fold(spark: SparkSession, d: str) -> DataFrame:
    return tabular.sample_per_fold(scored(spark, d).select("doc_id", "label", (F.col("doc_id") % 4).cast("int").alias("fold")), "doc_id", 20)


@query("""
    WITH c AS (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL), k AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM c)
    SELECT o_orderkey, coalesce(code, -1) AS o_orderpriority FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderpriority END AS p FROM orders) LEFT JOIN k ON p = v
""")
def learnt_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes learnt on some orders, applied to all; null and new levels are -1."""
    o = t(spark, d, "orders")
    levels = scoring.level_codes(o.filter("o_orderstatus = 'F'"), ["o_orderpriority"])
    p = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 7 == 0, "new").otherwise(F.col("o_orderpriority"))
    return tabular.codes_or_minus_one(o.select("o_orderkey", p.alias("o_orderpriority")), ["o_orderpriority"], levels)


# --- positive-unlabelled learning ---


@query(f"SELECT doc_id, CASE WHEN label IS NOT NULL THEN 1.0 ELSE 0.025 END AS weight, CASE WHEN label = 1 THEN 1.0 ELSE 0.025 END AS weight_pu FROM ({SCORED})")
def biased_weights(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("doc_id", pu.biased_weight(F.col("label")).alias("weight"), pu.biased_weight(F.col("label"), with_negatives=False).alias("weight_pu"))


@query(f"""
    WITH x AS ({SCORED}), c AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n, count(*) FILTER (WHERE label IS NULL) AS u FROM x)
    SELECT doc_id, 1 AS target, round(score * 0.05 * (p + n) / u, 9) AS weight FROM x, c WHERE label IS NULL UNION ALL SELECT doc_id, 0, round((1 - score) * 0.05 * (p + n) / u, 9) FROM x, c WHERE label IS NULL
    UNION ALL SELECT doc_id, label, round(CASE WHEN label = 1 THEN n / p ELSE 1.0 END, 9) FROM x, c WHERE label IS NOT NULL
""")
def em_soft_rows(spark: SparkSession, d: str) -> DataFrame:
    return pu.em_soft_rows(scored(spark, d)).select("doc_id", "target", F.round("weight", 9).alias("weight"))


@query(f"SELECT round(avg(score) FILTER (WHERE label = 1), 6) AS c, round(least(1.0, avg(score) FILTER (WHERE label IS NULL) / avg(score) FILTER (WHERE label = 1)), 6) AS prior FROM ({SCORED})")
def elkan_noto(spark: SparkSession, d: str) -> DataFrame:
    return pu.elkan_noto(scored(spark, d)).select(r6("c").alias("c"), r6("prior").alias("prior"))


@query("""
    WITH q AS (SELECT quantile_cont(p_size, 0.05) AS a, quantile_cont(p_size, 0.95) AS b FROM part), g AS (SELECT a + (b - a) * i / 4.0 AS v FROM q, (SELECT unnest(range(0, 5)) AS i))
    SELECT CAST(v AS DOUBLE) AS value, round((SELECT avg(1 / (1 + exp(-(v / 50.0 - p_retailprice / 2000.0)))) FROM part), 6) AS mean_score FROM g
""")
def partial_dependence(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return pu.partial_dependence(x, "p_size", C.sigmoid(F.col("p_size") / 50.0 - F.col("p_retailprice") / 2000.0), 5).withColumn("mean_score", r6("mean_score"))


#: Least ratio of the shares of unlabelled and of positive rows at or above 200 thresholds, for each group f of x (f, label, score).
_LEAST_RATIO = """q AS (SELECT f, quantile_cont(score, 0.05) AS a, quantile_cont(score, 0.95) AS b FROM x GROUP BY f), g AS (SELECT f, i, a + (b - a) * i / 199.0 AS e FROM q, (SELECT unnest(range(0, 200)) AS i)),
    r AS (SELECT x.f, i, avg(CASE WHEN score >= e - 1e-9 THEN 1.0 ELSE 0 END) FILTER (WHERE label IS NULL) AS u, avg(CASE WHEN score >= e - 1e-9 THEN 1.0 ELSE 0 END) FILTER (WHERE label = 1) AS p FROM x JOIN g ON x.f = g.f GROUP BY ALL)"""


@query(f"WITH x AS (SELECT 1 AS f, label, score FROM ({SCORED})), {_LEAST_RATIO} SELECT round(least(1.0, min(u / p)), 6) AS prior FROM r WHERE p > 0")
def blanchard_prior(spark: SparkSession, d: str) -> DataFrame:
    return pu.blanchard(scored(spark, d)).select(r6("prior").alias("prior"))


@query(f"""
    WITH s AS ({SCORED}), k AS (SELECT least(1.0, avg(score) FILTER (WHERE label IS NULL) / avg(score) FILTER (WHERE label = 1)) AS p0 FROM s), a AS (SELECT f, p0, least(greatest(p0 * f, 1e-6), 0.9999) AS assumed FROM k, (SELECT CAST(unnest([0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4]) AS DOUBLE) AS f)),
    x AS (SELECT f, label, least(greatest(score * (assumed / greatest(p0, 1e-6)), 0.0), 1.0) AS score FROM s, a), {_LEAST_RATIO}
    SELECT a.f AS factor, round(assumed, 6) AS assumed, round(least(1.0, (SELECT min(u / p) FROM r WHERE p > 0 AND r.f = a.f)), 6) AS estimate FROM a
""")
def prior_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The quantile estimate of the prior under nine assumed priors."""
    x = scored(spark, d)
    return pu.prior_sensitivity(x, pu.elkan_noto(x).first()["prior"]).select("factor", r6("assumed").alias("assumed"), r6("estimate").alias("estimate"))


@query()
def kernel_mean_runs(spark: SparkSession, d: str) -> DataFrame:
    """Kernel-mean estimates of the share of good documents among unlabelled ones, on ten independent samples."""
    return pu.multi_sample_prior(_features(spark, d), "doc_id", FEATURES)


_RANKS = "100 * (rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0) / count(*) OVER () AS {s}"


@query(f"""
    WITH x AS (SELECT (n_chars % 200) / 200.0 AS a, (n_chars % 97) / 97.0 AS b, n_chars * 1.0 AS c FROM documents), r AS (SELECT {_RANKS.format(s='a')}, {_RANKS.format(s='b')}, {_RANKS.format(s='c')} FROM x)
    SELECT 'a' AS model_a, 'b' AS model_b, count(*) AS n, round(corr(a, b), 6) AS spearman, round(avg(abs(a - b)), 6) AS mae, round(avg(CASE WHEN abs(a - b) > 20 + 1e-9 THEN 100.0 ELSE 0 END), 6) AS share_far FROM r
    UNION ALL SELECT 'a', 'c', count(*), round(corr(a, c), 6), round(avg(abs(a - c)), 6), round(avg(CASE WHEN abs(a - c) > 20 + 1e-9 THEN 100.0 ELSE 0 END), 6) FROM r
    UNION ALL SELECT 'b', 'c', count(*), round(corr(b, c), 6), round(avg(abs(b - c)), 6), round(avg(CASE WHEN abs(b - c) > 20 + 1e-9 THEN 100.0 ELSE 0 END), 6) FROM r
""")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far three scores agree on the ranks of documents."""
    n = F.col("n_chars")
    x = t(spark, d, "documents").select((n % 200 / 200.0).alias("a"), (n % 97 / 97.0).alias("b"), (n * 1.0).cast("double").alias("c"))
    return metrics.rank_agreement(x, ["a", "b", "c"]).withColumns({k: r6(k) for k in ("spearman", "mae", "share_far")})


@query()
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of the mean score by language, from Poisson replicates."""
    return metrics.bootstrap(scored(spark, d), "doc_id", F.col("score"), keys=["lang"])


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a few cheap numbers, and quality as label where known."""
    x = t(spark, d, "documents").select("doc_id", (F.log1p(F.length("text")) / 10).alias("size"), (F.length(F.regexp_replace("text", r"[\p{L}\s]+", "")) / (F.length("text") + 1)).alias("odd"), (F.length(F.regexp_replace("text", r"[^A-Z]+", "")) / (F.length("text") + 1)).alias("upper"))
    return x.join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").alias("label"), *FEATURES)  # no text is shuffled


FEATURES = ["size", "odd", "upper"]


def _once(df: DataFrame) -> DataFrame:
    """df computed once, where the cluster names a folder for that: its texts are read and its features made one time only."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df kept in memory while a model is fitted on it, and let go after that."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@query()
def mlp_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a multilayer net under the non-negative PU risk."""
    x = _once(_features(spark, d))
    return neural.net_scores(x, ["doc_id", "label"], FEATURES, neural.fit_net(x, "doc_id", FEATURES, prior=0.5))


@query()
def kernel_scores(spark: SparkSession, d: str) -> DataFrame:
    """Signed distances of a biased kernel machine on random features."""
    x = _once(_features(spark, d))
    return neural.kernel_scores(x, ["doc_id", "label"], FEATURES, neural.fit_kernel(x, FEATURES))


@query()
def nnpu_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a linear model under the non-negative PU risk."""
    with held(_features(spark, d)) as x:
        w = pu.nnpu_logit(x, FEATURES, prior=0.5)
    return x.select("doc_id", "label", pu.linear_score(FEATURES, w).alias("score"))


@query()
def bagged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of models fitted on bags of unlabelled rows."""
    with held(_once(_features(spark, d))) as x:
        return pu.bagged_score(x, FEATURES, pu.bagged_weights(x, "doc_id", FEATURES)).select("doc_id", "label", "score")


@query()
def em_hard_rounds(spark: SparkSession, d: str) -> DataFrame:
    with held(_features(spark, d)) as x:
        return pu.em_hard(x, FEATURES)[1]


@query()
def supervised_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted logistic regression on positives against the rest."""
    x = pu.assemble(_features(spark, d), FEATURES).withColumns({"target": (F.coalesce("label", F.lit(0)) == 1).cast("int"), "weight": pu.biased_weight(F.col("label"))})
    model = pu.supervised(x, "logit", "weight", elasticNetParam=0.5, regParam=0.001)
    return pu.positive_probability(model.transform(x)).select("doc_id", "label", "score")


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    with held(_features(spark, d)) as x:
        w = pu.nnpu_logit(x, FEATURES, prior=0.5)
    return pu.permutation_importance(x, "doc_id", FEATURES, pu.linear_score(FEATURES, w))


@query()
def platt_fit(spark: SparkSession, d: str) -> DataFrame:
    """Slope and intercept with Fisher standard errors."""
    p = metrics.fit_platt(scored(spark, d))
    return spark.createDataFrame([tuple(p.values())], "a double, b double, se_a double, se_b double")
