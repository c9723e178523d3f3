"""Sanity rules on hand-made rows: counts, statuses and samples."""

from pyspark.sql import functions as F

from contractscope.operators import sanity
from contractscope.operators.sanity import Rule


def test_counts_statuses_and_samples(spark):
    df = spark.createDataFrame([(f"k{i:02}", i, None if i % 4 == 0 else i % 7) for i in range(40)] + [("k05", 5, 5)], "k string, a int, b int")
    rules = [Rule("never", F.lit(True), F.col("a") < 0, 0.0, "ERROR"), Rule("some", F.col("b").isNotNull(), F.col("b") == 5, 50.0), Rule("many", F.col("b").isNotNull(), F.col("b") != 5, 50.0, "HANDLED"), Rule("told", F.col("a") > 100, F.lit(True)), Rule("null", F.lit(True), F.col("b") > 3, 1.0)]
    got = {r.rule: (r.status, r.asked, r.broken) for r in sanity.check(df, rules).collect()}
    fives, known = sum(1 for i in range(40) if i % 4 and i % 7 == 5) + 1, 31
    assert got == {"never": ("OK", 41, 0), "some": ("OK", known, fives), "many": ("HANDLED", known, known - fives), "told": ("INFO", 0, 0), "null": ("WARNING", 41, sum(1 for i in range(40) if i % 4 and i % 7 > 3) + 1)}
    rows = sanity.samples(df, "k", rules[1:2], 3).collect()
    assert [(r.rule, r["rank"], r.k) for r in sorted(rows, key=lambda r: r["rank"])] == [("some", 1, "k05"), ("some", 2, "k05"), ("some", 3, "k19")]
    assert all(r.asked == r.broken == 0 for r in sanity.check(df.limit(0), rules).collect())


def test_lists_and_participants(spark):
    lists = sanity.list_frame(spark.createDataFrame([("A ",), ("B",), ("B",)], "cig string"), spark.createDataFrame([("A",), ("C",)], "cig string"))
    got = sanity.check(lists, sanity.list_rules()).first()
    assert (got.status, got.asked, got.broken) == ("ERROR", 3, 1)
    winners = spark.createDataFrame([("A", "1"), ("A", " 2"), ("B", "1"), ("C", None)], "cig string, codice_fiscale string")
    participants = spark.createDataFrame([("A", "1 "), ("A", "1"), ("C", "1"), (None, "2")], "cig string, codice_fiscale string")
    got = sanity.check(sanity.participant_frame(winners, participants), sanity.participant_rules()).first()
    assert (got.status, got.asked, got.broken, got.pct) == ("WARNING", 2, 1, 50.0)


def test_contrasts(spark):
    df = spark.createDataFrame([(1, 1.0, True), (1, 3.0, None), (0, None, False), (None, 9.0, True)], "label int, a double, b boolean")
    got = {(r.label, r.feature): (r.n, r["mean"], r["median"]) for r in sanity.contrasts(df, "label", ["a", "b"]).collect()}
    assert got == {(1, "a"): (2, 2.0, 2.0), (1, "b"): (1, 1.0, 1.0), (0, "a"): (0, None, None), (0, "b"): (1, 0.0, 0.0)}
