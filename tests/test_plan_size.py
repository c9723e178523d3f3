"""How often plans reduce the same table: shared steps are made once."""

from pyspark.sql import functions as F

from contractscope import plan_queries
from contractscope.functions.columns import moment
from contractscope.operators import sanity

SF = "/root/testdata/sf0.001"


def windows(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_contracts_and_awards_are_reduced_once(spark):
    wide = windows(plan_queries.wide(spark, SF))
    assert wide <= 9  # contracts and their authorities' codes, awards, first awards, winners, starts, tests, and the target awards of two
    assert windows(plan_queries._audit(spark, SF)) <= wide + 1


def test_samples_copy_no_rows(spark):
    rules = [sanity.Rule(f"r{i}", F.lit(True), F.col("a") % 3 == i) for i in range(3)]
    df = spark.createDataFrame([(None if i == 7 else f"k{i:03}", i) for i in range(200)], "k string, a int").repartition(5)
    made = sanity.samples(df, "k", rules, 2)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.rule, r["rank"], r.k) for r in made.collect()) == [("r0", 1, "k000"), ("r0", 2, "k003"), ("r1", 1, None), ("r1", 2, "k001"), ("r2", 1, "k002"), ("r2", 2, "k005")]
    assert sanity.samples(df.limit(0), "k", rules, 2).count() == 0


def test_texts_that_fit_no_format_are_not_tried(spark):
    df = spark.createDataFrame([("2020-01-02",), (" 2020-01-02 03:04:05 ",), ("02/01/2020",), ("garbage",), ("2020-13-01",), ("1899-01-01",), ("",), (None,)], "t string")
    made = [r[0] for r in df.select(moment(F.col("t")).cast("string")).collect()]
    assert made == ["2020-01-02 00:00:00", "2020-01-02 03:04:05", *[None] * 6]
    other = df.select(moment(F.col("t"), ("d MMMM yyyy", "dd/MM/yyyy", "yyyy-MM-dd")).cast("string").alias("m")).collect()
    assert [r.m for r in other][:3] == ["2020-01-02 00:00:00", None, "2020-01-02 00:00:00"]
    assert "char_length" in df.select(moment(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
