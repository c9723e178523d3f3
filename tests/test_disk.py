"""What the nested datasets put on disk: statistics from few files, and wide rows that are dealt by contract alone."""

from contractscope import plan_queries
from contractscope.plans import datasets
from contractscope.session import freed_shuffles

SF = "/root/testdata/sf0.001"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_statistics_come_from_few_files(spark, monkeypatch):
    asked, freed = [], []
    wide, first = plan_queries.wide, type(spark.range(1)).first
    monkeypatch.setattr(plan_queries, "wide", lambda s, d, files=tuple(plan_queries.FILES): asked.append(tuple(files)) or wide(s, d, files))
    monkeypatch.setattr(type(spark.range(1)), "first", lambda df: freed.append(spark.conf.get(FREED, None)) or first(df))
    before = spark.conf.get(FREED, None)
    plan_queries.dataset_m3_preprocessed(spark, SF)
    assert asked == [datasets.STATISTICS_FILES, tuple(plan_queries.FILES)]  # the whole table is made for the rows alone
    assert freed == ["true"] and spark.conf.get(FREED, None) == before
    assert datasets.statistics(wide(spark, SF, datasets.STATISTICS_FILES)) == datasets.statistics(wide(spark, SF))


def test_wide_rows_are_not_dealt_by_province(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = plan_queries.wide(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "hashpartitioning(cig" in plan and "hashpartitioning(codice_provincia" not in plan


def test_setting_comes_back(spark):
    before = spark.conf.get(FREED, None)
    try:
        spark.conf.set(FREED, "false")
        with freed_shuffles(spark):
            assert spark.conf.get(FREED) == "true"
        assert spark.conf.get(FREED) == "false"
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
