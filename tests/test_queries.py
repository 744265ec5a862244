"""Every registered query runs; those with SQL give the SQL's rows."""

import pytest
from compare import connect, rows

from palimpsest import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


PLACED = ("interval_merge", "asof_units", "apportion_widths", "list_islands", "inline_runs", "body_containers", "table_extents", "region_report", "style_references", "numeric_distribution", "greedy_text_budget")


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_partition_count_does_not_matter(spark, duck, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for name in PLACED:
            assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_parsing_and_rendering_shuffle_nothing(spark):
    """But for dealing out the rows of a file of one row group."""
    from palimpsest.plans import corpus_queries as c
    from palimpsest.plans import engine as e

    docs = c.corpus(spark, SF).repartition(4)
    for df in (e.inspect(docs), e.relation(docs, "runs"), e.renderer("html")(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(e.queries())
