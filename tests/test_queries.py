"""Every registered query against its SQL, and the identities between results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwise.plans import catalog, views
from tests.compare import compare, oracle

QUERIES, SQL = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


NEVER = ("ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def check_plan(df) -> None:
    text = df._jdf.queryExecution().executedPlan().toString()
    assert [bad for bad in NEVER if bad in text] == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    check_plan(df)
    assert compare(con, df, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    check_plan(df)
    assert df.columns and df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "compliance_grade" in df.columns


@pytest.fixture(scope="module")
def report(spark, sf):
    return catalog.report_of(spark, sf)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_identities(spark, sf, report):
    run = {n: QUERIES[n](spark, sf) for n in ("schools_per_year", "survival_distribution", "bucket_summary", "trend_summary")}
    rows = report.count()
    assert total(run["schools_per_year"], "schools") == rows
    assert total(run["survival_distribution"], F.col("years_active") * F.col("schools")) == rows
    b = run["bucket_summary"].first()
    assert b.top5 + b.top10 + b.top20 + b.standard == b.total_records == rows
    t = run["trend_summary"].first()
    assert t.baseline + t.improving + t.stable + t.deteriorating == rows
    assert t.baseline == total(run["survival_distribution"], "schools")
    assert b.persistent_count == t.chronic
    a, d = QUERIES["allocation_summary"](spark, sf).first(), QUERIES["index_summary"](spark, sf).first()
    assert a.total_classrooms_alloc + a.remaining_classroom_deficit == d.grand_classroom_deficit
    assert a.total_teachers_alloc + a.remaining_teacher_deficit == d.grand_teacher_deficit
    v = QUERIES["validation_summary"](spark, sf).first()
    assert v.accepted + v.flagged + v.rejected == v.total == rows
    assert v.within_tol + v.no_request == v.accepted
    f = QUERIES["wma_forecast_summary"](spark, sf).first()
    assert f.total_records == 3 * f.unique_schools


def test_filters_pick_one_place(spark, sf, report):
    place = report.select("district", "block").first()
    whole = views.block_schools(report).where((F.col("district") == place.district) & (F.col("block") == place.block))
    one = views.block_schools(report, place.district, place.block)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, whole.collect()))
    year = report.agg(F.min("academic_year")).first()[0]
    assert views.state_kpis(report, year).first().total_schools == report.where(F.col("academic_year") == year).count()
    limited = views.block_schools(report, limit=1)
    assert limited.groupBy("district", "block").count().where("count > 1").count() == 0
    some = report.first().school_id
    assert {r.school_id for r in views.school_history(report, some).collect()} == {some}


def test_search_takes_text_literally(spark):
    df = spark.createDataFrame(
        [("1", "a%b", "d", "k", 1), ("2", "axb", "d", "k", 1), ("A%3", None, "d", "k", 1)],
        "school_id string, school_name string, district string, block string, school_category int",
    )
    assert [r.school_id for r in views.search_schools(df, "A%").collect()] == ["1", "A%3"]


def test_report_keeps_incomplete_rows(spark):
    from panelwise.plans.report import report as build

    rows = [
        ("a", "2020-21", 90, 1, 1, "D", "B", 1, True, True),
        ("b", "2020-21", 90, 1, None, "D", "B", 1, True, False),
        ("c", "2020-21", 90, 1, 1, None, None, None, False, True),
    ]
    df = spark.createDataFrame(
        rows,
        "school_id string, academic_year string, total_enrolment int, usable_class_rooms int, total_teachers int, "
        "district string, block string, school_category int, has_school boolean, has_teachers boolean",
    )
    got = {r.school_id: r for r in build(df).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["b"].allocation_priority is None and got["b"].state_rank is not None
    assert got["c"].state_rank is None and got["c"].allocation_priority is not None
