"""Years added one by one against the windows over whole histories."""

import random

import pytest
from pyspark.sql import functions as F

from panelwise.functions.windows import in_year
from panelwise.operators import carried, forecast, trend
from panelwise.plans import catalog, pipeline
from panelwise.plans.report import scored

YEARS = ["2017-18", "2018-19", "2019-20", "2020-21", "2021-22", "2022-23", "2023-24"]
COLUMNS = ["school_id", "academic_year", "enrolment_growth_rate", "risk_level", *carried.TREND, "avg_growth_rate"]


@pytest.fixture(scope="module")
def facts(spark):
    r = random.Random(8)
    rows = []
    for i in range(120):
        size = r.choice([0, 40, 300])
        for year in YEARS:
            size = max(0, size + r.randint(-60, 90))
            if r.random() < 0.8:
                enrol = None if r.random() < 0.1 else size * (r.random() > 0.05)
                rows.append((f"s{i}", year, int(enrol) if enrol is not None else None, r.randint(0, 9), r.randint(0, 12), i % 11 + 1, r.random() < 0.9, r.random() < 0.8))
    return spark.createDataFrame(
        rows,
        "school_id string, academic_year string, total_enrolment int, usable_class_rooms int, total_teachers int, "
        "school_category int, has_school boolean, has_teachers boolean",
    ).cache()


def full(facts):
    return scored(facts).transform(trend.with_trend).transform(forecast.with_wma_growth)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_seven_single_years_equal_the_full_run(spark, facts, tmp_path):
    house = pipeline.Warehouse(spark, str(tmp_path))
    want = full(facts)
    state, got = carried.empty_state(spark), []
    for year in YEARS:
        house.root = str(tmp_path / year)
        added, state = pipeline.add_year(house, facts.where(F.col("academic_year") == year), state)
        got += rows(added)
    assert sorted(got, key=repr) == rows(want)
    late = carried.state_of(scored(facts))
    assert sorted(map(tuple, state.collect()), key=repr) == sorted(map(tuple, late.select(state.columns).collect()), key=repr)


def test_a_state_from_history_goes_on(spark, facts, tmp_path):
    house = pipeline.Warehouse(spark, str(tmp_path))
    state = pipeline.keep_state(house, scored(facts.where(F.col("academic_year") < "2021-22")))
    added, _ = pipeline.add_year(house, facts.where(F.col("academic_year") == "2021-22"), state)
    assert rows(added) == rows(full(facts.where(F.col("academic_year") <= "2021-22")).where("academic_year = '2021-22'"))


def test_years_out_of_order_end_the_job(spark, facts):
    state = carried.state_of(scored(facts))
    with pytest.raises(Exception, match="years must be added in order"):
        carried.merge(state, facts.where(F.col("academic_year") == "2020-21")).collect()


def test_plan_reads_one_year_and_the_state(spark, sf):
    merged = carried.merge(carried.empty_state(spark), in_year(catalog.facts_of(spark, sf)))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(academic_year" in plan and "Window" not in plan
