import pytest
from pyspark.sql import functions as F

from panelwise.operators import panel

ROWS = (
    [("a", f"20{10 + i}-{11 + i}", 100 + 10 * i, 1) for i in range(7)]
    + [("b", f"20{10 + i}-{11 + i}", v, 2) for i, v in enumerate([50, 0, 40, 60])]
    + [("c", "2016-17", 10, 2)]
)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "school_id string, academic_year string, total_enrolment int, area int").cache()


def test_survival_and_labels(df):
    assert [tuple(r) for r in panel.survival_distribution(df).collect()] == [(1, 1), (4, 1), (7, 1)]
    labels = {r.school_id: r.stability for r in panel.stability_labels(df).collect()}
    assert labels == {"a": "stable", "b": "mid", "c": "unstable"}
    window = {r.school_id: r.stability for r in panel.with_stability(df, 7).collect()}
    assert window == labels


def test_growth_drops_first_rows_and_rows_after_zero(df):
    rows = panel.growth_panel(panel.with_stability(df)).where("school_id = 'b'").orderBy("academic_year").collect()
    assert [r.enrolment_growth_pct for r in rows] == [-100.0, 50.0]
    kept = panel.growth_panel(panel.with_stability(df), keep_infinite=True).where("school_id = 'b'")
    assert float("inf") in [r.enrolment_growth_pct for r in kept.collect()]


def test_latest_year_views(df):
    labelled = panel.with_stability(df)
    means = {r.stability: r.avg_enrolment for r in panel.enrolment_by_stability(labelled).collect()}
    assert means == {"stable": 160.0, "unstable": 10.0}
    cross = {r.stability: (r["1"], r["2"]) for r in panel.stability_crosstab(labelled, "area").collect()}
    assert cross == {"stable": (1, 0), "unstable": (0, 1)}


def test_median_forms_agree(df):
    growth = panel.growth_panel(panel.with_stability(df))
    exact = {r.stability: r.median_growth_pct for r in panel.median_growth_by_stability(growth).collect()}
    plain = {r.stability: r.m for r in growth.groupBy("stability").agg(F.median("enrolment_growth_pct").alias("m")).collect()}
    assert exact == pytest.approx(plain)
    rough = panel.median_growth_by_stability(growth, exact=False).collect()
    assert {r.stability for r in rough} == set(exact)
