"""Facts and raw CSV folders to published tables."""

from pyspark.sql import functions as F

from panelwise.operators import assemble, normalise
from panelwise.operators.allocation import Scenario
from panelwise.operators.learned import BoostingSettings
from panelwise.plans import pipeline, standin
from panelwise.plans.report import scored


def test_facts_to_report(spark, sf, tmp_path):
    house = pipeline.Warehouse(spark, str(tmp_path))
    facts = standin.facts(spark, sf)
    tables = pipeline.derive(house, facts)
    assert house.get("report").count() == facts.count() == tables["scored"].count()
    assert tables["wma_forecast"].groupBy("years_ahead").count().count() == 3
    assert house.get("validation").where("decision_status IS NULL").count() == 0
    out = pipeline.learn(house, tables["scored"], BoostingSettings(rounds=3, min_leaf=5))
    assert out["learned_forecast"].count() == tables["wma_forecast"].count()
    assert {r.method for r in out["evaluation"].collect()} == {"learned", "wma"}
    summary, districts = pipeline.simulate(house.get("report"), [Scenario()])
    assert summary.first().total_schools > 0 and districts.count() <= 15
    year = facts.agg(F.max("academic_year")).first()[0]
    again = pipeline.rescore_year(house, facts, year)
    cols = sorted(again.columns)
    assert sorted(map(repr, again.select(cols).collect())) == sorted(map(repr, scored(facts).select(cols).collect()))


def test_raw_folders_load(spark, tmp_path):
    from tests.test_assemble import FILES

    src = tmp_path / "raw"
    for year, files in FILES.items():
        (src / year).mkdir(parents=True)
        for kind, text in files.items():
            (src / year / f"{kind}.csv").write_text(text.replace("Block Name,Block", "Block Name,Ward"))
    house = pipeline.Warehouse(spark, str(tmp_path / "house"))
    facts = pipeline.load_raw(house, str(src))
    # figures taken while writing: the same as by reading, without a job of their own
    spark.sparkContext.setJobGroup("figures", "summary")
    summary = pipeline.load_summary(house)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("figures") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert summary.collect() == normalise.load_summary(house.get("longitudinal")).collect()
    assert house.get("longitudinal").columns == assemble.drop_null_columns(house.get("assembled"))[0].columns
    got = {(r.school_id, r.academic_year): (r.total_enrolment, r.total_teachers) for r in facts.collect()}
    assert got == {
        ("A", "2018-19"): (16, 7),
        ("B", "2018-19"): (None, None),
        ("A", "2019-20"): (35, 9),
        ("C", "2019-20"): (3, 2),
    }
