"""Drifting CSV folders through to the normalised tables."""

import pytest
from pyspark.sql import functions as F

from panelwise.operators import assemble, normalise
from panelwise.sources import raw, store

FILES = {
    "2018-19": {
        "profile_1": "Psuedocode,District,Block Name,Block\nA,  D1 ,x,B1\nB,D2,y,\n",
        "profile_2": "psuedocode,Managment,School Category,Rural/Urban,Block\nA,Govt,3.0,1,Q\nB,Pvt,zz,2,R\n",
        "facility": "psuedocode,Classrooms-In-Good-Condition,Classrooms Needs Major Repair,Classrooms Needs Minor Repair,"
        "Internet,Func Boys CWSN Friendly,Func Girls CWSN Friendly,Empty\nA,4,2,1,1,1,,\nB,,,,x,,2,\n",
        "teacher": "psuedocode,Total Teacher\nA,7\n",
        "enrolment_1": "psuedocode,Item Desc,C1_B,C1_G,Note\nA,General,10,5,n1\nA,Other,1,,n2\n,General,100,100,n3\n",
        "enrolment_2": "psuedocode,Item Desc,Age 5_B,Age 5_G\nA,General,10,6\n",
    },
    "2019-20": {
        "profile_1": "pseudocode,District,Block Name,Block\nA,D9,x,B9\nC,D3,z,B3\n",
        "profile_2": "pseudocode,Managment,School Category,Rural/Urban,Block\nA,Govt,4,1,Q\n",
        "facility": "pseudocode,Classrooms-In-Good-Condition,Internet,Empty,New Column\nA,5,2,,7\nC,1,1,,8\n",
        "teacher": "pseudocode,Total Tch\nA,9\nC,2\n",
        "enrolment_1": "pseudocode,Item Group,Item Id,C1_B,C1_G,C2_B\nA,1,1,20,10,5\nC,1,1,1,1,1\n",
        "enrolment_2": "pseudocode,Item Group,Item Id,Age 5_B,Age 5_G\nA,1,1,25,10\n",
    },
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    for year, files in FILES.items():
        (base / year).mkdir()
        for kind, text in files.items():
            (base / year / f"{kind}.csv").write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def files(spark, root):
    assert raw.list_years(spark, root) == ["2018-19", "2019-20"]
    return raw.read_all_years(spark, root)


@pytest.fixture(scope="module")
def master(files):
    return assemble.longitudinal(files)


def test_names_are_cleaned():
    assert assemble.clean_name("  Rural/Urban Code-X ") == "rural_urban_code_x"


def test_master_rows_and_columns(master):
    rows = {(r.year, r.school_id): r for r in master.collect()}
    assert set(rows) == {("2018-19", "A"), ("2018-19", "B"), ("2019-20", "A"), ("2019-20", "C")}
    a = rows[("2018-19", "A")]
    assert (a.total_boys, a.total_girls, a.total_enrolment) == (11.0, 5.0, 16.0)
    assert (a.total_boys_age, a.total_enrolment_age) == (10.0, 16.0)
    assert (a.block_x, a.block_y) == ("B1", "Q")
    assert rows[("2018-19", "B")].total_enrolment is None
    assert rows[("2019-20", "A")].total_enrolment == 35.0
    assert "empty" not in master.columns and "item_desc" not in master.columns and "note" not in master.columns
    assert a.new_column is None and rows[("2019-20", "C")].new_column == "8"


def test_one_year_alone(spark, root):
    one = {k: df for k, df in raw.read_year(spark, root, "2019-20").items()}
    got = assemble.assemble_master(one, ["school_id"])
    assert {r.school_id: r.total_enrolment for r in got.collect()} == {"A": 35.0, "C": 3.0}


def test_null_audit_reports_names(files):
    _, dropped = assemble.drop_null_columns(files["facility"])
    assert dropped == ["empty"]


def test_audit(files, master):
    rows = {r.year: r for r in assemble.quality_audit(master, ["c1_b", "c1_g", "c2_b"]).collect()}
    assert rows["2019-20"].split_matches == 2 and rows["2019-20"].duplicate_keys == 0
    assert rows["2018-19"].age_total_matches == 1
    twice = assemble.quality_audit(master.union(master), ["c1_b", "c1_g", "c2_b"]).collect()
    assert {r.duplicate_keys for r in twice} == {2}


def test_normalised_tables(master):
    tables = normalise.split_panel(master.withColumnRenamed("block_x", "block"))
    schools = {r.school_id: r for r in tables["schools"].collect()}
    assert schools["A"].district == "D9" and schools["A"].school_category == 4
    assert schools["B"].school_category is None and schools["B"].district == "D2" and schools["B"].school_name is None
    teachers = {(r.school_id, r.academic_year): r.total_teachers for r in tables["teacher_metrics"].collect()}
    assert teachers == {("A", "2018-19"): 7, ("B", "2018-19"): None, ("A", "2019-20"): 9, ("C", "2019-20"): 2}
    infra = {(r.school_id, r.academic_year): r for r in tables["infrastructure_details"].collect()}
    a, b = infra[("A", "2018-19")], infra[("B", "2018-19")]
    assert (a.classroom_condition_score, a.internet_available, a.cwsn_toilet_available) == (5, True, True)
    assert (b.classroom_condition_score, b.internet_available, b.cwsn_toilet_available) == (None, None, False)
    assert infra[("C", "2019-20")].cwsn_toilet_available is None and infra[("A", "2019-20")].internet_available is False
    summary = normalise.load_summary(master).first()
    assert tuple(summary) == (3, 4, "2018-19,2019-20")
    facts = normalise.join_facts(tables)
    assert facts.count() == 4 and facts.where("has_school AND has_teachers").count() == 4


def test_join_facts_marks_missing_rows(spark, master):
    tables = normalise.split_panel(master.withColumnRenamed("block_x", "block"))
    tables["teacher_metrics"] = tables["teacher_metrics"].where("school_id <> 'A'")
    tables["schools"] = tables["schools"].where("school_id <> 'C'")
    got = {(r.school_id, r.academic_year): (r.has_school, r.has_teachers) for r in normalise.join_facts(tables).collect()}
    assert got[("A", "2018-19")] == (True, False) and got[("C", "2019-20")] == (False, True)


def test_rows_without_key_are_set_aside(spark):
    df = spark.createDataFrame([("a", "2020-21"), (None, "2020-21")], "school_id string, year string")
    keyed, rest = normalise.split_unkeyed(df)
    assert keyed.count() == 1 and rest.count() == 1


def test_masters_skip_the_longitudinal_output(spark, tmp_path):
    (tmp_path / "master_2018-19.csv").write_text("school_id,a\nA,1\n")
    (tmp_path / "master_2019-20.csv").write_text("school_id,b\nA,2\n")
    (tmp_path / "master_longitudinal.csv").write_text("school_id,a,b,year\nA,1,,2018-19\n")
    got = raw.read_masters(spark, str(tmp_path)).orderBy("year").collect()
    assert [(r.year, r.a, r.b) for r in got] == [("2018-19", "1", None), ("2019-20", None, "2")]


def test_republishing_a_year_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "2018-19", 1), ("a", "2019-20", 2)], "school_id string, academic_year string, v int")
    store.publish(df, path, ["academic_year"])
    new = df.withColumn("v", F.col("v") * 10)
    again = store.publish(new, path, ["academic_year"], year="2019-20")
    assert {(r.academic_year, r.v) for r in again.collect()} == {("2018-19", 1), ("2019-20", 20)}


def test_append_stamps_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1,)], "id int")
    store.append(df, path, "validated_at")
    store.append(df, path, "validated_at")
    rows = store.read_table(spark, path).collect()
    assert len(rows) == 2 and all(r.validated_at is not None for r in rows)


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Fake:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        store.shared_folder(Fake())


DRIFT = {
    "2018-19": {
        "profile_1": "psuedocode,District,Block\nA,NA,B1\nB,D2,B2\n",
        "profile_2": "psuedocode,Managment,Block\nA,Govt,Q\nB,Pvt,R\n",
        "facility": "psuedocode,Internet\nA,1\nB,N/A\n",
        "teacher": "psuedocode,Total Teacher\nA,7\nB,null\n",
        "enrolment_1": "psuedocode,C1_B,C1_G\nA,x,5\nA,1,NA\nB,2,3\n",
        "enrolment_2": "psuedocode,Age 5_B,Age 5_G\nA,10,6\nB,,\n",
    },
    "2019-20": {
        "profile_1": "pseudocode,District,Block\nA,D1,B9\nB,D2,B2\n",
        "profile_2": "pseudocode,Managment\nA,Govt\nB,Pvt\n",
        "facility": "pseudocode,Internet\nA,1\nB,2\n",
        "teacher": "pseudocode,Total Teacher\nA,7\nB,1\n",
        "enrolment_1": "pseudocode,C1_B,C1_G,C2_B\nA,20,10,5\nB,1,1,\n",
        "enrolment_2": "pseudocode,Age 5_B,Age 5_G\nA,25,10\nB,1,1d\n",
    },
}


def test_years_are_judged_one_by_one(spark, tmp_path):
    for year, files in DRIFT.items():
        (tmp_path / year).mkdir()
        for kind, text in files.items():
            (tmp_path / year / f"{kind}.csv").write_text(text)
    got = assemble.longitudinal(raw.read_all_years(spark, str(tmp_path)))
    rows = {(r.year, r.school_id): r for r in got.collect()}
    a, b, c, d = (rows[k] for k in (("2018-19", "A"), ("2018-19", "B"), ("2019-20", "A"), ("2019-20", "B")))
    # missing cells, also in numbers
    assert (a.district, b.internet, b.total_teacher, a.c1_g) == (None, None, None, 5.0)
    # a text cell drops the column in its own year only
    assert (a.c1_b, b.c1_b, a.total_boys, c.c1_b, c.total_boys) == (None, None, 0.0, 20.0, 25.0)
    assert (c.age_5_g, d.age_5_g, a.age_5_g, b.age_5_b) == (None, None, 6.0, 0.0)
    # a column the year's header lacks is missing, an empty one sums to 0
    assert (a.c2_b, d.c2_b) == (None, 0.0)
    # names clash in the year that has both, and only there
    assert (a.block_x, a.block_y, a.block) == ("B1", "Q", None) and (c.block_x, c.block_y, c.block) == (None, None, "B9")


def test_one_year_panel_splits_into_nothing(spark):
    from panelwise.operators import learned

    rows = [("a", "2020-21", 50, 0.1, "2021-22")]
    df = spark.createDataFrame(rows, "school_id string, academic_year string, total_enrolment int, target_growth double, target_year string")
    assert [part.count() for part in learned.split(df)] == [0, 0]
