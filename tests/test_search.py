"""Search through trigrams against a scan of all schools."""

import random

import pytest
from pyspark.sql import functions as F

from panelwise.operators import search
from panelwise.plans import views
from panelwise.sources import store

COLUMNS = "school_id string, school_name string, district string, block string, school_category int"


@pytest.fixture(scope="module")
def data():
    r = random.Random(3)
    words = ["Primary", "PRIMARY", "School", "High", "Éçole", "ß", "100%", "a_b", "ÎLE", "xx", "aaa", "abab"]
    rows = [(f"S{i:05d}", " ".join(r.choice(words) for _ in range(r.randint(0, 4))), "d", "b", 1) for i in range(9_000)]
    return rows + [("S9", None, "d", "b", 1), ("", "", None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, data, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("search"))
    schools = store.publish(spark.createDataFrame(data, COLUMNS), f"{root}/schools", cluster_by=["school_id"])
    return schools, store.publish(search.postings(schools), f"{root}/index", cluster_by=search.ORDER)


@pytest.mark.parametrize("text", ["S00012", "s0001", "school high", "éÇo", "île", "100%", "a_b", "aaaa", "ababab", "no such", "S9", "x", "", "ary s", "ß"])
def test_equal_to_the_scan(tables, text):
    schools, index = tables
    for limit in (20, 10**6):
        want = views.search_schools(schools, text, limit).collect()
        assert views.search_schools(schools, text, limit, index).collect() == want


def test_common_trigrams_are_split_into_blocks(tables):
    _, index = tables
    sizes = index.where("gram = 's00'").agg(F.max(F.size("school_ids")), F.count(F.lit(1)), F.sum(F.size("school_ids"))).first()
    assert sizes[0] < 500 and sizes[1] == 3 and sizes[2] == 1_000


def test_only_schools_with_all_trigrams_are_candidates(spark, tables):
    schools, index = tables
    wanted = search.text_grams(spark, "S00012")
    assert sorted(wanted) == ["000", "001", "012", "s00"]
    found = search.candidates(index, wanted)
    assert found.count() < 100
    plan = index.where(F.col("gram").isin(wanted))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
