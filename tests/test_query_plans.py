"""Plans: what must reach the scan, what must happen before a shuffle."""

import pytest

import __spark_entry__ as entry
from panelwise.plans import catalog, views

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_and_columns_reach_the_scan(spark, sf):
    text = plan(views.state_budget(catalog.report_of(spark, sf)))
    assert "PartitionFilters: [isnotnull(academic_year" in text and "Subquery" in text
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert "classroom_resolved" in schema and "risk_score" not in schema and "school_name" not in schema


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(views.priority_schools(catalog.report_of(spark, sf)))
    assert "TakeOrderedAndProject" in plan(QUERIES["top_risk_districts"](spark, sf))


def test_school_windows_share_one_exchange(spark, sf):
    from panelwise.operators import ranking, trend
    from panelwise.plans.report import scored

    flagged = scored(catalog.facts_of(spark, sf)).transform(ranking.with_persistent_flag).transform(trend.with_trend)
    text = plan(flagged)
    assert text.count("Exchange hashpartitioning(school_id") == 1 and text.count("Window [") >= 3
    assert text.count("Exchange") == 1


def test_flagship_reads_each_raw_table_once(spark, sf):
    text = plan(catalog.compliance_card(spark, sf))
    for name in ("lineitem", "customer", "nation", "region"):
        assert text.count(f"{name}.parquet") == 1, name


def test_ranks_meet_their_rows_by_cell_and_bucket(spark, sf):
    """No exchange of rows on (year, district, score) alone, which one score may fill."""
    from panelwise.operators.ranking import with_ranks

    df = with_ranks(catalog.scored_of(spark, sf))
    assert dict(df.dtypes)["state_rank"] == dict(df.dtypes)["district_rank"] == "bigint"
    joins = [line for line in plan(df).splitlines() if "Join" in line and "school_id" not in line]
    assert any("_bucket" in line for line in joins)


def test_histories_of_all_schools_are_not_sorted(spark, sf):
    report = catalog.report_of(spark, sf)
    assert "Sort" not in plan(views.school_history(report)) and "Sort" in plan(views.school_history(report, "1"))


def test_schools_of_a_checked_key_are_counted_before_the_shuffle(spark, sf):
    """One exchange below the final step, and no row by school in it."""
    from panelwise.operators import district, forecast

    assert catalog.keyed_of(spark, sf)
    scored, report = catalog.scored_of(spark, sf), catalog.report_of(spark, sf)
    rows = forecast.wma_forecast(catalog.facts_of(spark, sf))
    for make in (
        lambda keyed: district.district_rollup(scored, keyed),
        lambda keyed: views.state_kpis(report, keyed=keyed),
        lambda keyed: views.enrolment_by_year(report, keyed=keyed),
        lambda keyed: views.block_kpis(report, keyed=keyed),
    ):
        text = plan(make(True)).split("Subquery")[0]
        assert not any("school_id" in line for line in text.splitlines() if "Exchange" in line)
        assert sorted(map(tuple, make(True).collect())) == sorted(map(tuple, make(False).collect()))
    assert forecast.forecast_summary(rows, keyed=True).collect() == forecast.forecast_summary(rows).collect()


def test_keys_that_repeat_are_no_keys(spark):
    from panelwise.sources import store

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "school_id string, academic_year int")
    assert store.is_key(df, ["school_id", "academic_year"]) and not store.is_key(df, ["school_id"])
    assert not store.is_key(df.union(df.limit(1)), ["school_id", "academic_year"])


def test_percentiles_shuffle_cells_and_not_all_values(spark):
    from pyspark.sql import functions as F

    from panelwise.operators.ordered import exact_percentiles

    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e9).alias("x"))
    df = df.unionByName(spark.range(300_000).select((F.col("id") % 2).alias("g"), F.lit(0.25).alias("x")))
    out = exact_percentiles(df, ["g"], "x", {"p": 0.1, "m": 0.5, "q": 0.9})
    rows = {r.g: (r.p, r.m, r.q) for r in out.collect()}
    want = df.groupBy("g").agg(*[F.percentile("x", p) for p in (0.1, 0.5, 0.9)]).collect()
    assert all(tuple(r)[1:] == pytest.approx(rows[r[0]], abs=1e-12) for r in want) and len(rows) == 2
    moved = 0
    nodes = [out._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() in ("AdaptiveSparkPlan",):
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        elif node.nodeName() == "Exchange":
            moved += node.metrics().apply("shuffleRecordsWritten").value()
    assert 0 < moved < 60_000
