"""Registered queries, each next to the SQL that states its result.

Every query runs over whole tables. A query without SQL rests on a trained
model, on a hash the SQL engine lacks, or on write times; those are checked in
the tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.exprs import round_half_away
from panelwise.functions.norms import norm
from panelwise.functions.windows import in_year
from panelwise.operators import (
    allocation,
    assemble,
    carried,
    district,
    forecast,
    gaps,
    learned,
    normalise,
    panel,
    proposals,
    ranking,
    risk,
    search,
    trend,
)
from panelwise.operators.allocation import Scenario
from panelwise.plans import oracle as sql
from panelwise.plans import standin, views
from panelwise.plans.oracle import lvl, mean4, n_if, rnd, total
from panelwise.plans.report import report, scored
from panelwise.sources import raw, store
from panelwise.streaming import submissions as stream

STREAM_SECONDS = 3_600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SCENARIOS = [
    Scenario("base"),
    Scenario("half_budget", 25.0, 5.0, 500),
    Scenario("dear_rooms", 50.0, 12.5, 2_000),
    Scenario("large", 400.0, 4.0, 100_000),
]


def query(name: str, statement: str | None = None, *needs: str):
    """Register a query under a name, with its SQL if there is one."""

    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if statement is not None:
            ORACLE[name] = sql.with_defs(statement, *needs)
        return build

    return keep


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_half_away(c, digits) for c in columns})


# --- shared inputs ------------------------------------------------------------------


def facts_of(spark: SparkSession, sf: str) -> DataFrame:
    return standin.facts(spark, sf)


def keyed_of(spark: SparkSession, sf: str) -> bool:
    """Whether school and year are a key of the facts, and so of all that has a row for each of theirs."""
    return standin.keyed(spark, sf)


def by_year(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table published once by academic year and read from there."""
    return standin.published(spark, sf, name, build, ["academic_year"], as_dealt=True)


def scored_of(spark: SparkSession, sf: str) -> DataFrame:
    """The published risk table, which every later step starts from."""
    return by_year(spark, sf, "scored", lambda: scored(facts_of(spark, sf)))


def report_of(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        return report(facts_of(spark, sf), lambda name, df: by_year(spark, sf, name, lambda: df))

    # views of single schools find their rows by the files' ranges
    return standin.published(spark, sf, "report", build, ["academic_year"], ["school_id"])


def judged_of(spark: SparkSession, sf: str) -> DataFrame:
    """Batch validation with the school attributes, as the district views read it."""

    def build():
        gapped = gaps.with_gaps(facts_of(spark, sf))
        return proposals.perturbed_requests(gapped, "md5").transform(proposals.judge_batch)

    return by_year(spark, sf, "validation", build)


def features_of(spark: SparkSession, sf: str) -> DataFrame:
    return standin.published(spark, sf, "features", lambda: learned.feature_panel(scored_of(spark, sf)))


def learned_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Tables made from one training run: forecast, evaluation, fit, importance, rounds."""

    def build():
        features = features_of(spark, sf)
        train, test = learned.split(features)
        model = learned.fit(train)
        tables = {
            "forecast": learned.learned_forecast(model, features, train),
            "evaluation": learned.evaluate(learned.predict(model, test)),
            "fit": learned.training_fit(model, train),
            "importance": learned.feature_importance(model, features),
            "rounds": learned.training_rounds(model, features),
        }
        for part, df in tables.items():
            if part != name:  # the caller publishes this one
                standin.published(spark, sf, f"learned_{part}", lambda df=df: df)
        return tables[name]

    return standin.published(spark, sf, f"learned_{name}", build)


def raw_csv_of(spark: SparkSession, sf: str) -> str:
    """The raw files as CSV folders, one per kind and year, written from the tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CSV_ROOTS:
        root = store.new_path(spark, "raw")
        for kind, df in standin.raw_files(spark, sf).items():
            df.write.option("header", True).partitionBy("year").csv(f"{root}/{kind}")
        _CSV_ROOTS[key] = root
    return _CSV_ROOTS[key]


_CSV_ROOTS: dict[tuple, str] = {}
CSV_LAYOUT = "{root}/{kind}/year={year}"


def prepared_raw(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {kind: assemble.prepare(df) for kind, df in standin.raw_files(spark, sf).items()}


def master_of(spark: SparkSession, sf: str) -> DataFrame:
    """The longitudinal panel, assembled from the raw files and published."""
    files = prepared_raw(spark, sf)
    return assemble.longitudinal(
        files, lambda df: standin.published(spark, sf, "assembled", lambda: df, ["year"])
    )


# --- loading and assembly -------------------------------------------------------------

FACT_COLUMNS = (
    "school_id, academic_year, total_enrolment, total_class_rooms, usable_class_rooms, total_teachers, "
    "classroom_condition_score, building_condition, school_name, district, block, management_type, "
    "school_category, rural_urban, drinking_water_available, internet_available"
)


@query("facts_load", f"SELECT {FACT_COLUMNS} FROM facts", "facts")
def _(spark, sf):
    return standin.build_facts(spark, sf)


CLASS_COLUMNS = [f"c{n}_{t}" for n in range(1, 8) for t in "bg"]
AGE_COLUMNS = [f"age_{n}_{t}" for n in range(1, 8) for t in "bg"]


@query("school_sums", f"SELECT year, school_id, {', '.join(CLASS_COLUMNS)} FROM enrolment", "enrolment")
def _(spark, sf):
    rows = prepared_raw(spark, sf)["enrolment_1"].transform(assemble.drop_grouping)
    return assemble.sum_by_school(rows, assemble.numeric_columns(rows, assemble.KEYS))


@query(
    "class_totals",
    "SELECT year, school_id, total_boys, total_girls, total_enrolment FROM enrolment",
    "enrolment",
)
def _(spark, sf):
    return assemble.enrolment_totals(prepared_raw(spark, sf)["enrolment_1"], "").select(
        "year", "school_id", "total_boys", "total_girls", "total_enrolment"
    )


@query(
    "age_totals",
    "SELECT year, school_id, total_boys_age, total_girls_age, total_enrolment_age FROM enrolment",
    "enrolment",
)
def _(spark, sf):
    return assemble.enrolment_totals(prepared_raw(spark, sf)["enrolment_2"], "_age").select(
        "year", "school_id", "total_boys_age", "total_girls_age", "total_enrolment_age"
    )


@query(
    "dropped_columns",
    """SELECT * FROM (VALUES ('facility', 'func_girls_cwsn_friendly'), ('profile_2', 'remarks')) AS t(file_kind, column_name)""",
)
def _(spark, sf):
    files = prepared_raw(spark, sf)
    rows = [(kind, c) for kind, df in files.items() for c in assemble.drop_null_columns(df)[1]]
    return spark.createDataFrame(rows, "file_kind string, column_name string")


MASTER_SQL = f"""SELECT p.academic_year AS year, p.school_id, s.district, s.block, s.management_type AS managment,
  s.school_category, s.rural_urban, s.rural_urban AS location_code, p.total_class_rooms,
  p.usable_class_rooms AS classrooms_in_good_condition, p.building_condition AS building_status,
  CASE WHEN p.academic_year < '1998' THEN p.total_teachers END AS total_teacher,
  CASE WHEN p.academic_year >= '1998' THEN p.total_teachers END AS total_tch,
  {', '.join('e.' + c for c in CLASS_COLUMNS + AGE_COLUMNS)},
  e.total_boys, e.total_girls, e.total_enrolment, e.total_boys_age, e.total_girls_age, e.total_enrolment_age
FROM panel p JOIN schools s USING (school_id) LEFT JOIN enrolment e ON e.school_id = p.school_id AND e.year = p.academic_year"""
MASTER_COLUMNS = [
    "year",
    "school_id",
    "district",
    "block",
    "managment",
    "school_category",
    "rural_urban",
    "location_code",
    "total_class_rooms",
    "classrooms_in_good_condition",
    "building_status",
    "total_teacher",
    "total_tch",
    *CLASS_COLUMNS,
    *AGE_COLUMNS,
    "total_boys",
    "total_girls",
    "total_enrolment",
    "total_boys_age",
    "total_girls_age",
    "total_enrolment_age",
]


@query("longitudinal_panel", MASTER_SQL, "panel", "schools", "enrolment")
def _(spark, sf):
    return master_of(spark, sf).select(*MASTER_COLUMNS)


@query(
    "longitudinal_from_csv",
    """SELECT p.academic_year AS year, p.school_id, s.district, CAST(s.school_category AS VARCHAR) AS school_category,
  CAST(p.usable_class_rooms AS VARCHAR) AS classrooms_in_good_condition, e.c1_b, e.age_7_g,
  e.total_enrolment, e.total_enrolment_age
FROM panel p JOIN schools s USING (school_id) LEFT JOIN enrolment e ON e.school_id = p.school_id AND e.year = p.academic_year""",
    "panel",
    "schools",
    "enrolment",
)
def _(spark, sf):
    root = raw_csv_of(spark, sf)
    years = raw.list_years(spark, f"{root}/profile_1")
    files = raw.read_all_years(spark, root, years, CSV_LAYOUT)

    def stage(df):
        return store.publish(df, store.new_path(spark, "assembled"), ["year"])

    return assemble.longitudinal(files, stage).select(
        "year",
        "school_id",
        "district",
        "school_category",
        "classrooms_in_good_condition",
        "c1_b",
        "age_7_g",
        "total_enrolment",
        "total_enrolment_age",
    )


@query(
    "quality_audit",
    f"""SELECT year, count(*) AS rows, CAST(0 AS BIGINT) AS missing_keys, CAST(0 AS BIGINT) AS duplicate_keys,
  count(*) AS class_sum_matches, count(*) AS split_matches, count(*) AS age_total_matches,
  {rnd("(" + total("""(CASE WHEN usable_class_rooms IS NULL THEN 1 ELSE 0 END)
    + (CASE WHEN total_teachers IS NULL THEN 2 ELSE 1 END)
    + (CASE WHEN internet_flag = 0 THEN 1 ELSE 0 END)""") + f" / (count(*) * 50)::DOUBLE)", 4)} AS null_cell_share
FROM (SELECT academic_year AS year, * FROM panel) GROUP BY year""",
    "panel",
)
def _(spark, sf):
    return assemble.quality_audit(master_of(spark, sf), CLASS_COLUMNS)


@query(
    "masters_republished",
    "SELECT year, count(*) AS schools, sum(total_enrolment) AS enrolment FROM enrolment GROUP BY year",
    "enrolment",
)
def _(spark, sf):
    """Yearly masters written by year, read back without the longitudinal output beside them."""
    master = master_of(spark, sf)
    again = store.republish(master, store.new_path(spark, "masters"), ["year"])
    return again.groupBy("year").agg(
        F.count(F.lit(1)).alias("schools"), F.sum("total_enrolment").alias("enrolment")
    )


# --- normalised tables -------------------------------------------------------------------


@query(
    "schools_table",
    """SELECT school_id, CAST(NULL AS VARCHAR) AS school_name, district, block, management_type, school_category,
  CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude
FROM schools WHERE school_id IN (SELECT school_id FROM panel)""",
    "schools",
    "panel",
)
def _(spark, sf):
    return normalise.schools_table(master_of(spark, sf))


@query(
    "yearly_table",
    "SELECT school_id, academic_year, total_enrolment, CAST(NULL AS DOUBLE) AS attendance_rate FROM panel",
    "panel",
)
def _(spark, sf):
    return normalise.yearly_table(master_of(spark, sf))


@query(
    "infra_table",
    """SELECT school_id, academic_year, total_class_rooms, usable_class_rooms, building_condition,
  drinking_water_flag = 1 AS drinking_water_available, CAST(NULL AS BOOLEAN) AS electricity_available,
  internet_flag = 1 AS internet_available, CAST(NULL AS BOOLEAN) AS separate_girls_toilet,
  CAST(NULL AS BOOLEAN) AS ramp_available, CAST(NULL AS BOOLEAN) AS resource_room_available,
  CAST(NULL AS INTEGER) AS last_major_repair_year, classroom_condition_score,
  CASE WHEN internet_flag <> 0 THEN internet_flag = 1 END AS cwsn_toilet_available,
  CAST(NULL AS INTEGER) AS required_class_rooms FROM panel""",
    "panel",
)
def _(spark, sf):
    return normalise.infra_table(master_of(spark, sf))


@query(
    "teacher_table",
    "SELECT school_id, academic_year, total_teachers, CAST(NULL AS INTEGER) AS required_teachers FROM panel",
    "panel",
)
def _(spark, sf):
    return normalise.teacher_table(master_of(spark, sf))


@query(
    "load_summary",
    """SELECT count(DISTINCT school_id) AS total_schools, count(*) AS school_year_rows,
  string_agg(DISTINCT academic_year, ',' ORDER BY academic_year) AS academic_years FROM panel""",
    "panel",
)
def _(spark, sf):
    return normalise.load_summary(master_of(spark, sf))


@query(
    "joined_facts",
    """SELECT school_id, academic_year, total_enrolment, usable_class_rooms, total_teachers, district, school_category,
  true AS has_teachers, true AS has_school FROM facts""",
    "facts",
)
def _(spark, sf):
    return normalise.join_facts(normalise.split_panel(master_of(spark, sf))).select(
        "school_id",
        "academic_year",
        "total_enrolment",
        "usable_class_rooms",
        "total_teachers",
        "district",
        "school_category",
        "has_teachers",
        "has_school",
    )


# --- panel analysis ---------------------------------------------------------------------


@query(
    "panel_size",
    """SELECT string_agg(DISTINCT academic_year, ',' ORDER BY academic_year) AS years,
  count(DISTINCT school_id) AS total_schools FROM facts""",
    "facts",
)
def _(spark, sf):
    return panel.panel_size(facts_of(spark, sf))


@query(
    "schools_per_year",
    "SELECT academic_year, count(DISTINCT school_id) AS schools FROM facts GROUP BY 1",
    "facts",
)
def _(spark, sf):
    return panel.schools_per_year(facts_of(spark, sf))


@query("years_active", "SELECT school_id, years_active FROM active", "active")
def _(spark, sf):
    return panel.years_active(facts_of(spark, sf))


@query("survival_distribution", "SELECT years_active, count(*) AS schools FROM active GROUP BY 1", "active")
def _(spark, sf):
    return panel.survival_distribution(facts_of(spark, sf))


@query("stability_labels", "SELECT school_id, years_active, stability FROM labels_by_school", "labels_by_school")
def _(spark, sf):
    return panel.stability_labels(facts_of(spark, sf))


@query(
    "stability_panel",
    "SELECT school_id, academic_year, total_enrolment, CAST(years_active AS INTEGER) AS years_active, stability FROM labelled",
    "labelled",
)
def _(spark, sf):
    return panel.with_stability(facts_of(spark, sf)).select(
        "school_id", "academic_year", "total_enrolment", "years_active", "stability"
    )


@query(
    "latest_year_slice",
    "SELECT school_id, academic_year, total_enrolment FROM facts WHERE academic_year = (SELECT max(academic_year) FROM facts)",
    "facts",
)
def _(spark, sf):
    return in_year(facts_of(spark, sf)).select("school_id", "academic_year", "total_enrolment")


@query(
    "enrolment_by_stability",
    f"""SELECT stability, {rnd('avg(total_enrolment)', 6)} AS avg_enrolment FROM labelled
WHERE academic_year = (SELECT max(academic_year) FROM facts) GROUP BY 1""",
    "labelled",
)
def _(spark, sf):
    labelled = panel.with_stability(facts_of(spark, sf))
    return rounded(panel.enrolment_by_stability(labelled), 6, "avg_enrolment")


@query(
    "stability_crosstab",
    f"""SELECT stability, {n_if('rural_urban = 1')} AS "1", {n_if('rural_urban = 2')} AS "2" FROM labelled
WHERE academic_year = (SELECT max(academic_year) FROM facts) GROUP BY 1""",
    "labelled",
)
def _(spark, sf):
    return panel.stability_crosstab(panel.with_stability(facts_of(spark, sf)), "rural_urban", [1, 2])


@query(
    "growth_panel",
    f"""SELECT school_id, academic_year, stability, prev_enrolment,
  {rnd('enrolment_growth_pct', 6)} AS enrolment_growth_pct FROM growth_pct""",
    "growth_pct",
)
def _(spark, sf):
    growth = panel.growth_panel(panel.with_stability(facts_of(spark, sf)))
    return rounded(growth, 6, "enrolment_growth_pct").select(
        "school_id", "academic_year", "stability", "prev_enrolment", "enrolment_growth_pct"
    )


@query(
    "mean_growth_by_stability",
    f"SELECT stability, {rnd('avg(enrolment_growth_pct)', 6)} AS avg_growth_pct FROM growth_pct GROUP BY 1",
    "growth_pct",
)
def _(spark, sf):
    growth = panel.growth_panel(panel.with_stability(facts_of(spark, sf)))
    return rounded(panel.mean_growth_by_stability(growth), 6, "avg_growth_pct")


@query(
    "median_growth_by_stability",
    f"SELECT stability, {rnd('median(enrolment_growth_pct)', 6)} AS median_growth_pct FROM growth_pct GROUP BY 1",
    "growth_pct",
)
def _(spark, sf):
    growth = panel.growth_panel(panel.with_stability(facts_of(spark, sf)))
    return rounded(panel.median_growth_by_stability(growth), 6, "median_growth_pct")


# --- gaps -----------------------------------------------------------------------------


@query(
    "norm_lookup",
    f"""SELECT school_id, school_category, {sql.ROOM_NORM} AS room_norm, {sql.TEACHER_NORM} AS teacher_norm,
  {sql.NEXT_ROOM_NORM} AS forecast_room_norm, {sql.NEXT_TEACHER_NORM} AS forecast_teacher_norm FROM schools""",
    "schools",
)
def _(spark, sf):
    return standin.schools(spark, sf).select(
        "school_id",
        "school_category",
        norm("school_category", "current", "rooms").alias("room_norm"),
        norm("school_category", "current", "teachers").alias("teacher_norm"),
        norm("school_category", "forecast", "rooms").alias("forecast_room_norm"),
        norm("school_category", "forecast", "teachers").alias("forecast_teacher_norm"),
    )


@query("room_gap", "SELECT school_id, academic_year, required_class_rooms, classroom_gap FROM gaps", "gaps")
def _(spark, sf):
    return gaps.with_room_gap(facts_of(spark, sf)).select(
        "school_id", "academic_year", "required_class_rooms", "classroom_gap"
    )


@query("teacher_gap", "SELECT school_id, academic_year, required_teachers, teacher_gap FROM gaps", "gaps")
def _(spark, sf):
    return gaps.with_teacher_gap(facts_of(spark, sf)).select(
        "school_id", "academic_year", "required_teachers", "teacher_gap"
    )


def _gap_summary_sql(gap: str) -> str:
    positive = f"CASE WHEN {gap} > 0 THEN {gap} END"
    return (
        f"SELECT count(*) AS total_records, count({positive}) AS deficit_count, "
        f"{rnd(f'sum({positive})::DOUBLE / count({positive})', 2)} AS avg_gap FROM gaps"
    )


def _gap_top_sql(gap: str) -> str:
    return (
        f"SELECT trim(district) AS district, {total(gap)} AS cumulative_gap, count(*) AS school_years FROM gaps "
        f"WHERE {gap} > 0 AND trim(district) <> '' GROUP BY 1 ORDER BY cumulative_gap DESC, district LIMIT 10"
    )


@query("room_gap_summary", _gap_summary_sql("classroom_gap"), "gaps")
def _(spark, sf):
    return gaps.gap_summary(gaps.with_room_gap(facts_of(spark, sf)), "classroom_gap")


@query("teacher_gap_summary", _gap_summary_sql("teacher_gap"), "gaps")
def _(spark, sf):
    return gaps.gap_summary(gaps.with_teacher_gap(facts_of(spark, sf)), "teacher_gap")


@query("top_room_gap_districts", _gap_top_sql("classroom_gap"), "gaps")
def _(spark, sf):
    return gaps.top_gap_districts(gaps.with_room_gap(facts_of(spark, sf)), "classroom_gap")


@query("top_teacher_gap_districts", _gap_top_sql("teacher_gap"), "gaps")
def _(spark, sf):
    return gaps.top_gap_districts(gaps.with_teacher_gap(facts_of(spark, sf)), "teacher_gap")


# --- risk -----------------------------------------------------------------------------


@query(
    "deficit_ratios",
    "SELECT school_id, academic_year, classroom_deficit_ratio, teacher_deficit_ratio FROM ratios",
    "ratios",
)
def _(spark, sf):
    return risk.with_deficit_ratios(gaps.with_gaps(facts_of(spark, sf))).select(
        "school_id", "academic_year", "classroom_deficit_ratio", "teacher_deficit_ratio"
    )


@query("growth_rate", "SELECT school_id, academic_year, enrolment_growth_rate FROM growth", "growth")
def _(spark, sf):
    return risk.with_growth(facts_of(spark, sf)).select("school_id", "academic_year", "enrolment_growth_rate")


@query("risk_score", "SELECT school_id, academic_year, risk_score, risk_level FROM risk", "risk")
def _(spark, sf):
    return scored(facts_of(spark, sf)).select("school_id", "academic_year", "risk_score", "risk_level")


@query(
    "risk_summary",
    f"SELECT count(*) AS total_records, {rnd(mean4(), 4)} AS avg_risk, {lvl('_count')} FROM risk",
    "risk",
)
def _(spark, sf):
    return risk.risk_summary(scored_of(spark, sf))


@query(
    "top_risk_districts",
    f"""SELECT district, {rnd(mean4(), 4)} AS avg_risk, {n_if("risk_level = 'CRITICAL'")} AS critical,
  count(*) AS school_years FROM risk GROUP BY district ORDER BY avg_risk DESC, district LIMIT 10""",
    "risk",
)
def _(spark, sf):
    return risk.top_risk_districts(scored_of(spark, sf))


# --- ranking --------------------------------------------------------------------------


@query(
    "priority_index",
    """SELECT school_id, academic_year, risk_score, state_rank, district_rank, persistent_high_risk_flag,
  priority_bucket FROM priority""",
    "priority",
)
def _(spark, sf):
    return ranking.priority_index(scored_of(spark, sf))


@query(
    "persistent_flag",
    "SELECT school_id, academic_year, risk_level, persistent_high_risk_flag FROM priority",
    "priority",
)
def _(spark, sf):
    return ranking.with_persistent_flag(scored_of(spark, sf)).select(
        "school_id", "academic_year", "risk_level", "persistent_high_risk_flag"
    )


BUCKET_COUNTS = ", ".join(
    n_if(f"priority_bucket = '{b}'") + f" AS {a}"
    for b, a in (("TOP_5", "top5"), ("TOP_10", "top10"), ("TOP_20", "top20"), ("STANDARD", "standard"))
)


@query(
    "bucket_summary",
    f"""SELECT count(*) AS total_records, {BUCKET_COUNTS},
  {total('persistent_high_risk_flag')} AS persistent_count FROM priority""",
    "priority",
)
def _(spark, sf):
    return ranking.bucket_summary(ranking.priority_index(scored_of(spark, sf)))


@query(
    "top_priority_districts",
    f"""SELECT district, count(*) AS school_years, {n_if("priority_bucket IN ('TOP_5', 'TOP_10')")}
    AS high_priority_count, {total('persistent_high_risk_flag')} AS persistent_count
FROM priority GROUP BY district ORDER BY high_priority_count DESC, district LIMIT 10""",
    "priority",
)
def _(spark, sf):
    ranked = scored_of(spark, sf).transform(ranking.with_persistent_flag).transform(ranking.with_ranks)
    return ranking.top_priority_districts(ranked)


@query(
    "priority_republished",
    f"""SELECT academic_year, count(*) AS rows, {total('state_rank')} AS rank_sum FROM priority GROUP BY 1""",
    "priority",
)
def _(spark, sf):
    """Publish the ranking by year, replace one year, read the whole table back."""
    path = store.new_path(spark, "priority")
    index = ranking.priority_index(scored_of(spark, sf))
    first = store.republish(index, path, ["academic_year"])
    latest = first.agg(F.max("academic_year")).first()[0]
    again = store.republish(index, path, ["academic_year"], {"academic_year": latest})
    return again.groupBy("academic_year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("state_rank").alias("rank_sum")
    )


# --- allocation -----------------------------------------------------------------------

ALLOCATED = (
    "school_id, academic_year, risk_level, classroom_gap, teacher_gap, classrooms_allocated, teachers_allocated, "
    "classroom_resolved, teacher_resolved, allocation_priority"
)
TIGHT = {"classroom_budget": 250_000_000, "cost_per_classroom": 500_000, "teacher_posts": 1_000}


@query("allocation", f"SELECT {ALLOCATED} FROM report", "report")
def _(spark, sf):
    return allocation.allocation_table(scored_of(spark, sf))


@query("allocation_tight_caps", f"SELECT {ALLOCATED} FROM tight", "tight")
def _(spark, sf):
    return allocation.allocation_table(scored_of(spark, sf), **TIGHT)


@query(
    "allocation_summary",
    f"""SELECT count(*) AS total_records, {total('classrooms_allocated')} AS total_classrooms_alloc,
  {total('teachers_allocated')} AS total_teachers_alloc, {total('classroom_resolved')} AS schools_classroom_resolved,
  {total('teacher_resolved')} AS schools_teacher_resolved,
  {total('greatest(classroom_gap - classrooms_allocated, 0)')} AS remaining_classroom_deficit,
  {total('greatest(teacher_gap - teachers_allocated, 0)')} AS remaining_teacher_deficit FROM report""",
    "report",
)
def _(spark, sf):
    return allocation.allocation_summary(allocation.allocation_table(scored_of(spark, sf)))


@query(
    "district_coverage",
    f"""SELECT district, count(*) AS school_years, {total('classroom_resolved')} AS cr_resolved,
  {rnd('100.0::DOUBLE * sum(classroom_resolved) / count(*)', 1)} AS cr_coverage_pct,
  {total('teacher_resolved')} AS tr_resolved,
  {rnd('100.0::DOUBLE * sum(teacher_resolved) / count(*)', 1)} AS tr_coverage_pct
FROM tight GROUP BY district ORDER BY cr_coverage_pct DESC, district LIMIT 10""",
    "tight",
)
def _(spark, sf):
    return allocation.district_coverage(allocation.with_allocation(scored_of(spark, sf), **TIGHT))


SCENARIO_VALUES = ", ".join(
    f"('{s.name}', {s.max_classrooms}, {s.max_teachers}, {s.unit_cost}::DOUBLE, {s.total_budget_cr}::DOUBLE)"
    for s in SCENARIOS
)
_Q_ORDER = f"risk_score DESC, {sql.TIE}"
SCENARIO_SQL = f"""(SELECT *, classrooms_allocated * unit_cost AS cost,
  CASE WHEN classrooms_allocated = 0 AND teachers_allocated = 0 THEN 'unfunded'
    WHEN classrooms_allocated >= classroom_gap AND teachers_allocated >= teacher_gap THEN 'funded'
    ELSE 'partially_funded' END AS outcome
FROM (SELECT *, {sql.fill('classroom_gap', 'rr', 'max_classrooms')} AS classrooms_allocated,
    {sql.fill('teacher_gap', 'tt', 'max_teachers')} AS teachers_allocated
  FROM (SELECT school_id, district, classroom_gap, teacher_gap,
      {sql.RUNNING.format(g='classroom_gap', o=_Q_ORDER)} AS rr, {sql.RUNNING.format(g='teacher_gap', o=_Q_ORDER)} AS tt
    FROM risk WHERE academic_year = (SELECT max(academic_year) FROM risk))
  CROSS JOIN (VALUES {SCENARIO_VALUES}) AS s(scenario, max_classrooms, max_teachers, unit_cost, total_budget_cr)))"""


def scenarios_of(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.scenario_rows(scored_of(spark, sf), SCENARIOS)


@query(
    "scenario_allocation",
    f"SELECT scenario, school_id, classrooms_allocated, teachers_allocated, cost, outcome FROM {SCENARIO_SQL}",
    "risk",
)
def _(spark, sf):
    return scenarios_of(spark, sf).select(
        "scenario", "school_id", "classrooms_allocated", "teachers_allocated", "cost", "outcome"
    )


@query(
    "scenario_summary",
    f"""SELECT scenario, max_classrooms, max_teachers, total_budget_cr, funded, partially_funded, unfunded,
  total_schools, classrooms_allocated, teachers_allocated, {rnd('cost / 10000000', 2)} AS total_cost_cr,
  {rnd('cost / (total_budget_cr * 10000000) * 100', 1)} AS budget_utilisation_pct,
  {rnd('(funded + partially_funded) * 100.0::DOUBLE / total_schools', 1)} AS coverage_pct
FROM (SELECT scenario, max_classrooms, max_teachers, total_budget_cr, {n_if("outcome = 'funded'")} AS funded,
    {n_if("outcome = 'partially_funded'")} AS partially_funded, {n_if("outcome = 'unfunded'")} AS unfunded,
    count(*) AS total_schools, {total('classrooms_allocated')} AS classrooms_allocated,
    {total('teachers_allocated')} AS teachers_allocated, sum(cost) AS cost
  FROM {SCENARIO_SQL} GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"),
    "risk",
)
def _(spark, sf):
    return allocation.scenario_summary(scenarios_of(spark, sf))


@query(
    "scenario_districts",
    f"""SELECT scenario, district, classrooms, teachers, cost, schools_served FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY classrooms DESC, district) AS pos FROM (
    SELECT scenario, district, {total('classrooms_allocated')} AS classrooms, {total('teachers_allocated')} AS teachers,
      sum(cost) AS cost, {n_if('classrooms_allocated > 0 OR teachers_allocated > 0')} AS schools_served
    FROM {SCENARIO_SQL} GROUP BY 1, 2)) WHERE pos <= 15""",
    "risk",
)
def _(spark, sf):
    return allocation.scenario_districts(scenarios_of(spark, sf))


# --- trend ----------------------------------------------------------------------------


@query(
    "risk_trend",
    f"""SELECT school_id, academic_year, risk_score, prev_risk_score, {rnd('risk_delta', 6)} AS risk_delta,
  trend_direction, year_over_year_count, chronic_risk_flag, volatile_flag,
  {rnd('cumulative_avg_risk', 6)} AS cumulative_avg_risk FROM trend""",
    "trend",
)
def _(spark, sf):
    return rounded(trend.risk_trend(scored_of(spark, sf)), 6, "risk_delta", "cumulative_avg_risk")


def schools_of(spark: SparkSession, sf: str) -> DataFrame:
    """The school dimension, in files by ranges of the id."""
    return standin.published(spark, sf, "schools", lambda: standin.schools(spark, sf), cluster_by=["school_id"])


def search_index_of(spark: SparkSession, sf: str) -> DataFrame:
    return standin.published(spark, sf, "search_index", lambda: search.postings(schools_of(spark, sf)), cluster_by=search.ORDER)


def added_year_of(spark: SparkSession, sf: str) -> DataFrame:
    """The latest year merged into the state that the years before it left."""

    def history():
        scored_rows = scored_of(spark, sf)
        latest = scored_rows.agg(F.max("academic_year")).scalar()
        return carried.state_of(scored_rows.where(F.col("academic_year") < latest))

    state = standin.published(spark, sf, "carried_state", history)
    return standin.published(spark, sf, "carried_merge", lambda: carried.merge(state, in_year(facts_of(spark, sf))))


@query(
    "added_year",
    f"""SELECT t.school_id, t.academic_year, {rnd('t.enrolment_growth_rate', 9)} AS enrolment_growth_rate, t.risk_score,
  prev_risk_score, {rnd('risk_delta', 6)} AS risk_delta, trend_direction, year_over_year_count, chronic_risk_flag,
  volatile_flag, {rnd('cumulative_avg_risk', 6)} AS cumulative_avg_risk, {rnd('avg_growth_rate', 9)} AS avg_growth_rate
FROM trend t JOIN wma0 w ON t.school_id = w.school_id AND t.academic_year = w.academic_year
WHERE t.academic_year = (SELECT max(academic_year) FROM facts)""",
    "trend",
    "wma0",
)
def _(spark, sf):
    rows = carried.year_rows(added_year_of(spark, sf))
    kept = rows.select("school_id", "academic_year", "enrolment_growth_rate", *carried.TREND, "avg_growth_rate")
    kept = rounded(kept, 9, "enrolment_growth_rate", "avg_growth_rate")
    return rounded(kept, 6, "risk_delta", "cumulative_avg_risk")


DIRECTIONS = ", ".join(
    n_if(f"trend_direction = '{d}'") + f" AS {d.lower()}"
    for d in ("BASELINE", "IMPROVING", "STABLE", "DETERIORATING")
)


@query(
    "trend_summary",
    f"""SELECT count(*) AS total, {DIRECTIONS}, {total('chronic_risk_flag')} AS chronic,
  {total('volatile_flag')} AS volatile, {rnd('avg(cumulative_avg_risk)', 4)} AS mean_cum_avg FROM trend""",
    "trend",
)
def _(spark, sf):
    return trend.trend_summary(trend.risk_trend(scored_of(spark, sf)))


@query(
    "top_deteriorating_districts",
    f"""SELECT district, count(*) AS records, {n_if("trend_direction = 'DETERIORATING'")} AS deteriorating,
  {total('chronic_risk_flag')} AS chronic, {total('volatile_flag')} AS volatile,
  {rnd('avg(risk_delta)', 4)} AS avg_delta
FROM trend GROUP BY district ORDER BY deteriorating DESC, district LIMIT 10""",
    "trend",
)
def _(spark, sf):
    return trend.top_deteriorating_districts(trend.with_trend(scored_of(spark, sf)))


# --- district index -------------------------------------------------------------------

INDEX_COLUMNS = (
    "district, academic_year, total_schools, avg_risk_score, pct_high_critical, total_classroom_deficit, "
    "total_teacher_deficit, total_enrolment, avg_classroom_condition, "
    + rnd("yoy_risk_improvement", 6)
    + " AS yoy_risk_improvement, district_rank, compliance_grade"
)


def index_of(spark: SparkSession, sf: str) -> DataFrame:
    return district.district_index(scored_of(spark, sf), keyed_of(spark, sf))


@query("district_index", f"SELECT {INDEX_COLUMNS} FROM index", "index")
def _(spark, sf):
    return rounded(index_of(spark, sf), 6, "yoy_risk_improvement")


@query(
    "index_summary",
    f"""SELECT count(*) AS total_records, count(DISTINCT district) AS total_districts,
  {rnd(mean4('avg_risk_score'), 4)} AS overall_avg_risk,
  {rnd("sum(CAST(round_even(pct_high_critical * 1e2, 0) AS BIGINT))::DOUBLE / 1e2 / count(pct_high_critical)", 2)}
    AS avg_pct_high_critical,
  {total('total_classroom_deficit')} AS grand_classroom_deficit, {total('total_teacher_deficit')} AS grand_teacher_deficit,
  {', '.join(n_if(f"compliance_grade = '{g}'") + f' AS grade_{g.lower()}' for g in 'ABCDF')} FROM index""",
    "index",
)
def _(spark, sf):
    return district.index_summary(index_of(spark, sf))


@query(
    "riskiest_districts",
    """SELECT district, academic_year, avg_risk_score, pct_high_critical, total_classroom_deficit,
  total_teacher_deficit, district_rank, compliance_grade FROM index
WHERE academic_year = (SELECT max(academic_year) FROM index) ORDER BY avg_risk_score DESC, district LIMIT 10""",
    "index",
)
def _(spark, sf):
    return district.riskiest_districts(index_of(spark, sf))


# --- requests -------------------------------------------------------------------------


@query(
    "perturbed_requests",
    "SELECT school_id, academic_year, requested_classrooms, requested_teachers FROM requests",
    "requests",
)
def _(spark, sf):
    return proposals.perturbed_requests(gaps.with_gaps(facts_of(spark, sf)), "md5").select(
        "school_id", "academic_year", "requested_classrooms", "requested_teachers"
    )


@query(
    "perturbed_requests_crc32",
    "SELECT school_id, academic_year, requested_classrooms, requested_teachers FROM requests_crc32",
    "requests_crc32",
)
def _(spark, sf):
    return proposals.perturbed_requests(gaps.with_gaps(facts_of(spark, sf))).select(
        "school_id", "academic_year", "requested_classrooms", "requested_teachers"
    )


VALIDATED = (
    "school_id, academic_year, requested_classrooms, requested_teachers, actual_classroom_gap, actual_teacher_gap, "
    "classroom_ratio, teacher_ratio, decision_status, reason_code, confidence_score"
)


@query("batch_validation", f"SELECT {VALIDATED} FROM judged", "judged")
def _(spark, sf):
    return proposals.validation_table(gaps.with_gaps(facts_of(spark, sf)), "md5")


STATUSES = ", ".join(
    n_if(f"decision_status = '{s}'") + f" AS {s.lower()}" for s in ("ACCEPTED", "FLAGGED", "REJECTED")
)
REASONS = ", ".join(
    n_if(f"reason_code = '{code}'") + f" AS {name}"
    for code, name in (
        ("NO_DEFICIT", "no_deficit"),
        ("CLASSROOM_OVER_REQUEST", "cr_over"),
        ("TEACHER_OVER_REQUEST", "tr_over"),
        ("WITHIN_TOLERANCE", "within_tol"),
        ("NO_REQUEST", "no_request"),
    )
)


@query(
    "validation_summary",
    f"""SELECT count(*) AS total, {STATUSES}, {rnd(mean4('confidence_score'), 4)} AS avg_confidence, {REASONS}
FROM judged""",
    "judged",
)
def _(spark, sf):
    return proposals.validation_summary(judged_of(spark, sf))


@query(
    "top_rejecting_districts",
    f"""SELECT district, count(*) AS proposals, {STATUSES}, {rnd(mean4('confidence_score'), 4)} AS avg_conf
FROM judged_latest GROUP BY district ORDER BY rejected DESC, district LIMIT 10""",
    "judged_latest",
)
def _(spark, sf):
    return proposals.top_rejecting_districts(judged_of(spark, sf))


SUBMITTED = (
    "submission_id, school_id, academic_year, classrooms_requested, teachers_requested, justification, submitted_by, "
    "submitted_at"
)
JUDGED_SUBMISSIONS = (
    SUBMITTED + ", classroom_gap, teacher_gap, total_enrolment, reason_code, decision_status, confidence_score, "
    "classroom_ratio, teacher_ratio"
)
MESSAGE_SQL = """CASE decision_status WHEN 'ACCEPTED' THEN 'Proposal accepted — within tolerance of actual gaps.'
  WHEN 'FLAGGED' THEN concat('Proposal flagged for manual review — ', lower(replace(reason_code, '_', ' ')), '.')
  ELSE concat('Proposal rejected — ', lower(replace(reason_code, '_', ' ')), '.') END AS message"""


def judged_submissions_of(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = proposals.split_valid(standin.submissions(spark, sf))
    return proposals.judge_submissions(valid, gaps.with_gaps(facts_of(spark, sf)))


@query("judged_submissions", f"SELECT {JUDGED_SUBMISSIONS} FROM judged_submissions", "judged_submissions")
def _(spark, sf):
    return judged_submissions_of(spark, sf)


@query(
    "quarantined_submissions",
    f"SELECT {SUBMITTED} FROM submissions WHERE NOT ({sql.VALID})",
    "submissions",
)
def _(spark, sf):
    return proposals.split_valid(standin.submissions(spark, sf))[1]


@query(
    "submission_replies",
    f"""SELECT submission_id, decision_status, reason_code, classroom_gap, teacher_gap, total_enrolment, {MESSAGE_SQL}
FROM judged_submissions""",
    "judged_submissions",
)
def _(spark, sf):
    return proposals.with_message(judged_submissions_of(spark, sf)).select(
        "submission_id",
        "decision_status",
        "reason_code",
        "classroom_gap",
        "teacher_gap",
        "total_enrolment",
        "message",
    )


@query(
    "submission_history",
    "SELECT submission_id, school_id, submitted_at, decision_status, reason_code FROM judged_submissions",
    "judged_submissions",
)
def _(spark, sf):
    """Judged submissions appended with their validation time, then read as a history."""
    path = store.new_path(spark, "submissions")
    store.append(judged_submissions_of(spark, sf), path, stamp="validated_at")
    return proposals.submission_history(store.read_table(spark, path)).select(
        "submission_id", "school_id", "submitted_at", "decision_status", "reason_code"
    )


@query(
    "streamed_submissions",
    f"SELECT {JUDGED_SUBMISSIONS}, {MESSAGE_SQL} FROM judged_submissions",
    "judged_submissions",
)
def _(spark, sf):
    """The same submissions as a file stream joined to the published gap table."""
    arrivals, out = store.new_path(spark, "arrivals"), store.new_path(spark, "judged")
    standin.submissions(spark, sf).write.parquet(arrivals)
    gap_table = scored_of(spark, sf).select(
        "school_id", "academic_year", "classroom_gap", "teacher_gap", "total_enrolment"
    )
    state = store.new_path(spark, "stream-state")
    query = stream.append_judged(stream.read_submissions(spark, arrivals), gap_table, out, state, "validated_at")
    if not query.awaitTermination(STREAM_SECONDS):
        query.stop()
        raise TimeoutError(f"the stream did not end within {STREAM_SECONDS} seconds")
    return store.read_version(spark, out).drop("validated_at", "batch")


# --- averaged forecast ----------------------------------------------------------------


@query(
    "wma_growth",
    f"SELECT school_id, academic_year, {rnd('avg_growth_rate', 9)} AS avg_growth_rate FROM wma0",
    "wma0",
)
def _(spark, sf):
    return rounded(
        forecast.with_wma_growth(facts_of(spark, sf)).select("school_id", "academic_year", "avg_growth_rate"),
        9,
        "avg_growth_rate",
    )


WMA_COLUMNS = (
    "school_id, district, base_year, forecast_year, years_ahead, base_enrolment, "
    + rnd("avg_growth_rate", 9)
    + " AS avg_growth_rate, projected_enrolment, projected_classrooms_req, projected_teachers_req, current_classrooms, "
    "current_teachers, projected_classroom_gap, projected_teacher_gap, school_category"
)


@query("wma_forecast", f"SELECT {WMA_COLUMNS} FROM wma", "wma")
def _(spark, sf):
    return rounded(forecast.wma_forecast(facts_of(spark, sf)), 9, "avg_growth_rate")


@query(
    "wma_forecast_summary",
    f"""SELECT base_year, count(*) AS total_records, count(DISTINCT school_id) AS unique_schools,
  min(forecast_year) AS first_forecast, max(forecast_year) AS last_forecast,
  {rnd('avg(avg_growth_rate)', 4)} AS mean_growth, {rnd('avg(projected_enrolment)', 0)} AS avg_proj_enrolment,
  {total('projected_classroom_gap')} AS total_proj_cr_gap, {total('projected_teacher_gap')} AS total_proj_tr_gap,
  {', '.join(total(f'CASE WHEN years_ahead = {k} THEN projected_{r}_gap ELSE 0 END') + f' AS yr{k}_{t}_gap'
             for r, t in (('classroom', 'cr'), ('teacher', 'tr')) for k in (1, 2, 3))}
FROM wma GROUP BY base_year""",
    "wma",
)
def _(spark, sf):
    return forecast.forecast_summary(forecast.wma_forecast(facts_of(spark, sf)), keyed=keyed_of(spark, sf))


@query(
    "wma_top_districts",
    f"""SELECT district, {total('projected_enrolment')} AS total_proj_enrolment,
  {total('projected_classroom_gap')} AS total_proj_cr_gap, {total('projected_teacher_gap')} AS total_proj_tr_gap,
  {rnd('avg(avg_growth_rate)', 4)} AS avg_growth
FROM wma WHERE years_ahead = 3 GROUP BY district ORDER BY total_proj_cr_gap DESC, district LIMIT 10""",
    "wma",
)
def _(spark, sf):
    return forecast.top_forecast_districts(forecast.wma_forecast(facts_of(spark, sf)))


# --- learned forecast -----------------------------------------------------------------

FEATURE_SQL = {
    "enrolment_lag1": "lag1",
    "enrolment_lag2": "lag2",
    "enrolment_3yr_mean": "mean3",
}
FEATURE_LIST = ", ".join(
    rnd(f"coalesce({FEATURE_SQL.get(f, f)}, 0)::DOUBLE", 9) + f" AS {f}" for f in learned.FEATURES
)


@query(
    "model_features",
    f"""SELECT school_id, academic_year, district, {FEATURE_LIST}, {rnd('wma_growth', 9)} AS wma_growth,
  {rnd('target_growth', 9)} AS target_growth, next1 AS target_enrolment, target_year FROM features""",
    "features",
)
def _(spark, sf):
    return rounded(learned.feature_panel(scored_of(spark, sf)), 9, *learned.FEATURES, "wma_growth", "target_growth")


@query(
    "target_profile",
    f"""SELECT {rnd('avg(target_growth)', 6)} AS mean, {rnd('stddev_samp(target_growth)', 6)} AS std,
  {rnd('quantile_cont(target_growth, 0.05)', 6)} AS p5, {rnd('median(target_growth)', 6)} AS median,
  {rnd('quantile_cont(target_growth, 0.95)', 6)} AS p95 FROM features""",
    "features",
)
def _(spark, sf):
    profile = learned.target_profile(features_of(spark, sf))
    return rounded(profile, 6, "mean", "std", "p5", "median", "p95")


@query(
    "temporal_split",
    """SELECT part, count(*) AS rows, count(DISTINCT academic_year) AS years FROM (
  SELECT *, CASE WHEN academic_year = (SELECT academic_year FROM (SELECT DISTINCT academic_year FROM features)
      ORDER BY academic_year DESC LIMIT 1 OFFSET 1) THEN 'test'
    WHEN total_enrolment >= 10 AND target_year <> (SELECT max(academic_year) FROM features) THEN 'train' END AS part
  FROM features WHERE target_growth IS NOT NULL) WHERE part IS NOT NULL GROUP BY part""",
    "features",
)
def _(spark, sf):
    train, test = learned.split(features_of(spark, sf))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("academic_year").alias("years")
    )


@query("model_evaluation")
def _(spark, sf):
    return learned_of(spark, sf, "evaluation")


@query("model_gain_over_average")
def _(spark, sf):
    return learned.relative_change(learned_of(spark, sf, "evaluation"))


@query("model_training_fit")
def _(spark, sf):
    return learned_of(spark, sf, "fit")


@query("model_rounds")
def _(spark, sf):
    return learned_of(spark, sf, "rounds")


@query("feature_importance")
def _(spark, sf):
    return learned_of(spark, sf, "importance")


@query("learned_forecast")
def _(spark, sf):
    return learned_of(spark, sf, "forecast")


@query("forecast_comparison")
def _(spark, sf):
    return learned.compare_forecasts(learned_of(spark, sf, "forecast"), forecast.wma_forecast(facts_of(spark, sf)))


@query("learned_top_districts")
def _(spark, sf):
    return forecast.top_forecast_districts(learned_of(spark, sf, "forecast"), "ml_growth_rate")


@query("learned_growth_profile")
def _(spark, sf):
    return learned.growth_profile(learned_of(spark, sf, "forecast"))


# --- tables after a prediction ----------------------------------------------------------
# The same operators on a prediction that SQL can state: last year's growth carried forward.


def carried_of(spark: SparkSession, sf: str) -> DataFrame:
    features = features_of(spark, sf)
    guessed = features.withColumn("ml_growth", F.col("growth_rate"))
    return learned.forecast_from(in_year(guessed), learned.split(features)[0], version="carried")


def carried_quality_of(spark: SparkSession, sf: str) -> DataFrame:
    test = learned.split(features_of(spark, sf))[1]
    return learned.evaluate(test.withColumn("ml_growth", F.col("growth_rate")))


QUALITY = ("growth_r2", "growth_mae", "enrolment_r2", "enrolment_mae", "enrolment_mape")


@query(
    "carried_forecast",
    f"SELECT {WMA_COLUMNS.replace('avg_growth_rate', 'ml_growth_rate')}, 'carried' AS model_version FROM carried",
    "carried",
)
def _(spark, sf):
    return rounded(carried_of(spark, sf), 9, "ml_growth_rate")


@query(
    "carried_evaluation",
    f"SELECT method, rows, {', '.join(rnd(q, 6) + ' AS ' + q for q in QUALITY)} FROM carried_quality",
    "carried_quality",
)
def _(spark, sf):
    return rounded(carried_quality_of(spark, sf), 6, *QUALITY)


@query(
    "carried_gain_over_average",
    f"""SELECT {rnd('(w.enrolment_mae - l.enrolment_mae) / nullif(w.enrolment_mae, 0) * 100', 6)} AS mae_gain_pct,
  {rnd('(w.enrolment_mape - l.enrolment_mape) / nullif(w.enrolment_mape, 0) * 100', 6)} AS mape_gain_pct
FROM carried_quality l JOIN carried_quality w ON l.method = 'learned' AND w.method = 'wma'""",
    "carried_quality",
)
def _(spark, sf):
    return rounded(learned.relative_change(carried_quality_of(spark, sf)), 6, "mae_gain_pct", "mape_gain_pct")


@query(
    "carried_comparison",
    f"""SELECT *, ml_cr_gap - wma_cr_gap AS cr_gap_diff, ml_tr_gap - wma_tr_gap AS tr_gap_diff FROM (
  SELECT years_ahead, {total('projected_classroom_gap')} AS wma_cr_gap, {total('projected_teacher_gap')} AS wma_tr_gap
  FROM wma GROUP BY 1) LEFT JOIN (
  SELECT years_ahead, {total('projected_classroom_gap')} AS ml_cr_gap, {total('projected_teacher_gap')} AS ml_tr_gap
  FROM carried GROUP BY 1) USING (years_ahead)""",
    "wma",
    "carried",
)
def _(spark, sf):
    return learned.compare_forecasts(carried_of(spark, sf), forecast.wma_forecast(facts_of(spark, sf)))


@query(
    "carried_top_districts",
    f"""SELECT district, {total('projected_enrolment')} AS total_proj_enrolment,
  {total('projected_classroom_gap')} AS total_proj_cr_gap, {total('projected_teacher_gap')} AS total_proj_tr_gap,
  {rnd('avg(ml_growth_rate)', 4)} AS avg_growth
FROM carried WHERE years_ahead = 3 GROUP BY district ORDER BY total_proj_cr_gap DESC, district LIMIT 10""",
    "carried",
)
def _(spark, sf):
    return forecast.top_forecast_districts(carried_of(spark, sf), "ml_growth_rate")


@query(
    "carried_growth_profile",
    f"""SELECT count(*) AS schools, {rnd('avg(ml_growth_rate)', 6)} AS mean_growth,
  {rnd('median(ml_growth_rate)', 6)} AS median_growth FROM carried WHERE years_ahead = 1""",
    "carried",
)
def _(spark, sf):
    return rounded(learned.growth_profile(carried_of(spark, sf)), 6, "mean_growth", "median_growth")


@query(
    "carried_horizon_totals",
    f"""SELECT years_ahead, forecast_year, {total('projected_classroom_gap')} AS cr_gap,
  {total('projected_teacher_gap')} AS tr_gap, {rnd('avg(ml_growth_rate)', 4)} AS mean_growth,
  {total('projected_enrolment')} AS total_enrolment FROM carried GROUP BY 1, 2""",
    "carried",
)
def _(spark, sf):
    return forecast.horizon_totals(carried_of(spark, sf), "ml_growth_rate")


@query(
    "carried_series",
    """SELECT school_id, academic_year AS year, 'Historical' AS type, total_enrolment AS enrolment FROM facts
UNION ALL SELECT school_id, forecast_year, 'ML Forecast', projected_enrolment FROM carried""",
    "facts",
    "carried",
)
def _(spark, sf):
    return views.enrolment_series(report_of(spark, sf), carried_of(spark, sf))


@query(
    "carried_pairs",
    """SELECT w.school_id, concat('T+', CAST(w.years_ahead AS VARCHAR)) AS horizon, w.projected_enrolment AS wma,
  coalesce(c.projected_enrolment, 0) AS ml
FROM wma w LEFT JOIN carried c ON w.school_id = c.school_id AND w.years_ahead = c.years_ahead""",
    "wma",
    "carried",
)
def _(spark, sf):
    return views.forecast_pairs(forecast.wma_forecast(facts_of(spark, sf)), carried_of(spark, sf))


# --- state views ----------------------------------------------------------------------

KPI_SQL = f"""count(DISTINCT school_id) AS total_schools, {lvl()}, {rnd(mean4(), 4)} AS avg_risk_score,
  {total('classroom_gap')} AS total_classroom_gap, {total('coalesce(teacher_gap, 0)')} AS total_teacher_gap"""
BOTH = "classroom_resolved = 1 AND teacher_resolved = 1"
EITHER = "classroom_resolved = 1 OR teacher_resolved = 1"
NEITHER = "classroom_resolved = 0 AND teacher_resolved = 0"


@query(
    "state_kpis",
    f"""SELECT *, {rnd('critical * 100.0::DOUBLE / total_schools', 1)} AS critical_share_pct
FROM (SELECT {KPI_SQL} FROM latest)""",
    "latest",
)
def _(spark, sf):
    return views.state_kpis(report_of(spark, sf), keyed=keyed_of(spark, sf))


@query(
    "state_budget",
    f"""SELECT {n_if(BOTH)} AS funded, {n_if(f'({EITHER}) AND NOT ({BOTH})')} AS partial, {n_if(NEITHER)} AS unfunded,
  {total('classrooms_allocated')} AS total_classrooms_allocated, {total('teachers_allocated')} AS total_teachers_allocated
FROM latest""",
    "latest",
)
def _(spark, sf):
    return views.state_budget(report_of(spark, sf))


CARD = (
    "district, academic_year, total_schools, avg_risk_score, compliance_grade, district_rank, "
    + rnd("yoy_risk_improvement", 6)
    + " AS yoy_risk_improvement, pct_high_critical"
)


@query(
    "district_cards",
    f"SELECT {CARD} FROM index WHERE academic_year = (SELECT max(academic_year) FROM index)",
    "index",
)
def _(spark, sf):
    return rounded(views.district_cards(index_of(spark, sf)), 6, "yoy_risk_improvement")


@query("available_years", "SELECT DISTINCT academic_year FROM facts", "facts")
def _(spark, sf):
    return views.available_years(facts_of(spark, sf))


@query(
    "risk_by_year",
    f"SELECT academic_year, {rnd(mean4(), 4)} AS avg_risk, {lvl()}, count(*) AS total FROM risk GROUP BY 1",
    "risk",
)
def _(spark, sf):
    return views.risk_by_year(report_of(spark, sf))


@query(
    "enrolment_by_year",
    f"""SELECT academic_year, {total('total_enrolment')} AS total_enrolment, count(DISTINCT school_id) AS school_count
FROM facts GROUP BY 1""",
    "facts",
)
def _(spark, sf):
    return views.enrolment_by_year(report_of(spark, sf), keyed=keyed_of(spark, sf))


@query(
    "allocation_by_status",
    f"""SELECT CASE WHEN {BOTH} THEN 'FUNDED' WHEN {EITHER} THEN 'PARTIALLY_FUNDED' ELSE 'UNFUNDED' END
    AS allocation_status, count(*) AS count, {total('classrooms_allocated')} AS classrooms,
  {total('teachers_allocated')} AS teachers FROM latest GROUP BY 1""",
    "latest",
)
def _(spark, sf):
    return views.allocation_by_status(report_of(spark, sf))


@query(
    "top_unfunded_districts",
    f"""SELECT district, {total('classroom_gap - classrooms_allocated')} AS unfunded_cr_gap,
  {total('teacher_gap - teachers_allocated')} AS unfunded_tr_gap, count(*) AS schools
FROM tight WHERE academic_year = (SELECT max(academic_year) FROM facts) AND {NEITHER}
GROUP BY district ORDER BY unfunded_cr_gap DESC, district LIMIT 10""",
    "tight",
)
def _(spark, sf):
    """With the tight caps, so that both resources run out."""
    return views.top_unfunded_districts(allocation.with_allocation(scored_of(spark, sf), **TIGHT))


@query(
    "wma_horizon_totals",
    f"""SELECT years_ahead, forecast_year, {total('projected_classroom_gap')} AS cr_gap,
  {total('projected_teacher_gap')} AS tr_gap, {rnd('avg(avg_growth_rate)', 4)} AS mean_growth,
  {total('projected_enrolment')} AS total_enrolment FROM wma GROUP BY 1, 2""",
    "wma",
)
def _(spark, sf):
    return forecast.horizon_totals(forecast.wma_forecast(facts_of(spark, sf)))


@query("learned_horizon_totals")
def _(spark, sf):
    return forecast.horizon_totals(learned_of(spark, sf, "forecast"), "ml_growth_rate")


# --- district views -------------------------------------------------------------------

ARROW = """CASE WHEN yoy_risk_improvement < -0.01::DOUBLE THEN 'down' WHEN yoy_risk_improvement > 0.01::DOUBLE THEN 'up'
  WHEN yoy_risk_improvement IS NOT NULL THEN 'stable' END"""


@query(
    "district_list",
    f"SELECT {CARD}, {ARROW} AS trend FROM index WHERE academic_year = (SELECT max(academic_year) FROM index)",
    "index",
)
def _(spark, sf):
    return rounded(views.district_list(index_of(spark, sf)), 6, "yoy_risk_improvement")


@query("district_history", f"SELECT {CARD} FROM index", "index")
def _(spark, sf):
    return rounded(views.district_history(index_of(spark, sf)), 6, "yoy_risk_improvement")


@query(
    "block_heatmap",
    f"""SELECT district, coalesce(block, 'UNKNOWN') AS block,
  {', '.join(n_if(f"risk_level = '{v}'") + f' AS "{v}"' for v in sql.LEVELS)}, count(*) AS total
FROM latest GROUP BY 1, 2""",
    "latest",
)
def _(spark, sf):
    return views.block_heatmap(report_of(spark, sf))


@query(
    "priority_schools",
    """SELECT district, school_id, school_name, block, risk_score, state_rank, priority_bucket,
  persistent_high_risk_flag, classroom_gap, risk_level, coalesce(teacher_gap, 0) AS teacher_gap
FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY state_rank, school_id) AS pos
  FROM latest WHERE priority_bucket IN ('TOP_5', 'TOP_10')) WHERE pos <= 50""",
    "latest",
)
def _(spark, sf):
    return views.priority_schools(report_of(spark, sf))


@query(
    "decision_counts",
    "SELECT district, decision_status, count(*) AS count FROM judged_latest GROUP BY 1, 2",
    "judged_latest",
)
def _(spark, sf):
    return views.decision_counts(judged_of(spark, sf))


@query(
    "flagged_requests",
    """SELECT district, school_id, school_name, block, decision_status, reason_code, confidence_score,
  classroom_ratio, teacher_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY district ORDER BY confidence_score, school_id) AS pos
  FROM judged_latest WHERE decision_status = 'FLAGGED') WHERE pos <= 30""",
    "judged_latest",
)
def _(spark, sf):
    return views.flagged_requests(judged_of(spark, sf))


# --- block views ----------------------------------------------------------------------


@query(
    "block_kpis",
    f"""SELECT district, coalesce(block, 'UNKNOWN') AS block, {KPI_SQL}, {n_if(BOTH)} AS funded_count
FROM latest GROUP BY 1, 2""",
    "latest",
)
def _(spark, sf):
    return views.block_kpis(report_of(spark, sf), keyed=keyed_of(spark, sf))


@query(
    "block_schools",
    f"""SELECT district, block, school_id, school_name, school_category, risk_score, risk_level, classroom_gap,
  coalesce(teacher_gap, 0) AS teacher_gap, trend_direction, chronic_risk_flag AS is_chronic,
  volatile_flag AS is_volatile, CASE WHEN {BOTH} THEN 'FUNDED' WHEN {EITHER} THEN 'PARTIAL' ELSE 'UNFUNDED' END
    AS budget_status, total_enrolment
FROM (SELECT *, row_number() OVER (PARTITION BY district, block ORDER BY risk_score DESC, school_id) AS pos FROM latest)
WHERE pos <= 100""",
    "latest",
)
def _(spark, sf):
    return views.block_schools(report_of(spark, sf))


@query(
    "chronic_schools",
    """SELECT district, block, school_id, school_name, risk_score, chronic_risk_flag AS is_chronic,
  volatile_flag AS is_volatile, trend_direction, classroom_gap, coalesce(teacher_gap, 0) AS teacher_gap
FROM latest WHERE chronic_risk_flag = 1""",
    "latest",
)
def _(spark, sf):
    return views.chronic_schools(report_of(spark, sf))


@query(
    "volatile_schools",
    f"""SELECT district, block, school_id, school_name, risk_score, {rnd('risk_delta', 6)} AS risk_delta, trend_direction
FROM (SELECT *, row_number() OVER (PARTITION BY district, block ORDER BY abs(risk_delta) DESC NULLS LAST, school_id)
    AS pos FROM latest WHERE volatile_flag = 1) WHERE pos <= 30""",
    "latest",
)
def _(spark, sf):
    return rounded(views.volatile_schools(report_of(spark, sf)), 6, "risk_delta")


# --- school views ---------------------------------------------------------------------

NEWEST = "(SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY academic_year DESC) AS pos FROM report)"


@query(
    "school_profile",
    "SELECT school_id, school_name, district, block, school_category, management_type FROM schools",
    "schools",
)
def _(spark, sf):
    return views.school_profile(standin.schools(spark, sf))


@query(
    "latest_card",
    f"""SELECT school_id, academic_year, risk_score, risk_level, classroom_gap, required_class_rooms, usable_class_rooms,
  teacher_deficit_ratio, classroom_deficit_ratio, coalesce(teacher_gap, 0) AS teacher_gap,
  coalesce(required_teachers, 0) AS required_teachers, coalesce(total_teachers, 0) AS total_teachers, total_enrolment,
  trend_direction, {rnd('coalesce(risk_delta, 0.0)', 6)} AS risk_delta, chronic_risk_flag AS is_chronic,
  priority_bucket, persistent_high_risk_flag AS persistent_high_risk, state_rank AS risk_rank
FROM {NEWEST} WHERE pos = 1""",
    "report",
)
def _(spark, sf):
    return rounded(views.latest_card(report_of(spark, sf)), 6, "risk_delta")


@query(
    "school_history",
    """SELECT school_id, academic_year, total_enrolment, risk_score, risk_level, classroom_gap,
  coalesce(teacher_gap, 0) AS teacher_gap, coalesce(total_teachers, 0) AS total_teachers, usable_class_rooms
FROM risk""",
    "risk",
)
def _(spark, sf):
    return views.school_history(report_of(spark, sf))


@query(
    "school_wma_forecast",
    f"""SELECT school_id, forecast_year, years_ahead, base_enrolment, {rnd('avg_growth_rate', 9)} AS avg_growth_rate,
  projected_enrolment, projected_classroom_gap, projected_teacher_gap FROM wma""",
    "wma",
)
def _(spark, sf):
    rows = views.school_forecast(forecast.wma_forecast(facts_of(spark, sf)), "avg_growth_rate")
    return rounded(rows, 9, "avg_growth_rate")


@query("school_learned_forecast")
def _(spark, sf):
    return views.school_forecast(learned_of(spark, sf, "forecast"), "ml_growth_rate")


@query(
    "facility_checklist",
    f"""SELECT school_id, academic_year, drinking_water_available AS drinking_water, CAST(NULL AS BOOLEAN) AS electricity,
  internet_available AS internet, CAST(NULL AS BOOLEAN) AS girls_toilet, CAST(NULL AS BOOLEAN) AS ramp,
  CAST(NULL AS BOOLEAN) AS cwsn_toilet, CAST(NULL AS BOOLEAN) AS resource_room, building_condition,
  classroom_condition_score, total_class_rooms, usable_class_rooms FROM {NEWEST} WHERE pos = 1""",
    "report",
)
def _(spark, sf):
    return views.facility_checklist(report_of(spark, sf))


@query(
    "school_search",
    """SELECT school_id, school_name, district, block, school_category FROM schools
WHERE school_id ILIKE '%mer#00000001%' OR school_name ILIKE '%mer#00000001%' ORDER BY school_id LIMIT 20""",
    "schools",
)
def _(spark, sf):
    return views.search_schools(schools_of(spark, sf), "MER#00000001", index=search_index_of(spark, sf))


@query("enrolment_series")
def _(spark, sf):
    return views.enrolment_series(report_of(spark, sf), learned_of(spark, sf, "forecast"))


@query("forecast_pairs")
def _(spark, sf):
    return views.forecast_pairs(forecast.wma_forecast(facts_of(spark, sf)), learned_of(spark, sf, "forecast"))


@query(
    "gap_rows",
    f"""SELECT school_id, academic_year, 'Classrooms' AS name, usable_class_rooms AS actual,
  required_class_rooms AS required, classroom_gap AS gap FROM {NEWEST} WHERE pos = 1
UNION ALL SELECT school_id, academic_year, 'Teachers', coalesce(total_teachers, 0), coalesce(required_teachers, 0),
  coalesce(teacher_gap, 0) FROM {NEWEST} WHERE pos = 1""",
    "report",
)
def _(spark, sf):
    return views.gap_rows(report_of(spark, sf))


# --- figures the design describes -------------------------------------------------------


@query(
    "state_index",
    f"""SELECT academic_year, {rnd(mean4('avg_risk_score'), 4)} AS state_risk, count(*) AS districts
FROM index GROUP BY 1""",
    "index",
)
def _(spark, sf):
    return views.state_index(index_of(spark, sf))


@query(
    "critical_blocks",
    f"""SELECT *, {rnd('critical * 100.0::DOUBLE / total', 2)} AS critical_share_pct FROM (
  SELECT district, coalesce(block, 'UNKNOWN') AS block, {n_if("risk_level = 'CRITICAL'")} AS critical, count(*) AS total
  FROM latest GROUP BY 1, 2) ORDER BY critical_share_pct DESC, district, block LIMIT 10""",
    "latest",
)
def _(spark, sf):
    return views.critical_blocks(report_of(spark, sf))


@query(
    "growing_gap_warnings",
    f"""SELECT district, current_gap, projected_gap, projected_gap > current_gap AS warning FROM
  (SELECT coalesce(district, 'UNKNOWN') AS district, {total('classroom_gap')} AS current_gap FROM latest GROUP BY 1)
  JOIN (SELECT coalesce(district, 'UNKNOWN') AS district, {total('projected_classroom_gap')} AS projected_gap FROM wma
    WHERE years_ahead = 3 GROUP BY 1) USING (district)""",
    "latest",
    "wma",
)
def _(spark, sf):
    return views.growing_gap_warnings(report_of(spark, sf), forecast.wma_forecast(facts_of(spark, sf)))


@query(
    "block_level_shares",
    f"""SELECT district, block, total, {', '.join(rnd(f'{v.lower()} * 100.0::DOUBLE / total', 2) + f' AS {v.lower()}_pct' for v in sql.LEVELS)}
FROM (SELECT district, coalesce(block, 'UNKNOWN') AS block, {lvl()}, count(*) AS total FROM latest GROUP BY 1, 2)""",
    "latest",
)
def _(spark, sf):
    return views.block_level_shares(report_of(spark, sf))


# --- flagship -------------------------------------------------------------------------


def compliance_card(spark: SparkSession, sf: str) -> DataFrame:
    """From the raw tables to the district compliance card, worst district first."""
    index = district.district_index(scored(standin.build_facts(spark, sf)))
    return views.district_list(index)
