"""The whole run: from raw files or facts to every published table.

Each step reads published tables and publishes its own, so a lost executor
costs at most the running step and the dashboards read plain partitioned
Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelwise.operators import (
    allocation,
    assemble,
    carried,
    district,
    forecast,
    learned,
    normalise,
    proposals,
)
from panelwise.plans import report as reporting
from panelwise.sources import raw, store

YEAR = ["academic_year"]
KEY = ["school_id", "academic_year"]


class Warehouse:
    """Published tables under one folder, in versions: a failed run leaves the last one readable."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.seen: dict[str, dict] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(
        self, name: str, df: DataFrame, by: list[str] | None = None, cluster_by: list[str] | None = None
    ) -> DataFrame:
        return store.republish(df, self.path(name), by, cluster_by=cluster_by)

    def put_seen(self, name: str, df: DataFrame, by: list[str] | None, **figures) -> DataFrame:
        """Publish a table and keep figures of it, taken while it is written, in `seen`."""
        figures_of = Observation()
        out = self.put(name, df.observe(figures_of, *[c.alias(n) for n, c in figures.items()]), by)
        self.seen[name] = figures_of.get
        return out

    def get(self, name: str) -> DataFrame:
        return store.read_version(self.spark, self.path(name))


def load_raw(house: Warehouse, raw_root: str, layout: str = raw.YEAR_FOLDERS) -> DataFrame:
    """Raw yearly files -> longitudinal panel -> four tables -> wide facts."""
    files = raw.read_all_years(house.spark, raw_root, layout=layout)
    rows = F.count(F.lit(1))
    panel = house.put_seen(
        "longitudinal",
        assemble.longitudinal(files, lambda df: house.put("assembled", df, ["year"]), writes=True),
        ["year"],
        rows=rows,
        years=F.collect_set("year"),
    )
    by = {"schools": None, "yearly_metrics": YEAR, "infrastructure_details": YEAR, "teacher_metrics": YEAR}
    tables = {name: house.put_seen(name, df, by[name], rows=rows) for name, df in normalise.split_panel(panel).items()}
    return house.put("facts", normalise.join_facts(tables), YEAR)


def load_summary(house: Warehouse) -> DataFrame:
    """One row: distinct schools, school-year rows, sorted years; from figures taken while `load_raw` wrote its tables."""
    panel = house.seen["longitudinal"]
    row = (house.seen["schools"]["rows"], panel["rows"], ",".join(sorted(panel["years"])))
    return house.spark.createDataFrame([row], "total_schools bigint, school_year_rows bigint, academic_years string")


def derive(house: Warehouse, facts: DataFrame, hash_method: str = "crc32") -> dict[str, DataFrame]:
    """Facts -> report, district index, validation and averaged forecast."""

    def stage(name: str, df: DataFrame, cluster_by: list[str] | None = None) -> DataFrame:
        return house.put(name, df, YEAR, cluster_by)

    scored = stage("scored", reporting.scored(facts))
    report = stage(
        "report",
        reporting.report(facts, stage),
        ["school_id"],
    )
    judged = proposals.perturbed_requests(scored, hash_method).transform(proposals.judge_batch)
    return {
        "scored": scored,
        "report": report,
        "district_index": house.put("district_index", district.district_index(scored, store.is_key(facts, KEY))),
        "validation": stage("validation", judged),
        "wma_forecast": house.put("wma_forecast", forecast.wma_forecast(facts)),
    }


def learn(
    house: Warehouse, scored: DataFrame, settings: learned.BoostingSettings = learned.BoostingSettings()
) -> dict[str, DataFrame]:
    """Scored rows -> features, trained forecast and its evaluation."""
    panel = house.put("features", learned.feature_panel(scored))
    train, test = learned.split(panel)
    model = learned.fit(train, settings)
    return {
        "features": panel,
        "learned_forecast": house.put("learned_forecast", learned.learned_forecast(model, panel, train)),
        "evaluation": house.put("evaluation", learned.evaluate(learned.predict(model, test))),
        "importance": house.put("importance", learned.feature_importance(model, panel)),
    }


def rescore_year(house: Warehouse, facts: DataFrame, year: str) -> DataFrame:
    """Replace one year of the risk table; the lags still see the full history."""
    return store.republish(reporting.scored(facts), house.path("scored"), YEAR, {"academic_year": year})


def keep_state(house: Warehouse, scored: DataFrame) -> DataFrame:
    """Publish the carried state after a whole history, from which years are then added one by one."""
    return house.put("carried_state", carried.state_of(scored))


def add_year(house: Warehouse, facts: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of one more year with risk, trend and averaged growth, and the state after it.

    Reads the facts of that year and the state, not the history.
    """
    merged = house.put("carried_merge", carried.merge(state, facts))
    year = house.put("added_year", carried.year_rows(merged))
    return year, house.put("carried_state", carried.next_state(merged))


def simulate(report: DataFrame, scenarios: list[allocation.Scenario], year: str | None = None):
    """(summary, districts) of what-if budgets over the published report."""
    rows = allocation.scenario_rows(report.where(F.col("state_rank").isNotNull()), scenarios, year)
    return allocation.scenario_summary(rows), allocation.scenario_districts(rows)
