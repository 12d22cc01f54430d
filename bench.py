"""Time the headline queries and print one JSON line.

Each query is materialised in full (every column of every row) with the noop
sink. `load_facts` is the way from the raw tables to the published facts; the
other queries start from published facts, as they do in a running system.
"""

from __future__ import annotations

import json
import os
import time

from tests.session import make_session

HEADLINE = [
    "longitudinal_panel",
    "school_sums",
    "median_growth_by_stability",
    "growth_panel",
    "top_room_gap_districts",
    "risk_score",
    "risk_summary",
    "priority_index",
    "allocation",
    "scenario_summary",
    "risk_trend",
    "district_index",
    "batch_validation",
    "judged_submissions",
    "streamed_submissions",
    "wma_forecast",
    "model_features",
    "learned_forecast",
    "state_kpis",
    "block_schools",
    "latest_card",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session(os.environ.get("BENCH_CPUS", "8"))
    from panelwise.plans import catalog, standin

    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    run(standin.schools(spark, sf_dir))  # start the engine before the clock
    timed("load_facts", lambda: standin.facts(spark, sf_dir))
    timed("compliance_card_from_raw", lambda: run(catalog.compliance_card(spark, sf_dir)))
    timed("publish_report", lambda: catalog.report_of(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: run(catalog.QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
