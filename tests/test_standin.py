"""The stand-in panel: counts of distinct items, and how many tasks hold its lines and rows."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelwise.plans import standin
from panelwise.sources import store

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"
LINES = "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string"


def rows_of(seed=3, orders=400):
    """Orders of which one customer has most, lines with unknown items, flags and amounts, and rows that come twice."""
    draw = random.Random(seed)
    heads, lines = [], []
    for key in range(orders):
        customer = 7 if draw.random() < 0.7 else draw.randrange(20)
        day = datetime.datetime(1995 + draw.randrange(3), 5, 1)
        heads.append((key, customer, day, draw.choice(["1-URGENT", "2-HIGH", "5-LOW", None])))
        for _ in range(draw.randrange(6)):
            lines.append(
                (
                    key,
                    draw.choice([None, *range(30)]),
                    draw.choice([None, *range(40)]),
                    draw.choice([None, 1.0, 17.0]),
                    draw.choice(["N", "R", "A", None]),
                    draw.choice(["O", "F", None]),
                )
            )
    return heads + heads[:5], lines + lines[:9]


def by_hand(heads, lines):
    groups = defaultdict(list)
    of_order = defaultdict(list)
    for line in lines:
        of_order[line[0]].append(line)
    for key, customer, day, priority in heads:
        for line in of_order[key]:
            groups[str(customer), day.year].append((priority, *line[1:]))
    out = {}
    for (school, year), rows in groups.items():
        parts = {r[2] for r in rows if r[5] == "F"}
        amounts = [r[3] for r in rows if r[3] is not None] + [0.0] * len(parts)
        out[school, f"{year}-{(year + 1) % 100:02d}"] = (
            int(sum(amounts)) if amounts else None,
            len({r[1] for r in rows}),
            len({r[1] for r in rows if r[4] == "N"}) or None,
            len(parts) or None,
            sum({"R": 2, "A": 1}.get(r[4], 0) for r in rows),
            min((r[0] for r in rows if r[0] is not None), default=None),
        )
    return out


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    heads, lines = rows_of()
    folder = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(heads, ORDERS).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")
    return folder, heads, lines


@pytest.mark.parametrize("heavy", [10**9, 20])
def test_panel_counts_each_item_once(spark, raw, monkeypatch, heavy):
    """The same with a customer's items in one task and dealt out."""
    folder, heads, lines = raw
    monkeypatch.setattr(standin, "HEAVY_ORDERS", heavy, raising=False)
    got = {(r[0], r[1]): tuple(r)[2:8] for r in standin.panel(spark, folder).collect()}
    assert got == by_hand(heads, lines)


def test_tasks_of_the_panel_grow_with_its_lines(spark, raw, monkeypatch):
    """Lines are dealt out twice, to more tasks when there are more of them, and never as two items a line."""
    folder, _, lines = raw
    monkeypatch.setattr(standin, "LINES_A_TASK", 25, raising=False)
    text = standin.panel(spark, folder)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    tasks = -(-len(lines) // 25)
    assert sum(f", {tasks})" in line for line in exchanges) >= 3
    assert not any("item" in line.split("hashpartitioning")[1] for line in exchanges)


def test_items_of_a_large_customer_are_dealt_out(spark, raw, monkeypatch):
    folder, _, lines = raw
    monkeypatch.setattr(standin, "LINES_A_TASK", 25, raising=False)
    monkeypatch.setattr(standin, "HEAVY_ORDERS", 20, raising=False)
    plan = standin.dealt(spark, folder)
    sizes = plan.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < len(lines) / 4


def test_exchanges_start_with_partitions_for_the_rows(spark, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        standin.deal_finely(spark, 100)
        assert spark.conf.get(name, None) == before
        standin.deal_finely(spark, 500 * standin.ROWS_A_TASK)
        assert spark.conf.get(name) == "500"
        standin.deal_finely(spark, 100)
        assert spark.conf.get(name) == "500"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_tables_of_dealt_rows_are_written_without_another_exchange(spark, tmp_path):
    rows = spark.range(0, 900, 1, 3).select(F.col("id").cast("string").alias("school_id"), (F.col("id") % 2).cast("string").alias("academic_year"))
    out = store.publish(rows, f"{tmp_path}/t", ["academic_year"], as_dealt=True)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))
    assert len(list(tmp_path.glob("t/*/part-*.parquet"))) == 6


def test_flags_and_scores_share_the_exchange_of_the_facts(spark, sf):
    """Rows go to their schools once before the ranks; the scores are not written and dealt out again for the flags."""
    from panelwise.plans import report

    seen = {}

    def stage(name, df):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    report.report(standin.facts(spark, sf), stage)
    assert seen["flagged"].count("Exchange") == 1 and "scored" not in seen


def test_yearly_tables_of_the_queries_are_written_by_the_tasks_of_their_windows(spark, tmp_path, monkeypatch):
    from panelwise.plans import catalog

    rows = spark.range(0, 60, 1, 2).select((F.col("id") % 3).cast("string").alias("academic_year"), "id")
    monkeypatch.setattr(standin, "new_path", lambda _, name: f"{tmp_path}/{name}")
    try:
        assert catalog.by_year(spark, str(tmp_path), "t", lambda: rows).count() == 60
    finally:
        standin.forget(str(tmp_path))
    assert len(list(tmp_path.glob("t/*/part-*.parquet"))) == 6
