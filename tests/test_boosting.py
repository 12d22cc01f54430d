"""Boosting with Huber loss against numpy."""

import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from panelwise.operators import boosting
from panelwise.operators.learned import BoostingSettings

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 3)).round(3)
    y = 0.2 * np.sign(x[:, 0]) + 0.05 * x[:, 1] + np.where(r.random(3000) < 0.05, r.normal(0, 2, 3000), r.normal(0, 0.02, 3000))
    data = [(int(i), *map(float, x[i]), float(y[i]), bool(i % 10 == 0)) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, a double, b double, c double, y double, held_out boolean")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).withColumn("_key", F.xxhash64("k")).cache()


@pytest.fixture(scope="module")
def model(rows):
    return boosting.fit_huber(rows, NAMES, "y", BoostingSettings(rounds=45, depth=3, step=0.2, min_leaf=20, patience=5))


def test_parts_equal_numpy():
    r = np.random.default_rng(1)
    x = r.normal(size=500)
    n = r.integers(1, 5, 500)
    every = np.sort(np.repeat(x, n))
    for q in (0.5, 0.9):
        assert boosting.quantile(x, n, q) == np.quantile(every, q, method="inverted_cdf")
    middle = np.quantile(every, 0.5, method="inverted_cdf")
    want = middle + np.mean(np.sign(every - middle) * np.minimum(0.3, np.abs(every - middle)))
    assert boosting.leaf_value(x, n, 0.3) == pytest.approx(want)
    assert boosting.huber(np.array([0.1, -0.1, 0.5]), 0.3) == pytest.approx([0.005, 0.005, 0.3 * (0.5 - 0.15)])
    # minus the slope of the loss is the residual clipped at delta, which the trees are fitted to
    h = 1e-6
    assert (boosting.huber(x + h, 0.3) - boosting.huber(x - h, 0.3)) / (2 * h) == pytest.approx(np.clip(x, -0.3, 0.3), abs=1e-5)


def test_goes_on_while_better_than_any_of_the_last():
    assert boosting.goes_on([], 1.0, 3, 1e-5)
    assert boosting.goes_on([3, 2], 5.0, 3, 1e-5)
    assert boosting.goes_on([3, 2, 1], 2.5, 3, 1e-5)
    assert not boosting.goes_on([9, 3, 2, 1], 3.0, 3, 1e-5)
    assert not boosting.goes_on([1, 1, 1], 1 - 1e-6, 3, 1e-5)


def test_tree_as_sql_equals_the_tree(rows):
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="y", leafCol="leaf", maxDepth=4).fit(rows)
    values = [float(i) for i in range(boosting._leaves(tree))]
    both = tree.transform(rows).withColumn("mine", F.expr(boosting.tree_sql(tree.toDebugString, NAMES, values)))
    assert both.where("mine <> leaf").isEmpty() and len(values) > 8


def test_model_equals_its_own_account(rows, model):
    """Deltas, losses and errors of the rounds are those of the prefixes of the model, up to the width of a cell."""
    pdf = rows.toPandas()
    for kept in (1, 7, model.getNumTrees):
        prefix = boosting.HuberModel(NAMES, model.start, model.step, model.trees[:kept])
        p = rows.withColumn("p", prefix.prediction()).toPandas()
        off = (p["y"] - p["p"]).to_numpy()
        out = pdf["held_out"].to_numpy()
        assert model.misses[kept - 1] == pytest.approx(np.abs(off[out]).mean(), abs=boosting.CELL)
        assert model.losses[kept - 1] == pytest.approx(boosting.huber(off[out], model.deltas[kept - 1]).mean(), abs=boosting.CELL)
        if kept < model.getNumTrees:
            assert model.deltas[kept] == pytest.approx(np.quantile(np.abs(off[~out]), 0.9), abs=2 * boosting.CELL)


def test_stops_where_the_patience_says_and_learns(rows, model):
    seen = model.losses
    for number in range(len(seen) - 1):
        assert boosting.goes_on(seen[:number], seen[number], 5, 1e-5)
    assert model.getNumTrees == 45 or not boosting.goes_on(seen[:-1], seen[-1], 5, 1e-5)
    assert 5 < model.getNumTrees < 45
    # outliers do not pull the fit: the inner errors come close to the noise
    p = rows.where("held_out").withColumn("p", model.prediction())
    assert p.agg(F.percentile_approx(F.abs(F.col("y") - F.col("p")), 0.5)).first()[0] < 0.03
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares[0] > shares[1] > shares[2]


def test_first_tree_has_the_leaf_values_of_its_rows(rows):
    one = boosting.fit_huber(rows, NAMES, "y", BoostingSettings(rounds=1, depth=1, step=1.0, sample=1.0, min_leaf=20))
    p = rows.where("NOT held_out").withColumn("p", one.prediction()).toPandas()
    assert one.start == pytest.approx(np.median(p["y"]), abs=boosting.CELL)
    off = (p["y"] - one.start).to_numpy()
    assert one.deltas[0] == pytest.approx(np.quantile(np.abs(off), 0.9), abs=boosting.CELL)
    for value, group in p.groupby("p"):
        inside = off[group.index]
        middle = np.median(inside)
        want = middle + np.clip(inside - middle, -one.deltas[0], one.deltas[0]).mean()
        assert value - one.start == pytest.approx(want, abs=boosting.CELL)


def test_first_tree_splits_as_mllib_does(rows):
    one = boosting.fit_huber(rows, NAMES, "y", BoostingSettings(rounds=1, depth=3, step=1.0, sample=1.0, min_leaf=20))
    off, delta = F.col("y") - F.lit(one.start), F.lit(one.deltas[0])
    fitted = rows.where("NOT held_out").withColumn("g", F.greatest(-delta, F.least(delta, off)))
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="g", maxDepth=3, minInstancesPerNode=20).fit(fitted)
    theirs = boosting.tree_sql(tree.toDebugString, NAMES, [0.0] * boosting._leaves(tree))
    splits = [re.findall(r"`(\w)` <= (\S+)D", text) for text in (one.trees[0], theirs)]
    assert splits[0] == splits[1] and len(splits[0]) > 3
    assert one.featureImportances.toArray() == pytest.approx(tree.featureImportances.toArray(), abs=1e-3)


def test_draws_are_those_of_sql(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 200)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    for number in (0, 7, 499):
        want = [r[0] for r in df.select(F.pmod(F.xxhash64("k", F.lit(number)), F.lit(1000))).collect()]
        assert boosting.draws(keys.view(np.uint64), number).tolist() == want


def test_rows_are_kept_small_and_their_layout_does_not_matter(spark, rows, monkeypatch, tmp_path):
    """What is kept and written of a row is bounded by bytes; trees are the same however the rows lie."""
    monkeypatch.setattr(boosting, "new_path", lambda spark, name: f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
    monkeypatch.setattr(boosting, "LEAST", 500)
    settings = BoostingSettings(rounds=6, depth=3, step=0.2, min_leaf=20)
    first, second = (boosting.fit_huber(rows.repartition(n, "_key"), NAMES, "y", settings) for n in (1, 7))
    assert first.trees == second.trees and first.losses == second.losses
    written = [sum(len(r[c]) for r in spark.read.parquet(str(p)).collect() for c in ("codes", "hash", "held", "off")) for p in tmp_path.iterdir()]
    assert written == [3000 * (3 * 2 + 8 + 1 + 8)] * 2


def test_bounds_from_a_sample_agree_with_the_model(rows, monkeypatch):
    """Codes taken from part of the rows: what the trees leave of the target is what their SQL leaves."""
    monkeypatch.setattr(boosting, "SPLIT_ROWS", 500)
    model = boosting.fit_huber(rows, NAMES, "y", BoostingSettings(rounds=6, depth=3, step=0.3, min_leaf=20))
    p = rows.where("held_out").withColumn("p", model.prediction()).toPandas()
    assert model.misses[-1] == pytest.approx(np.abs(p["y"] - p["p"]).mean(), abs=boosting.CELL)
    assert model.misses[-1] < 0.7 * model.misses[0]
