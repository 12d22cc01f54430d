from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.operators import forecast, learned
from panelwise.plans.report import scored


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        size, drift = int(rng.integers(0, 400)), rng.normal(0, 0.1)
        for y in range(10, 10 + int(rng.integers(1, 8))):
            if rng.random() < 0.1:
                continue
            size = max(0, int(size * (1 + drift + rng.normal(0, 0.05))))
            enrol = None if rng.random() < 0.02 else size
            rows.append((f"s{i}", f"20{y}-{y + 1}", enrol, 9, int(rng.integers(0, 9)), int(rng.integers(0, 9)), None if i % 7 == 0 else f"d{i % 5}", f"m{i % 3}", i % 11 + 1))
    return spark.createDataFrame(
        rows,
        "school_id string, academic_year string, total_enrolment int, total_class_rooms int, usable_class_rooms int, "
        "total_teachers int, district string, management_type string, school_category int",
    ).cache()


def test_features_equal_a_pandas_computation(sample):
    rows = scored(sample)
    got = learned.feature_panel(rows).toPandas().sort_values(["school_id", "academic_year"]).reset_index(drop=True)
    pdf = rows.toPandas().sort_values(["school_id", "academic_year"]).reset_index(drop=True)
    e = pdf["total_enrolment"].astype(float)
    g = e.groupby(pdf["school_id"])
    lag1, lag2, lag3 = g.shift(1), g.shift(2), g.shift(3)
    base = lag1.clip(lower=1)
    growth = ((e - lag1) / base).clip(-0.3, 0.3)
    wma = (3 * (e - lag1).fillna(0) + 2 * (lag1 - lag2).fillna(0) + (lag2 - lag3).fillna(0)) / (6 * base)
    nxt = g.shift(-1)
    want = {
        "enrolment_lag1": lag1.fillna(0),
        "growth_rate": growth.fillna(0),
        "growth_rate_lag1": growth.groupby(pdf["school_id"]).shift(1).fillna(0),
        "enrolment_3yr_mean": g.transform(lambda x: x.rolling(3, min_periods=1).mean()).fillna(0),
        "enrolment_volatility": g.transform(lambda x: x.rolling(3, min_periods=2).std()).fillna(0).clip(upper=500),
        "teacher_per_student": (pdf["total_teachers"] / e.clip(lower=1)).fillna(0),
        "wma_growth": wma.clip(-0.3, 0.3),
        "target_growth": ((nxt - e) / e.clip(lower=1)).clip(-0.3, 0.3),
        "district_code": pd.Series(pd.factorize(pdf["district"].fillna("UNK"), sort=True)[0]).astype(float),
        "management_code": pd.Series(pd.factorize(pdf["management_type"], sort=True)[0]).astype(float),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series.astype(float), atol=1e-9, err_msg=name)


@pytest.fixture(scope="module")
def trained(sample):
    panel = learned.feature_panel(scored(sample)).cache()
    train, test = learned.split(panel)
    settings = learned.BoostingSettings(rounds=15, step=0.2, min_leaf=5, loss="squared")
    return panel, train, test, learned.fit(train, settings)


def test_split_keeps_years_apart(trained):
    panel, train, test, _ = trained
    years = sorted(r[0] for r in panel.select("academic_year").distinct().collect())
    assert {r[0] for r in test.select("academic_year").distinct().collect()} == {years[-2]}
    assert years[-2] not in {r[0] for r in train.select("academic_year").distinct().collect()}
    assert train.where(F.col("target_year") == years[-1]).count() == 0
    assert learned.split(panel, strict=False)[0].count() >= train.count()


def test_evaluation_matches_numpy(trained):
    panel, train, test, model = trained
    rows = learned.predict(model, test)
    got = {r.method: r for r in learned.evaluate(rows).collect()}
    pdf = rows.toPandas()
    g = pdf["wma_growth"].fillna(0).clip(-0.3, 0.3)
    enrol = np.maximum(0, np.round(pdf["total_enrolment"] * (1 + g)))
    actual = pdf["target_enrolment"].astype(float)
    assert got["wma"].enrolment_mae == pytest.approx(np.abs(actual - enrol).mean())
    assert got["wma"].enrolment_mape == pytest.approx((np.abs(actual - enrol) / actual.clip(lower=1)).mean() * 100)
    r2 = 1 - ((actual - enrol) ** 2).sum() / ((actual - actual.mean()) ** 2).sum()
    assert got["wma"].enrolment_r2 == pytest.approx(r2)
    gain = learned.relative_change(learned.evaluate(rows)).first()
    want = (got["wma"].enrolment_mae - got["learned"].enrolment_mae) / got["wma"].enrolment_mae * 100
    assert gain.mae_gain_pct == pytest.approx(want)
    assert learned.training_fit(model, train).first()[0] > 0


def test_forecast_is_calibrated_and_complete(trained, sample):
    panel, train, _, model = trained
    rows = learned.learned_forecast(model, panel, train)
    latest = panel.agg(F.max("academic_year")).first()[0]
    base = panel.where(F.col("academic_year") == latest)
    assert rows.count() == 3 * base.count()
    raw = learned.predict(model, base).toPandas()["ml_growth"]
    shift = train.agg(F.avg("target_growth")).first()[0] - raw.mean()
    want = (raw + shift).clip(-0.3, 0.3).mean()
    profile = learned.growth_profile(rows).first()
    assert profile.mean_growth == pytest.approx(want)
    both = learned.compare_forecasts(rows, forecast.wma_forecast(sample)).collect()
    assert len(both) == 3 and all(r.cr_gap_diff == r.ml_cr_gap - r.wma_cr_gap for r in both)
    top = learned.feature_importance(model, panel).collect()
    assert len(top) == 10 and top[0].importance >= top[-1].importance


def test_target_profile(trained):
    panel = trained[0]
    got = learned.target_profile(panel).first()
    x = panel.toPandas()["target_growth"].dropna()
    assert (got["mean"], got["median"], got["std"]) == pytest.approx((x.mean(), x.median(), x.std()))
    assert (got.p5, got.p95) == pytest.approx((x.quantile(0.05), x.quantile(0.95)))


def test_patience():
    assert learned.rounds_to_keep([3, 2, 1, 1, 1, 1], 3, 1e-5) == 6
    assert learned.rounds_to_keep([3, 2, 2.5, 1.9, 2, 2, 2, 1], 3, 1e-5) == 7
    assert learned.rounds_to_keep([3, 2, 1], 3, 1e-5) == 3


def test_early_stop_and_choice_of_loss(trained):
    _, train, _, _ = trained
    settings = learned.BoostingSettings(rounds=6, step=0.9, min_leaf=5, patience=2, loss="squared")
    model = learned.fit(train, settings)
    kept = learned.assembled(learned.with_held_out(train))
    full = learned.fit(train, learned.BoostingSettings(rounds=6, step=0.9, min_leaf=5, loss="squared"))
    errors = full.evaluateEachIteration(kept.where("held_out"), "squared")
    assert model.getNumTrees == learned.rounds_to_keep(errors, 2, 1e-5)
    settings = learned.BoostingSettings(rounds=4, step=0.3, min_leaf=5)
    best = learned.fit_best(train, settings)
    assert best.getNumTrees == 4
    misses = [learned.held_out_miss(learned.fit(train, replace(settings, loss=loss)), train) for loss in ("huber", "absolute", "squared")]
    assert learned.held_out_miss(best, train) == pytest.approx(min(misses))
