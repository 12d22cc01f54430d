"""Enrolment forecast learned with gradient-boosted trees."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.exprs import clamp, ratio
from panelwise.functions.norms import DEFAULT_CATEGORY
from panelwise.functions.windows import by_school, in_year, only, previous
from panelwise.operators.boosting import HuberModel, fit_huber
from panelwise.operators.forecast import (
    GROWTH_CAP,
    HORIZONS,
    base_rows,
    weighted_change,
    with_horizons,
    with_projected_gaps,
)
from panelwise.operators.ordered import exact_percentiles, label_codes, with_code

# The features in order, smallest school in training, volatility cap.
FEATURES = [
    "total_enrolment",
    "enrolment_lag1",
    "enrolment_lag2",
    "growth_rate",
    "growth_rate_lag1",
    "school_category",
    "total_teachers",
    "total_class_rooms",
    "usable_class_rooms",
    "classroom_gap",
    "teacher_gap",
    "risk_score",
    "teacher_deficit_ratio",
    "classroom_deficit_ratio",
    "district_code",
    "management_code",
    "enrolment_3yr_mean",
    "enrolment_volatility",
    "teacher_per_student",
    "rooms_per_student",
]
MIN_TRAIN_ENROLMENT = 10
VOLATILITY_CAP = 500.0
UNKNOWN_LABEL = "UNK"


@dataclass(frozen=True)
class BoostingSettings:
    """Fixed values by default; `rounds` may be lowered for trial runs."""

    rounds: int = 500
    depth: int = 4
    step: float = 0.03
    sample: float = 0.8
    min_leaf: int = 100
    seed: int = 42
    loss: str = "huber"
    patience: int = 30
    tolerance: float = 1e-5


def extract(scored: DataFrame) -> DataFrame:
    """Model panel: school rows with unknown counts and ratios as 0."""
    zero = [
        "total_class_rooms",
        "usable_class_rooms",
        "classroom_gap",
        "risk_score",
        "teacher_deficit_ratio",
        "classroom_deficit_ratio",
        "total_teachers",
        "teacher_gap",
    ]
    return only(scored, "has_school").select(
        "school_id",
        "academic_year",
        "total_enrolment",
        F.coalesce("school_category", F.lit(DEFAULT_CATEGORY)).alias("school_category"),
        "district",
        "management_type",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
    )


# The labels that are coded, by the feature that holds the code.
CODED = {"district_code": "district", "management_code": "management_type"}


def label(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(UNKNOWN_LABEL))


def feature_panel(scored: DataFrame) -> DataFrame:
    """The 20 features, the averaging baseline and the targets, one row per school-year.

    All windows share the school partitioning, so there is one exchange. Codes
    of labels come from a published table (`ordered.label_codes`).
    """
    df = extract(scored)
    codes = label_codes(df, {name: label(column) for name, column in CODED.items()})
    for name, column in CODED.items():
        df = with_code(df, codes, name, label(column), name)
    cur, lag1 = F.col("total_enrolment"), F.col("enrolment_lag1")
    base = F.greatest(lag1, F.lit(1))
    size = F.greatest(cur, F.lit(1))
    last3 = by_school().rowsBetween(-2, Window.currentRow)
    next_value = F.lead("total_enrolment").over(by_school())

    def capped(col) -> Column:
        return clamp(col, -GROWTH_CAP, GROWTH_CAP)

    rows = (
        df.withColumns(
            {
                "enrolment_lag1": previous("total_enrolment", 1),
                "enrolment_lag2": previous("total_enrolment", 2),
                "enrolment_lag3": previous("total_enrolment", 3),
                "_change": weighted_change(),
                "enrolment_3yr_mean": F.avg("total_enrolment").over(last3),
                "_spread": F.stddev_samp("total_enrolment").over(last3),
                "target_enrolment": next_value,
                "target_year": F.lead("academic_year").over(by_school()),
            }
        )
        .withColumns(
            {
                "growth_rate": F.when(lag1.isNotNull(), capped(ratio(cur - lag1, base))),
                "wma_growth": F.when(lag1.isNotNull(), capped(ratio(F.col("_change"), base * 6))),
                "enrolment_volatility": F.least(F.coalesce("_spread", F.lit(0.0)), F.lit(VOLATILITY_CAP)),
                "teacher_per_student": F.when(cur.isNotNull(), ratio("total_teachers", size)),
                "rooms_per_student": F.when(cur.isNotNull(), ratio("usable_class_rooms", size)),
                "target_growth": F.when(cur.isNotNull(), capped(ratio(F.col("target_enrolment") - cur, size))),
            }
        )
        .withColumn("growth_rate_lag1", previous("growth_rate"))
        .drop("_change", "_spread")
    )
    return rows.select(
        "school_id",
        "academic_year",
        "district",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES],
        "wma_growth",
        "target_growth",
        "target_enrolment",
        "target_year",
    )


def target_profile(panel: DataFrame) -> DataFrame:
    """One row: mean, median, standard deviation, 5th and 95th percentile of the target."""
    rows = panel.where(F.col("target_growth").isNotNull())
    marks = exact_percentiles(rows, [], "target_growth", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    moments = rows.agg(F.struct(F.avg("target_growth").alias("mean"), F.stddev_samp("target_growth").alias("std"))).scalar()
    return marks.select(
        moments["mean"].alias("mean"),
        moments["std"].alias("std"),
        "p5",
        "median",
        "p95",
    )


def _years(panel: DataFrame) -> Column:
    """Sorted years of the panel as one scalar array."""
    return panel.agg(F.sort_array(F.collect_set("academic_year"))).scalar()


def split(panel: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test). Test rows come from the second-latest year.

    With `strict`, training rows whose target lies in the latest year are left
    out too (a school that skipped the test year would leak it).
    """
    test_year = F.try_element_at(_years(panel), F.lit(-2))
    latest = F.try_element_at(_years(panel), F.lit(-1))
    labelled = panel.where(F.col("target_growth").isNotNull())
    train = labelled.where(
        (F.col("academic_year") != test_year) & (F.col("total_enrolment") >= MIN_TRAIN_ENROLMENT)
    )
    if strict:
        train = train.where(F.col("target_year") != latest)
    return train, labelled.where(F.col("academic_year") == test_year)


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def with_held_out(train: DataFrame) -> DataFrame:
    """Mark a tenth of the rows, chosen by a hash of their key."""
    return train.withColumn("held_out", F.pmod(F.xxhash64("school_id", "academic_year"), F.lit(10)) == 0)


def rounds_to_keep(errors: list[float], patience: int, tolerance: float) -> int:
    """Rounds until `patience` of them in a row brought no improvement of at least `tolerance`."""
    best, since = float("inf"), 0
    for n, error in enumerate(errors, start=1):
        since = 0 if error < best - tolerance else since + 1
        best = min(best, error) if since == 0 else best
        if since >= patience:
            return n
    return len(errors)


def fit(train: DataFrame, settings: BoostingSettings = BoostingSettings()) -> GBTRegressionModel | HuberModel:
    """Boosted trees, stopped early on held-out rows: with Huber loss, or with one of MLlib's losses.

    MLlib's built-in early stop ends at the first round without improvement. To
    allow a patience there, all rounds are fitted, the held-out error of each
    prefix is read off, and if a shorter run is enough it is fitted again; with
    the same seed its trees are those of the prefix.
    """
    rows = assembled(with_held_out(train))
    if settings.loss == "huber":
        keyed = rows.withColumn("_key", F.xxhash64("school_id", "academic_year"))
        return fit_huber(keyed, FEATURES, "target_growth", settings)
    marked = rows.select("features", "target_growth", "held_out")
    kept, held = marked.where(~F.col("held_out")), marked.where("held_out")
    booster = _booster(settings)
    model = booster.fit(kept)
    if settings.rounds <= settings.patience:
        return model
    errors = model.evaluateEachIteration(held, settings.loss)
    enough = rounds_to_keep(errors, settings.patience, settings.tolerance)
    return model if enough >= settings.rounds else booster.setMaxIter(enough).fit(kept)


def _booster(settings: BoostingSettings) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features",
        labelCol="target_growth",
        predictionCol="prediction",
        maxIter=settings.rounds,
        maxDepth=settings.depth,
        stepSize=settings.step,
        subsamplingRate=settings.sample,
        minInstancesPerNode=settings.min_leaf,
        seed=settings.seed,
        lossType=settings.loss,
    )


def fit_best(
    train: DataFrame, settings: BoostingSettings = BoostingSettings(), losses=("huber", "absolute", "squared")
) -> GBTRegressionModel | HuberModel:
    """Fit one model per loss and keep the one with the smallest held-out absolute error."""
    return min((fit(train, replace(settings, loss=loss)) for loss in losses), key=lambda model: held_out_miss(model, train))


def held_out_miss(model: GBTRegressionModel | HuberModel, train: DataFrame) -> float:
    """Mean absolute error on the held-out tenth of the training rows."""
    rows = predict(model, with_held_out(train).where("held_out"))
    return rows.agg(F.avg(F.abs(F.col("target_growth") - F.col("ml_growth")))).first()[0]


def training_rounds(model: HuberModel, like: DataFrame) -> DataFrame:
    """Per round: delta, held-out loss and held-out absolute error (numbers that the model holds)."""
    rows = [(i, *map(float, x)) for i, x in enumerate(zip(model.deltas, model.losses, model.misses), start=1)]
    return like.sparkSession.createDataFrame(rows, "round int, delta double, held_out_loss double, held_out_mae double")


def predict(model: GBTRegressionModel | HuberModel, rows: DataFrame, as_name: str = "ml_growth") -> DataFrame:
    if isinstance(model, HuberModel):
        return rows.withColumn(as_name, model.prediction())
    return model.transform(assembled(rows)).withColumnRenamed("prediction", as_name).drop("features")


def _quality(actual, guess) -> tuple[Column, Column]:
    """(R2, MAE)"""
    error = F.sum((actual - guess) * (actual - guess))
    spread = F.var_pop(actual) * F.count(actual)
    return F.lit(1.0) - ratio(error, spread), F.avg(F.abs(actual - guess))


def evaluate(predicted: DataFrame) -> DataFrame:
    """Model against the averaging baseline, one row per method, in one pass.

    `predicted` are test rows with ml_growth.
    """
    methods = F.array(
        F.struct(F.lit("learned").alias("method"), F.col("ml_growth").alias("_g")),
        F.struct(F.lit("wma").alias("method"), F.coalesce("wma_growth", F.lit(0.0)).alias("_g")),
    )
    rows = (
        predicted.select("total_enrolment", "target_enrolment", "target_growth", F.inline(methods))
        .withColumn("_g", clamp("_g", -GROWTH_CAP, GROWTH_CAP))
        .withColumn("_e", F.greatest(F.lit(0.0), F.rint(F.col("total_enrolment") * (F.col("_g") + 1))))
    )
    growth_r2, growth_mae = _quality(F.col("target_growth"), F.col("_g"))
    enrol_r2, enrol_mae = _quality(F.col("target_enrolment").cast("double"), F.col("_e"))
    miss = F.abs(F.col("target_enrolment") - F.col("_e")) / F.greatest("target_enrolment", F.lit(1))
    return rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("rows"),
        growth_r2.alias("growth_r2"),
        growth_mae.alias("growth_mae"),
        enrol_r2.alias("enrolment_r2"),
        enrol_mae.alias("enrolment_mae"),
        (F.avg(miss) * 100).alias("enrolment_mape"),
    )


def training_fit(model: GBTRegressionModel | HuberModel, train: DataFrame) -> DataFrame:
    """One row: R2 of the clipped growth on the training rows."""
    rows = predict(model, train).withColumn("_g", clamp("ml_growth", -GROWTH_CAP, GROWTH_CAP))
    return rows.agg(_quality(F.col("target_growth"), F.col("_g"))[0].alias("growth_r2_train"))


def relative_change(evaluation: DataFrame) -> DataFrame:
    """One row: how much lower the learned errors are, in percent of the baseline's."""

    def of(method: str, metric: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col(metric)))

    def gain(metric: str) -> Column:
        return ratio(of("wma", metric) - of("learned", metric), of("wma", metric)) * 100

    return evaluation.agg(
        gain("enrolment_mae").alias("mae_gain_pct"), gain("enrolment_mape").alias("mape_gain_pct")
    )


def feature_importance(model: GBTRegressionModel | HuberModel, like: DataFrame, k: int = 10) -> DataFrame:
    """Top features (20 numbers held by the model)."""
    pairs = sorted(zip(FEATURES, model.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))[:k]
    return like.sparkSession.createDataFrame(
        [(name, float(value)) for name, value in pairs], "feature string, importance double"
    )


def learned_forecast(
    model: GBTRegressionModel | HuberModel, panel: DataFrame, train: DataFrame, horizons=HORIZONS, version: str = "v1.0"
) -> DataFrame:
    """Forecast rows from the latest year, by a trained model."""
    return forecast_from(predict(model, in_year(panel)), train, horizons, version)


def forecast_from(base: DataFrame, train: DataFrame, horizons=HORIZONS, version: str = "v1.0") -> DataFrame:
    """Forecast rows from base rows with their predicted `ml_growth`, whatever predicted it.

    One growth per school, shifted so that the mean equals the training
    target's, clipped, then compounded. Both means are scalar subqueries.
    """
    shift = train.agg(F.avg("target_growth")).scalar() - base.agg(F.avg("ml_growth")).scalar()
    growth = clamp(F.col("ml_growth") + shift, -GROWTH_CAP, GROWTH_CAP)
    rows = base.withColumn("ml_growth_rate", growth)
    counts = ("total_enrolment", "usable_class_rooms", "total_teachers", "school_category")
    rows = rows.withColumns({c: F.col(c).cast("int") for c in counts})
    return (
        base_rows(rows, "ml_growth_rate")
        .transform(with_horizons, "ml_growth_rate", horizons)
        .transform(with_projected_gaps, False)
        .withColumn("model_version", F.lit(version))
    )


def compare_forecasts(learned: DataFrame, averaged: DataFrame) -> DataFrame:
    """Gap sums of both forecasts per horizon, and their differences."""

    def sums(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("years_ahead").agg(
            F.sum("projected_classroom_gap").alias(f"{tag}_cr_gap"),
            F.sum("projected_teacher_gap").alias(f"{tag}_tr_gap"),
        )

    both = sums(averaged, "wma").join(sums(learned, "ml"), "years_ahead", "left")
    return both.withColumns(
        {
            "cr_gap_diff": F.col("ml_cr_gap") - F.col("wma_cr_gap"),
            "tr_gap_diff": F.col("ml_tr_gap") - F.col("wma_tr_gap"),
        }
    )


def growth_profile(forecast: DataFrame, growth: str = "ml_growth_rate") -> DataFrame:
    """One row: schools, mean and median growth."""
    rows = forecast.where(F.col("years_ahead") == 1)
    moments = rows.agg(F.struct(F.count(F.lit(1)).alias("schools"), F.avg(growth).alias("mean_growth"))).scalar()
    return exact_percentiles(rows, [], growth, {"median_growth": 0.5}).select(
        moments["schools"].alias("schools"),
        moments["mean_growth"].alias("mean_growth"),
        "median_growth",
    )
