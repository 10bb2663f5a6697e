"""Splits by date, summaries, metrics, alerts and future frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silocast.functions.features import spatial_features, time_features

#: Alert thresholds by grain type, and the default.
THRESHOLDS = {
    "Mid-to-late indica rice": 28.0, "Early indica rice": 28.0, "Japonica rice": 26.0,
    "Yellow corn": 30.0, "Soybeans": 25.0, "Wheat": 27.0,
}
DEFAULT_THRESHOLD = 28.0


def evaluation_days(df: DataFrame, horizon: int = 5) -> DataFrame:
    """(day, forecast_day) of the last ``horizon`` distinct days; none where
    there are at most ``horizon`` + 1 days. One row per day, not per reading."""
    days = df.select(F.to_date("detection_time").alias("day")).na.drop().distinct()
    w = Window.orderBy(F.desc("day"))
    days = days.select("day", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    return days.where((F.col("r") <= horizon) & (F.col("n") > horizon + 1)).select(
        "day", (F.lit(horizon + 1) - F.col("r")).cast("int").alias("forecast_day")
    )


def split(df: DataFrame, horizon: int = 5) -> tuple[DataFrame, DataFrame]:
    """(training rows, evaluation rows with forecast_day). The days are found
    by one job, and are ``horizon`` at most; both parts are filters then."""
    numbers = {r["day"]: r["forecast_day"] for r in evaluation_days(df, horizon).collect()}
    day = F.to_date("detection_time")
    if not numbers:
        return df, df.where("false").withColumn("forecast_day", F.lit(None).cast("int"))
    held = F.coalesce(day.isin(*numbers), F.lit(False))
    of = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return df.where(~held), df.where(held).withColumn("forecast_day", F.try_element_at(of, day))


def mean_predictor(train: DataFrame, rows: DataFrame, by: list[str] = ("heap_id",)) -> DataFrame:
    """predicted_temp: the mean training temperature of the rows that are equal
    in ``by``."""
    means = train.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.avg("temperature_grain").alias("predicted_temp"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(means, on, "left").drop(*[f"_{c}" for c in by])


def prediction_frame(train: DataFrame, evaluated: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows under one set of columns: training and evaluation rows with
    ``is_forecast`` false, frames of gaps and of days to come with true."""
    out = evaluated.withColumn("is_forecast", F.lit(False)).unionByName(train.withColumn("is_forecast", F.lit(False)), allowMissingColumns=True)
    for df in more:
        out = out.unionByName(df.withColumn("is_forecast", F.lit(True)), allowMissingColumns=True)
    return out


def filter_site(df: DataFrame, granary: str | None = None, heap: str | None = None) -> DataFrame:
    """Rows of one warehouse and silo; None stands for all. Export names are
    used where the canonical columns are absent."""
    for names, value in ((("granary_id", "storepointName"), granary), (("heap_id", "storeName"), heap)):
        column = next((c for c in names if c in df.columns), None)
        if value is not None and column:
            df = df.where(F.col(column) == value)
    return df


# ------------------------------------------------------------------ metrics


def _both(value):
    """``value`` where actual and prediction are there."""
    return F.when(F.col("temperature_grain").isNotNull() & F.col("predicted_temp").isNotNull(), value)


def _confidence():
    """R2 as a percentage from 0 to 100; null for fewer than two rows."""
    a, p = F.col("temperature_grain"), F.col("predicted_temp")
    n, left, spread = F.count(_both(a)), F.sum(_both((a - p) * (a - p))), F.var_pop(_both(a))
    score = F.when(spread == 0, F.when(left == 0, 1.0).otherwise(0.0)).otherwise(1 - left / (spread * n))
    return F.when(n > 1, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * score)))


def forecast_summary(df: DataFrame) -> DataFrame:
    """Per forecast_day: means, percentage error and R2 confidence, in one
    aggregation."""
    g = df.groupBy("forecast_day").agg(
        F.avg("temperature_grain").alias("actual_mean"), F.avg("predicted_temp").alias("pred_mean"),
        _confidence().alias("confidence_pct"),
    )
    off = F.abs(F.try_divide(F.col("pred_mean") - F.col("actual_mean"), F.col("actual_mean")))
    return g.select("forecast_day", "actual_mean", "pred_mean", (100 * off).alias("pct_error"), "confidence_pct")


def overall_metrics(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Confidence, accuracy, RMSE, MAE, MAPE and the number of rows with both
    values, per ``by``. The error share divides by the actual itself, zero
    actuals left out; without any other, accuracy and MAPE are null."""
    a, p = F.col("temperature_grain"), F.col("predicted_temp")
    share = F.avg(F.try_divide(F.abs(a - p), a))
    return df.groupBy(*by).agg(
        _confidence().alias("confidence"), F.when(share.isNotNull(), F.greatest(F.lit(0.0), 100 - 100 * share)).alias("accuracy"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"), (100 * share).alias("mape"),
        F.count(_both(a)).alias("n"),
    )


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models ranked by confidence, then accuracy, missing last; one row each."""
    w = Window.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("accuracy"), "model")
    return metrics.select(F.row_number().over(w).alias("rank"), "model", "confidence", "accuracy", "rmse", "mae")


def threshold_table(df: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(grain, threshold), one row per grain type."""
    return df.sparkSession.createDataFrame(list(thresholds.items()), "grain string, threshold double")


def alerts(df: DataFrame, thresholds: dict[str, float] = THRESHOLDS, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Rows whose predicted_temp reaches the threshold of their grain type."""
    limits = F.broadcast(threshold_table(df, thresholds))  # one row per grain type
    out = df.join(limits, F.col("grain_type") == F.col("grain"), "left").drop("grain")
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(default))).where("predicted_temp >= threshold")


def alert_any(df: DataFrame, thresholds: dict[str, float] = THRESHOLDS, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Per silo whether any row reaches its threshold, and how many do."""
    limits = F.broadcast(threshold_table(df, thresholds))
    out = df.join(limits, F.col("grain_type") == F.col("grain"), "left")
    flag = F.coalesce(F.col("predicted_temp") >= F.coalesce("threshold", F.lit(default)), F.lit(False))
    return out.groupBy("granary_id", "heap_id").agg(F.bool_or(flag).alias("alert"), F.count_if(flag).alias("n_alerts"))


# ------------------------------------------------------------- daily series


def daily_series(df: DataFrame, value: str = "temperature_grain") -> DataFrame:
    return df.groupBy(F.to_date("detection_time").alias("day")).agg(F.avg(value).alias("mean_temp"), F.count(value).alias("n"))


def split_series(df: DataFrame) -> DataFrame:
    """(day, series, mean_temp): daily means of actual values, and of
    predictions up to the last day with an actual value (eval) or after it
    (future)."""
    last = df.agg(F.max(F.when(F.col("temperature_grain").isNotNull(), F.to_date("detection_time"))).alias("_last"))
    day = F.to_date("detection_time").alias("day")
    actual = df.where("temperature_grain is not null").groupBy(day).agg(F.avg("temperature_grain").alias("mean_temp"))
    pred = df.where("predicted_temp is not null").groupBy(day).agg(F.avg("predicted_temp").alias("mean_temp"))
    pred = pred.crossJoin(F.broadcast(last))  # one row
    kind = F.when(F.col("_last").isNull() | (F.col("day") > F.col("_last")), "future").otherwise("eval")
    return actual.select("day", F.lit("actual").alias("series"), "mean_temp").union(pred.select("day", kind, "mean_temp"))


def future_summary(df: DataFrame) -> DataFrame:
    """Per forecast_day the mean, highest and lowest prediction."""
    p = "predicted_temp"
    return df.groupBy("forecast_day").agg(F.avg(p).alias("pred_mean"), F.max(p).alias("pred_max"), F.min(p).alias("pred_min"))


def prediction_stats(df: DataFrame) -> DataFrame:
    p = "predicted_temp"
    return df.agg(F.min(p).alias("pred_min"), F.avg(p).alias("pred_mean"), F.max(p).alias("pred_max"))


def feature_drift(before: DataFrame, after: DataFrame, features: list[str], top: int = 20) -> DataFrame:
    """(feature, abs_diff): the ``top`` features by the difference of means."""
    def means(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.avg(c).alias(c) for c in features])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(name)) for c in features])).alias("x")).select("x.*")

    both = means(before, "a").join(means(after, "b"), "feature")
    return both.select("feature", F.abs(F.col("a") - F.col("b")).alias("abs_diff")).orderBy(F.desc_nulls_last("abs_diff"), "feature").limit(top)


def grid_snapshot(df: DataFrame, day: int) -> DataFrame:
    """Per row of forecast day ``day``: position, the value to colour by
    (predicted, else actual), the signed difference and a label. Nothing where
    a needed column is absent."""
    needed = ("grid_x", "grid_y", "grid_z", "forecast_day")
    pred, actual = (F.col(c) if c in df.columns else F.lit(None).cast("double") for c in ("predicted_temp", "temperature_grain"))
    keep = [c for c in ("row_id", "granary_id", "heap_id") if c in df.columns]
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10  # noqa: E731  half up, as text and as a number
    diff = pred - actual
    label = F.concat_ws(" | ", F.concat(F.lit("Pred "), F.format_string("%.1f", tenth(pred))) if "predicted_temp" in df.columns else F.lit(None),
                        F.when(actual.isNotNull(), F.concat(F.lit("Actual "), F.format_string("%.1f", tenth(actual)))),
                        F.when(diff.isNotNull(), F.concat(F.lit("Δ "), F.format_string("%+.1f", tenth(diff)))))
    if not set(needed) <= set(df.columns):
        return df.sparkSession.createDataFrame([], "grid_x int, grid_y int, grid_z int, value double, diff double, label string")
    return df.where(F.col("forecast_day") == day).select(
        *keep, "grid_x", "grid_y", "grid_z", F.coalesce(pred, actual).alias("value"), diff.alias("diff"), label.alias("label")
    )


# ----------------------------------------------------- frames of other days

PROBE = ("granary_id", "heap_id", "grid_x", "grid_y", "grid_z")
CONSTANTS = ("grain_type", "warehouse_type")


def _featured(df: DataFrame) -> DataFrame:
    return spatial_features(time_features(df)).withColumn("temperature_grain", F.lit(None).cast("double"))


def make_future(df: DataFrame, horizon: int = 7, constants: str = "global") -> DataFrame:
    """Every probe on each of the ``horizon`` days after the latest reading of
    all, with its features and no temperature. grain_type and warehouse_type
    are the first values seen by time, of all rows or ``per_silo``; the
    detection cycle goes on. An empty frame gives an empty one."""
    keys = [c for c in PROBE if c in df.columns]
    fixed = [c for c in CONSTANTS if c in df.columns]
    order = F.struct(*[c for c in ("detection_time", "row_id") if c in df.columns])
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fixed]
    last = [F.max("detection_time").alias("_last")] + [F.max(c).alias("_cycle") for c in ("detection_cycle",) if c in df.columns]
    probes = df.select(*keys).distinct()
    if constants == "per_silo" and fixed:
        silo = [c for c in ("granary_id", "heap_id") if c in df.columns]
        values = df.groupBy(*[F.col(c).alias(f"_{c}") for c in silo]).agg(*first)
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in silo]
        probes = probes.join(values, on, "left").drop(*[f"_{c}" for c in silo])
        first = []
    one = df.agg(*last, *first)  # one row
    days = df.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias("forecast_day"))
    out = probes.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(days))
    out = out.withColumn("detection_time", F.col("_last") + F.make_dt_interval("forecast_day"))
    if "detection_cycle" in df.columns:
        out = out.withColumn("detection_cycle", F.col("_cycle") + F.col("forecast_day"))
    return _featured(out.drop("_last", "_cycle"))


def gap_fill(train: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Every probe of ``train`` on each calendar day that is absent between the
    first and the last day of ``evaluated``; forecast_day counts calendar days
    from the first."""
    keys = [c for c in PROBE if c in train.columns]
    days = evaluated.select(F.to_date("detection_time").alias("day")).distinct()
    ends = days.agg(F.min("day").alias("_a"), F.max("day").alias("_b")).where("_a is not null")
    every = ends.select("_a", F.explode(F.sequence("_a", "_b")).alias("day"))
    missing = every.join(days, "day", "left_anti").select(
        F.col("day").cast("timestamp_ntz").alias("detection_time"), (F.datediff("day", "_a") + 1).cast("int").alias("forecast_day")
    )
    # one row per calendar day of the evaluated span, which the horizon bounds
    return _featured(train.select(*keys).distinct().crossJoin(F.broadcast(missing)))


def evaluated_with_gaps(
    train: DataFrame, held: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """Training rows, predicted evaluation rows and predicted rows of the
    calendar days between them without readings, in one frame; ``is_forecast``
    is true for the last. ``forecast_day`` of a reading is the rank of its day
    among the days that have readings, that of a gap counts calendar days;
    ``eval_offset_days`` counts calendar days for both, so it names one date."""
    day = F.to_date("detection_time")
    first = held.agg(F.min(day).alias("_first_day"))  # one row
    offset = (F.datediff(day, "_first_day") + 1).cast("int")
    own = held.crossJoin(F.broadcast(first)).withColumn("eval_offset_days", offset).drop("_first_day")
    gaps = gap_fill(train, held).withColumn("eval_offset_days", F.col("forecast_day"))
    return prediction_frame(train, predict(train, own), predict(train, gaps))


def fill_missing_days(evaluated: DataFrame, train: DataFrame, horizon: int = 5) -> DataFrame:
    """Future rows of ``train`` for the day numbers from 1 to ``horizon`` that
    ``evaluated`` has no row of."""
    have = evaluated.select("forecast_day").distinct()
    return make_future(train, horizon).join(have, "forecast_day", "left_anti")
