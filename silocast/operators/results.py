"""Stored predictions and re-evaluation at other horizons and sites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silocast.operators import forecast as fc


class ResultStore:
    """Predictions as Parquet in folders by model and horizon. Writing one of
    them replaces that folder and no other; reading one lists its files only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, model: str, horizon: int) -> None:
        named = rows.withColumns({"model": F.lit(model), "horizon": F.lit(horizon)})
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("model", "horizon").parquet(self.path)

    def get(self, model: str, horizon: int) -> DataFrame | None:
        """The stored rows, or None where nothing was stored. Later results may
        have other columns; absent ones are null."""
        try:
            rows = self.spark.read.option("mergeSchema", True).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        rows = rows.where((F.col("model").cast("string") == model) & (F.col("horizon") == horizon))
        return None if rows.isEmpty() else rows.withColumn("model", F.lit(model))


def evaluate_horizon(df: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame], horizon: int) -> DataFrame:
    """The last ``horizon`` days of ``df`` predicted from the days before, with
    their actual values (``is_forecast`` false), and rows of days to come for
    the day numbers that no reading has (true): all of them where ``df`` is too
    short to be split."""
    train, held = fc.split(df, horizon)
    more = fc.fill_missing_days(held, train, horizon)
    out = predict(train, held).withColumn("is_forecast", F.lit(False))
    return out.unionByName(predict(train, more).withColumn("is_forecast", F.lit(True)), allowMissingColumns=True)


def reevaluate(
    store: ResultStore, model: str, df: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame], horizon: int,
    granary: str | None = None, heap: str | None = None,
) -> DataFrame:
    """The rows of ``evaluate_horizon`` of one warehouse and silo. They are
    worked out for all sites and stored the first time; another site of the
    same horizon is then a filter. Filling comes before the filter, so rows of
    days to come are of the site that was asked for."""
    rows = store.get(model, horizon)
    if rows is None:
        store.put(evaluate_horizon(df, predict, horizon), model, horizon)
        rows = store.get(model, horizon)
        if rows is None:  # no row at all
            return fc.filter_site(evaluate_horizon(df, predict, horizon), granary, heap)
    return fc.filter_site(rows, granary, heap)


def reevaluation_report(rows: DataFrame) -> DataFrame:
    """Per horizon and forecast day: actual and filled rows, their mean
    prediction and the error of the actual ones."""
    a, p = F.col("temperature_grain"), F.col("predicted_temp")
    return rows.groupBy("horizon", "forecast_day").agg(
        F.count_if(~F.col("is_forecast")).alias("n_actual"), F.count_if("is_forecast").alias("n_filled"),
        F.avg(p).alias("pred_mean"), F.avg(F.abs(a - p)).alias("mae"),
    )
