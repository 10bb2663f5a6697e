"""Re-evaluation with a result store, gaps in the calendar, boosting and folds."""

import datetime

import pytest
from pyspark.sql import functions as F

from silocast.operators import forecast as fc
from silocast.operators import models as md
from silocast.operators import results as rs
from silocast.operators.ordering import assign_folds

START = datetime.datetime(2024, 3, 1, 6)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Twelve days, of which the tenth has no reading, two silos."""
    data = [(i, START + datetime.timedelta(days=d, hours=h), g, f"{g}-H0", 0, 0, z, 10.0 + z + h / 10, "Wheat")
            for i, (d, h, g, z) in enumerate((d, h, g, z) for d in range(12) if d != 9 for h in range(10) for g in ("G0", "G1") for z in (0, 1))]
    schema = ("row_id long, detection_time timestamp_ntz, granary_id string, heap_id string, grid_x int, grid_y int, grid_z int, "
              "temperature_grain double, grain_type string")  # fmt: skip
    path = f"file://{tmp_path_factory.mktemp('rows')}/rows"
    spark.createDataFrame(data, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_a_stored_horizon_is_not_computed_again(spark, rows, tmp_path):
    store, calls = rs.ResultStore(spark, f"file://{tmp_path}/results"), []

    def predict(train, part):
        calls.append(1)
        return fc.mean_predictor(train, part)

    assert store.get("mean", 4) is None
    first = rs.reevaluate(store, "mean", rows, predict, 4, "G0")
    n = len(calls)
    other = rs.reevaluate(store, "mean", rows, predict, 4, "G1", "G1-H0")
    assert len(calls) == n and {r.granary_id for r in other.collect()} == {"G1"} and first.count() == other.count() == 4 * 20
    long = rs.reevaluate(store, "mean", rows, predict, 20, "G1")  # too long to split: days to come, of that site only
    assert len(calls) > n and {(r.granary_id, r.is_forecast) for r in long.select("granary_id", "is_forecast").collect()} == {("G1", True)}
    assert long.select("forecast_day").distinct().count() == 20 and store.get("mean", 4).count() == 160
    report = {(r.horizon, r.forecast_day): r for r in rs.reevaluation_report(other.unionByName(long, allowMissingColumns=True)).collect()}
    assert report[4, 1].n_actual == 20 and report[20, 1].n_filled == 2 and report[20, 1].mae is None


def test_gap_days_are_predicted_by_the_model(spark, rows, tmp_path):
    train, held = fc.split(rows, 4)
    model = md.train(md.prepare(train), "rf", n_trees=2, maxDepth=3, measure=False)
    out = fc.evaluated_with_gaps(train, held, md.predictor(model)).where("eval_offset_days is not null")
    days = {r.eval_offset_days: (r.forecast_day, r.is_forecast, r.n) for r in out.groupBy("eval_offset_days", "forecast_day", "is_forecast").agg(F.count("predicted_temp").alias("n")).collect()}
    assert days == {1: (1, False, 40), 2: (2, False, 40), 3: (3, True, 4), 4: (3, False, 40), 5: (4, False, 40)}
    store = rs.ResultStore(spark, f"file://{tmp_path}/kept")
    got = md.evaluate({"a": model}, rows, 4, store).first()
    assert got.n == 160 and got.mae < 1 and store.get("a", 4).where("is_forecast").count() == 4


def test_boosting_stops_early(rows):
    ready = md.prepare(rows)
    full = md.train(ready, "gb", n_trees=30, maxDepth=2, measure=False)
    short = md.train(ready, "hgb", n_trees=60, maxDepth=3, measure=False)
    assert full.meta["trees"] == 30 and not full.meta["early_stop"]
    assert short.meta["trees"] < 60 and short.meta["early_stop"] and md.errors(short.predict(ready))["mae"] < 0.5


@pytest.mark.parametrize("at_once", [1, 4])
def test_folds_equal_single_fits(rows, at_once):
    ready = md.prepare(rows)
    found = md.time_series_cv(ready, "gb", n_trees=3, n_splits=3, at_once=at_once, maxDepth=2)
    key = lambda df: sorted((r.row_id, round(r.predicted_temp, 9)) for r in df.collect())
    alone = []
    folds = assign_folds(ready, ["detection_time", "row_id"], 3)
    design = md._design(folds, ["row_index", "fold", "row_id"])
    for f in (1, 2, 3):
        first = folds.where(F.col("fold") == f).agg(F.min("row_index")).first()[0]
        learned = design.fit(design.data.where(F.col("row_index") < first), "gb", 3, {"maxDepth": 2})
        alone += key(learned.transform(design.data.where(F.col("fold") == f)).withColumnRenamed("prediction", "predicted_temp"))
    assert key(found.predictions) == sorted(alone) and len(alone) == 3 * (440 // 4)
    pooled = md.errors(found.predictions)
    assert found.errors == pooled and md.errors(found.model.predict(ready))["mae"] < 1


def test_too_few_rows_for_folds(rows):
    found = md.time_series_cv(md.prepare(rows.limit(4)), "gb", n_trees=2, n_splits=5)
    assert found.predictions.count() == 0 and found.model is None and found.errors == {"mae": None, "rmse": None}
