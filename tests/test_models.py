"""Models on a small learnable frame, and the registered model queries."""

import datetime
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from silocast.operators import forecast as fc
from silocast.operators import models as md
from silocast.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def learnable(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    start, rows = datetime.datetime(2024, 3, 1), []
    for i in range(1200):
        at, heap, x = start + datetime.timedelta(hours=i), f"H{i % 3}", i % 4
        grain = ("Wheat", "Soybeans", None)[i % 3]
        t = 15 + 5 * (i % 3) + 2 * x + 0.3 * (i % 24) + float(rng.normal(0, 0.2))
        rows.append((i, at, "G1", heap, x, 0, 0, t, 20.0 + x, grain, "flat"))
    schema = ("row_id long, detection_time timestamp_ntz, granary_id string, heap_id string, grid_x int, grid_y int, grid_z int, "
              "temperature_grain double, temperature_inside double, grain_type string, warehouse_type string")  # fmt: skip
    path = f"file://{tmp_path_factory.mktemp('rows')}/prepared"
    md.prepare(spark.createDataFrame(rows, schema).coalesce(1)).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("algo, n_trees", [("rf", 5), ("hgb", 3), ("lgbm", 3)])
def test_better_than_the_mean(learnable, algo, n_trees):
    train, held = fc.split(learnable)
    model = md.train(train, algo, n_trees=n_trees, maxDepth=5, measure=algo != "hgb")
    mean = fc.overall_metrics(fc.mean_predictor(train, held.withColumn("one", held.row_id * 0), ["warehouse_type"])).first()
    assert md.errors(model.predict(held))["mae"] < 0.6 * mean.mae
    assert model.meta.get("measured") in ("last_rows", "in_sample", None)


def test_saved_model_predicts_alike(spark, learnable, tmp_path):
    train, held = fc.split(learnable)
    model = md.train(train, "rf", n_trees=5, future_safe=True)
    assert "temperature_inside" not in model.features
    name = md.save_model(model, f"file://{tmp_path}/own", md.model_name("My Data", "rf", 5, True))
    assert name == "my_data_fs_rf_5" and md.load_model(spark, "none", f"file://{tmp_path}/own") is None
    again = md.load_model(spark, name, f"file://{tmp_path}/absent", f"file://{tmp_path}/own")
    key = lambda df: sorted((r.row_id, r.predicted_temp) for r in df.collect())
    unseen = held.withColumn("grain_type", held.warehouse_type).drop("grid_y")  # an unseen category, an absent column
    assert key(again.predict(held)) == key(model.predict(held)) and again.predict(unseen).count() == held.count()
    assert [r.name for r in md.list_models(spark, f"file://{tmp_path}/own", f"file://{tmp_path}/absent").collect()] == [name]


def test_folds_train_on_the_past(learnable):
    out = md.cross_validate(learnable, "rf", n_trees=2, n_splits=4, maxDepth=3)
    got = {r.fold: r["count"] for r in out.groupBy("fold").count().collect()}
    assert got == {f: 1200 // 5 for f in range(1, 5)}


def test_cross_validation_metrics_boost_all_trees(spark, monkeypatch):
    """The query asks for the operator's own number of trees, in each fold and for all rows."""
    asked, make = [], md.regressor

    def few(algo, n_trees, **params):
        asked.append((algo, n_trees, params))
        return make(algo, 2, maxDepth=2)

    monkeypatch.setattr(md, "regressor", few)
    got = catalog.QUERIES["time_series_cv_metrics"](spark, SF).first()
    assert asked == [("gb", 300, {})] * (md.SPLITS + 1) and (got.n, got.trees) == (830, 2)


def test_large_fits_run_one_by_one(learnable, monkeypatch):
    """Fits with tasks enough for all cores are not held in memory side by side."""
    lock, now, seen, make = threading.Lock(), [0], [], md.regressor

    class Learner:
        def fit(self, rows):
            with lock:
                now[0] += 1
                seen.append((rows.count(), now[0]))
            try:
                return make("gb", 1, maxDepth=1).fit(rows)
            finally:
                with lock:
                    now[0] -= 1

    monkeypatch.setattr(md, "TASK_ROWS", 100)
    monkeypatch.setattr(md, "CORE_TASKS", 1)
    monkeypatch.setattr(md, "regressor", lambda *a, **k: Learner())
    md.time_series_cv(learnable, "gb", 1, n_splits=2)
    assert seen == [(1200, 1), (800, 1), (400, 1)]


def test_a_task_holds_few_rows(learnable, monkeypatch):
    """A learner gets its rows in even partitions, whatever files they come from."""
    seen = []

    class Learner:
        def fit(self, rows):
            seen.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])

    monkeypatch.setattr(md, "TASK_ROWS", 100)
    monkeypatch.setattr(md, "regressor", lambda *a, **k: Learner())
    for keep in (["row_index"], []):
        design = md._design(md.with_row_index(learnable, ["detection_time"]).coalesce(1), keep)
        design.fit(design.data, "lgbm", 1, {})
    assert all(sum(x) == 1200 and max(x) <= 150 for x in seen), seen


def test_boosting_without_a_stop_sorts_nothing(learnable, monkeypatch):
    """Only rows that are set apart by time need their place in it."""
    sorted_ = []
    index = md.with_row_index
    monkeypatch.setattr(md, "with_row_index", lambda *a, **k: sorted_.append(a) or index(*a, **k))
    md.train(learnable, "lgbm", n_trees=1, maxDepth=2, measure=False)
    assert not sorted_
    md.train(learnable, "lgbm", n_trees=1, maxDepth=2, measure=False, early_stop=True)
    assert len(sorted_) == 1


def test_metrics_are_those_of_the_whole_frame(learnable):
    """Leaving out rows without prediction or temperature changes no metric."""
    rows = learnable.where("dayofmonth(detection_time) % 7 <> 0")
    train, held = fc.split(rows)
    model = md.train(train, "lgbm", n_trees=2, maxDepth=3, measure=False)
    whole = fc.overall_metrics(fc.evaluated_with_gaps(train, held, md.predictor(model))).first()
    got = md.evaluate({"m": model}, rows).drop("model").first()
    assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(got, whole, strict=True)) and got.n == whole.n > 0
    few = md.evaluate({"m": model}, rows, horizon=99).collect()  # no day is held out
    assert [(r.model, r.n, r.mae) for r in few] == [("m", 0, None)]


def test_forecast_and_unknown_kind(learnable):
    out = md.forecast(md.train(learnable, "rf", n_trees=3, future_safe=True), learnable, 4)
    assert out.count() == 4 * learnable.select("heap_id", "grid_x").distinct().count() and out.where("predicted_temp is null").count() == 0
    with pytest.raises(ValueError):
        md.train(learnable, "other")


@pytest.mark.parametrize("name", ["model_registry", "forecast"])
def test_model_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
