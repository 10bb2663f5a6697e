"""Hand-made frames: fills, markers, times, ids, and traps of the metrics."""

import datetime

import pytest

from silocast.functions import features as ft
from silocast.operators import cleaning as cl
from silocast.operators import forecast as fc
from silocast.sources import landing, readings

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    values = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    rows = [(i, DAY + datetime.timedelta(hours=13 * i), "a", v, "x" if v else None) for i, v in enumerate(values)]
    rows += [(100 + i, DAY + datetime.timedelta(hours=i), "b", v, None) for i, v in enumerate([3.0, None, 3.0])]
    return spark.createDataFrame(rows, "row_id long, detection_time timestamp_ntz, heap_id string, v double, s string")


def filled(series, how, limit=None, by=("heap_id",)):
    out = cl.fill_along(series, ["v"], list(by), ["detection_time", "row_id"], how, limit)
    return [r.v for r in out.where("heap_id = 'a'").orderBy("row_id").collect()]


def test_fills_across_days(series):
    assert filled(series, "ffill") == [None, 1, 1, 1, 4, 4, 4, 4, 8, 8]
    assert filled(series, "bfill") == [1, 1, 4, 4, 4, 8, 8, 8, 8, None]
    assert filled(series, "ffill", 1) == [None, 1, 1, None, 4, 4, None, None, 8, 8]
    assert filled(series, "bfill", 2) == [1, 1, 4, 4, 4, None, 8, 8, 8, None]
    assert filled(series, "ffill", 0) == filled(series, "bfill", 0) == [None, 1, None, None, 4, None, None, None, 8, None]
    assert filled(series, "interpolate") == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    assert filled(series, "interpolate", 2) == [None, 1, 2, 3, 4, 5, 6, None, 8, 8]
    assert filled(series, "ffill", by=())[0] is None and filled(series, "bfill", by=())[-1] is None
    with pytest.raises(ValueError):
        filled(series, "sideways")
    with pytest.raises(ValueError):
        cl.fill_missing(series, "ffill", "median of means")
    for strategy, numeric in (("mode", "interpolate"), ("bfill", "median"), ("ffill", "mean")):
        assert cl.fill_missing(series, strategy, numeric).count() == 13


def test_median_closes_in(spark):
    rows = spark.range(0, 5001).selectExpr("cast(pmod(id * 7919, 5001) as double) as v")
    assert cl.exact_median(rows, "v", at_most=50) == 2500.0
    even = rows.where("v < 5000").union(rows.where("v = 7")).union(rows.where("v is null"))
    assert cl.exact_median(even, "v", at_most=50) == sorted([*range(5000), 7])[2500]
    ties = spark.range(1000).selectExpr("if(id < 10, 1.0D, 5.0D) as v")
    assert cl.exact_median(ties, "v", at_most=50) == 5.0 and cl.exact_median(ties.limit(0), "v") is None


def test_standardize(spark, tmp_path):
    row = {"batch": "2024-01-02 03:04:05", "temp": "abc", "x": "1", "storeId": "w", "storepointName": "g", "storeName": "h", "storepoint_id": "p",
           "kdjd": "NaN", "max_temp": "3", "grid_index": "1_2_3"}
    got = readings.standardize(spark.createDataFrame([row])).first()
    assert (got.granary_id, got.heap_id, got.warehouse_id, got.storepoint_id) == ("g", "h", "w", "p")
    assert got.temperature_grain is None and got.longitude is None and got.max_temp == 3.0 and got.grid_x == 1 and got.grid_index == "1_2_3"
    assert got.detection_time == datetime.datetime(2024, 1, 2, 3, 4, 5)
    bad = spark.createDataFrame([{"batch": "soon", "temp": "1"}])
    assert readings.standardize(bad).first().detection_time is None
    with pytest.raises(Exception, match="unreadable"):
        readings.standardize(bad, strict=True).collect()
    with pytest.raises(ValueError):
        readings.standardize(bad.drop("batch"), strict=True)
    (tmp_path / "empty.csv").write_text("")
    assert readings.load_readings(spark, f"file://{tmp_path}/empty.csv").count() == 0
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    assert readings.read_dataset_dir(spark, f"file://{tmp_path}", "b").first().dataset == "b" and readings.local_datasets(str(tmp_path)) == ["b", "empty"]
    assert landing.read_weather(spark, f"file://{tmp_path}/none", "x", "2024-01-01", "2024-01-02").count() == 0
    with pytest.raises(ValueError):
        landing.read_entity(spark, "x", "trucks", "a string")


def test_features(spark):
    rows = spark.createDataFrame([(1, None, 3, "a", 7, 8), (1, 2, 3, None, 7, 8)], "grid_x int, grid_y int, grid_z int, kind string, level int, code int")
    assert [r.grid_index for r in ft.spatial_features(rows).collect()] == [None, "1_2_3"]
    coded = ft.encode_labels(rows, "kind").collect()
    assert {(r.kind, r.kind_code, r.level, r.code) for r in coded} == {("a", 0, 7, 8), (None, -1, 7, 8)}
    with pytest.raises(KeyError):
        ft.time_features(rows)
    assert ft.time_features(spark.createDataFrame([("2024-05-06 07:08:09",)], "date string")).first().hour == 7


def metrics(spark, pairs):
    return fc.overall_metrics(spark.createDataFrame([(1, *p) for p in pairs], "forecast_day int, temperature_grain double, predicted_temp double")).first()


def test_metric_traps(spark):
    assert metrics(spark, [(10.0, 9.0)]).confidence is None and metrics(spark, [(10.0, 9.0)]).accuracy == 90.0
    assert metrics(spark, [(0.0, 1.0), (0.0, 2.0)]).accuracy is None
    assert metrics(spark, [(5.0, 5.0), (5.0, 5.0)]).confidence == 100.0 and metrics(spark, [(5.0, 5.0), (5.0, 6.0)]).confidence == 0.0
    assert metrics(spark, [(1.0, 1.0), (3.0, 3.0), (None, 9.0), (4.0, None)]).confidence == 100.0
    assert metrics(spark, [(-10.0, -9.0), (10.0, 11.0)]).mape == pytest.approx(0.0)
    assert fc.grid_snapshot(spark.createDataFrame([(1,)], "grid_x int"), 1).count() == 0


def test_short_and_empty_frames(spark, series):
    train, held = fc.split(series.withColumnRenamed("v", "temperature_grain"))
    assert train.count() + held.count() == 13
    few = series.where("row_id >= 100").withColumnRenamed("v", "temperature_grain")
    train, held = fc.split(few)
    assert train.count() == 3 and held.count() == 0 and "forecast_day" in held.columns
    assert fc.gap_fill(train, held).count() == 0 and fc.make_future(few.limit(0)).count() == 0
    assert fc.make_future(few, 2, constants="per_silo").count() == 2
