"""Positions, nearest values and codes at any skew, against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from silocast.functions import features as ft
from silocast.operators import forecast as fc
from silocast.operators import ordering
from silocast.plans import catalog

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2024, 5, 1)


@pytest.mark.parametrize("at", ["timestamp_ntz'2024-05-01 00:00:00'", "cast(null as timestamp_ntz)"])
def test_one_day_is_many_ranges(spark, at):
    rows = spark.range(40_000).selectExpr("id as row_id", f"{at} as detection_time", "'a' as heap_id", "if(id % 7 = 0, id * 1.0, null) as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        ranges = ordering.in_ranges(rows, ["detection_time", "row_id"]).groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mean = 40_000 / len(ranges)
    assert len(ranges) == 8 and max(r["count"] for r in ranges) <= 2 * mean
    folds = ordering.assign_folds(rows, ["detection_time", "row_id"])
    assert folds.where("row_index <> row_id").count() == 0 and folds.agg(F.max("fold")).first()[0] == 5
    near = ordering.with_neighbours(rows, ["v"], ["heap_id"], ["detection_time", "row_id"])
    assert near.where("_prev_v.v <> row_id - row_id % 7 or _i <> row_id").count() == 0


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_neighbours_equal_plain(spark, by):
    draw = random.Random(8)
    rows = [(i, draw.choice([None, *(DAY + datetime.timedelta(hours=h) for h in range(40))]), draw.choice("ab") if i % 5 else None, i % 2, draw.choice([None, None, float(i)])) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, at timestamp_ntz, g string, h int, v double").repartition(7)
    out = {r.row_id: r for r in ordering.with_neighbours(df, ["v"], by, ["at", "row_id"]).collect()}
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r["id t g h v".split().index(c)] for c in by), []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r[1] is not None, r[1] or DAY, r[0]))
        for i, r in enumerate(own):
            prev = next(((j, own[j][4]) for j in range(i, -1, -1) if own[j][4] is not None), None)
            after = next(((j, own[j][4]) for j in range(i, len(own)) if own[j][4] is not None), None)
            got = out[r[0]]
            assert got._i == i and (got._prev_v and tuple(got._prev_v)) == prev and (got._next_v and tuple(got._next_v)) == after


@pytest.mark.parametrize("most", [256, 3])
def test_codes_by_map_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(ft, "INLINE_LEVELS", most)
    df = spark.range(60).selectExpr("id", "concat('k', lpad(id % 20, 2, '0')) as a", "if(id % 3 = 0, null, concat('z', id % 2)) as b", "id as level", "'x' as code")
    dictionary = ft.fit_dictionary(df.where("id % 20 <> 5"), ["a", "b"])
    levels = sorted({f"k{i:02}" for i in range(20) if i != 5})
    for r in ft.encode(df, dictionary, ["a", "b"]).collect():
        k = f"k{r.id % 20:02}"
        assert r.a == (levels.index(k) if k in levels else -1) and r.b == (-1 if r.id % 3 == 0 else r.id % 2) and r.level == r.id
    assert ft.encode(df.limit(0), dictionary, ["a"]).count() == 0 and ft.fit_dictionary(df.where("b is null"), ["b"]).count() == 0


@pytest.mark.parametrize("name, most", [("feature_matrix", 8), ("preview", 8), ("prepare", 8), ("align_features", 8), ("forecast_series", 16)])
def test_plans_read_stored_frames(spark, name, most):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most


def test_split_is_two_filters(spark):
    rows = spark.createDataFrame([(i, DAY + datetime.timedelta(days=i % 9)) for i in range(30)] + [(99, None)], "row_id long, detection_time timestamp_ntz")
    train, held = fc.split(rows, 3)
    assert {r.forecast_day for r in held.collect()} == {1, 2, 3} and train.count() + held.count() == 31 and train.where("row_id = 99").count() == 1
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
