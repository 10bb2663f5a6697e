"""Files as users have them: no row_id, differing headers, other time names, faults."""

import datetime

import pytest
from pyspark.sql import functions as F

from silocast.operators import forecast as fc
from silocast.operators import models as md
from silocast.sources import readings as rd


@pytest.fixture
def export(tmp_path):
    """An export of 40 days, two probes, in three part files, without row_id."""
    lines = []
    for d in range(40):
        for h in (0, 12):
            for x in (0, 1):
                day = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
                lines.append(f"{day:%Y-%m-%d %H:%M:%S},{15 + x + h / 12 + (d % 7) / 10},{x},0,0,G1,S{x},{'-' if d % 9 else 'Wheat'}")
    (tmp_path / "data.csv").mkdir()
    for i in range(3):
        part = ["batch,temp,x,y,z,storepointName,storeName,grain_type", *lines[i * 54 : (i + 1) * 54]]
        (tmp_path / "data.csv" / f"part-{i}.csv").write_text("\n".join(part) + "\n")
    return f"file://{tmp_path}/data.csv", len(lines)


def test_export_trains_and_forecasts(spark, export):
    path, n = export
    rows = rd.load_readings(spark, path)
    assert sorted(r.row_id for r in rows.collect()) == list(range(n))
    ready = md.prepare(rows)
    assert ready.count() == n and ready.where("grain_type is null").count() < n
    model = md.train(ready, "rf", n_trees=3, maxDepth=4)
    assert set(model.features) & {"row_id", "detection_time"} == set() and model.meta["mae"] < 1
    assert md.forecast(model, ready, 3).count() == 6
    bare = md.prepare(rows.drop("row_id"))  # frames of other origin have no row_id at all
    assert bare.count() == n and md.train(bare, "lgbm", n_trees=2, maxDepth=2).meta["measured"] == "in_sample"


def test_numbers_do_not_depend_on_splits(spark, export):
    path, n = export
    want = {(r.detection_time, r.grid_x): r.row_id for r in rd.load_readings(spark, path).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        again = rd.load_readings(spark, path)
        assert {(r.detection_time, r.grid_x): r.row_id for r in again.collect()} == want and len(want) == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_equal_rows_of_a_file_count_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("batch,temp\n2024-01-01,3\n2024-01-01,3\n2024-01-02,NA\n")
    rows = rd.load_readings(spark, f"file://{tmp_path}/a.csv")
    assert [(r.row_id, r.temperature_grain) for r in md.clean_basic(rows).orderBy("row_id").collect()] == [(0, 3.0), (2, None)]


def test_folder_of_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("batch,temp,x\n2024-01-01 00:00:00,20.5,3\n")
    (tmp_path / "b.csv").write_text("x,batch,temp\n7,2024-02-01 00:00:00,33.5\n")
    (tmp_path / "c d+[1].csv").write_text("timestamp,temperature_grain,note\n2024-03-01 05:00:00,11,hello\n")
    (tmp_path / "e.csv").write_text("")
    top = f"file://{tmp_path}"
    b = rd.read_dataset_dir(spark, top, "b")
    assert (b.first().batch, b.first().temp, b.first().x, b.first().dataset) == ("2024-02-01 00:00:00", "33.5", "7", "b")
    assert len(b.inputFiles()) == 1 and b.inputFiles()[0].endswith("/b.csv")
    every = {r.dataset: r for r in rd.read_dataset_dir(spark, top).collect()}
    assert set(every) == {"a", "b", "c d+[1]"} and every["a"].x == "3" and every["a"].note is None
    assert rd.read_dataset_dir(spark, top, "c d+[1]").first().note == "hello"
    typed = {r.dataset: r for r in rd.load_datasets(spark, top).collect()}
    assert [typed[k].temperature_grain for k in ("a", "b", "c d+[1]")] == [20.5, 33.5, 11.0] and typed["b"].grid_x == 7
    assert typed["c d+[1]"].detection_time == datetime.datetime(2024, 3, 1, 5) and sorted(r.row_id for r in typed.values()) == [0, 1, 2]


def test_a_part_with_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").mkdir()
    (tmp_path / "a.csv" / "part-0.csv").write_text("batch,temp\n2024-01-01,1\n")
    (tmp_path / "a.csv" / "part-1.csv").write_text("temp,batch\n2,2024-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        rd.read_dataset_dir(spark, f"file://{tmp_path}").collect()


@pytest.mark.parametrize("name", rd.TIME_NAMES)
def test_other_time_names(spark, tmp_path, name):
    (tmp_path / "a.csv").write_text(f"{name},temperature_grain,grid_x\n2024-01-01 01:00:00,NaN,1\n2024-01-02,2,x\n")
    rows = rd.load_readings(spark, f"file://{tmp_path}/a.csv")
    train, held = fc.split(rows)
    assert train.count() == 2 and held.count() == 0 and dict(rows.dtypes)["detection_time"] == "timestamp_ntz"


def test_ingest_counts_and_quarantine(spark, tmp_path):
    rows = [("2024-01-01", "1.5", "2"), ("soon", "x", "2"), (None, "-", "3"), ("2024-01-02", "", None), ("2024-01-03", "NaN", "left")]
    df = spark.createDataFrame(rows, "batch string, temp string, x string").withColumn("line", F.monotonically_increasing_id())
    path = f"file://{tmp_path}/in"
    assert rd.ingest(df, path) == {"rows": 5, "rejected": 3, "detection_time": 2, "temperature_grain": 1, "grid_x": 1}
    got = sorted((r.column, r.reason, r.value) for r in rd.quarantine(spark, path).select("column", "reason", "value").collect())
    assert got == [("detection_time", "missing", None), ("detection_time", "unreadable", "soon"), ("grid_x", "unreadable", "left"), ("temperature_grain", "unreadable", "x")]
    assert rd.ingested(spark, path).count() == 2
    with pytest.raises(ValueError, match="3 of 5"):
        rd.ingest(df, path, most=0.5)
    assert rd.ingest(df.limit(0), f"{path}0", most=0) == {"rows": 0, "rejected": 0}


def test_store_reads_its_folders_only(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 20), g, f"{g}-H{i % 2}") for i in range(400) for g in ("007", "G2", None)]
    df = spark.createDataFrame(rows, "row_id long, detection_time timestamp_ntz, granary_id string, heap_id string")
    path = f"file://{tmp_path}/store"
    rd.write_store(df, path)
    rd.write_store(df.where("day(detection_time) = 3 and granary_id = 'G2'").limit(1), path)  # replaces one day of one site
    out = rd.read_store(spark, path, "007", "007-H1", "2024-01-04", "2024-01-05")
    assert {r.granary_id for r in out.collect()} == {"007"} and out.count() == 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]
    files = out.select("_metadata.file_path").distinct().collect()
    assert all("site=007/day=2024-01-0" in r.file_path for r in files) and len(files) <= 2
    assert rd.read_store(spark, path).count() == 1200 - 20 + 1
