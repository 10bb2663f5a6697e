"""Sensor readings from CSV exports and from the driver's event table."""

from __future__ import annotations

import glob
import os
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from silocast.sources.storage import sized, stored

#: Export name to canonical name.
RENAMES = {
    "batch": "detection_time", "temp": "temperature_grain", "x": "grid_x", "y": "grid_y", "z": "grid_z",
    "indoor_temp": "temperature_inside", "outdoor_temp": "temperature_outside",
    "indoor_humidity": "humidity_warehouse", "outdoor_humidity": "humidity_outside",
    "storeType": "warehouse_type", "storepointName": "granary_id", "storeName": "heap_id",
    "kdjd": "longitude", "kdwd": "latitude", "kqdz": "address_cn", "storeId": "warehouse_id", "locatType": "location_type",
}
#: Canonical columns that hold numbers, and grid positions.
NUMBERS = (
    "temperature_grain", "temperature_inside", "temperature_outside", "humidity_warehouse", "humidity_outside",
    "avg_in_temp", "max_temp", "min_temp", "longitude", "latitude",
)
POSITIONS = ("grid_x", "grid_y", "grid_z", "line_no", "layer_no")
#: Other names of the time column; cells that stand for nothing.
TIME_NAMES = ("timestamp", "datetime", "date", "time")
NO_VALUE = ("", "-", "NA", "N/A", "NaN", "nan")
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
TIME_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy/M/d H:mm", "yyyy/MM/dd")

#: The readings as SQL over ``events``, for Spark and DuckDB alike.
READINGS_SQL = """
SELECT event_id AS row_id, ts AS detection_time, event_id AS detection_cycle,
  CONCAT('G', CAST(user_id % 3 AS STRING)) AS granary_id,
  CONCAT('G', CAST(user_id % 3 AS STRING), '-H', CAST(CAST(floor(user_id / 3e0) AS BIGINT) % 2 AS STRING)) AS heap_id,
  CAST(CAST(floor(user_id / 6e0) AS BIGINT) % 3 AS INT) AS grid_x,
  CAST(CAST(floor(user_id / 18e0) AS BIGINT) % 3 AS INT) AS grid_y,
  CAST(CAST(floor(user_id / 54e0) AS BIGINT) % 3 AS INT) AS grid_z,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN -999e0
       ELSE 12e0 + least(value, 180e0) / 10e0 END AS temperature_grain,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 14e0 + least(value, 180e0) / 12e0 END AS temperature_inside,
  20e0 + CAST(event_id % 13 AS DOUBLE) - 6e0 AS temperature_outside,
  60e0 + CAST(event_id % 31 AS DOUBLE) AS humidity_warehouse,
  65e0 + CAST(event_id % 29 AS DOUBLE) AS humidity_outside,
  CASE event_type WHEN 'click' THEN 'Wheat' WHEN 'view' THEN 'Japonica rice'
    WHEN 'signup' THEN 'Yellow corn' WHEN 'purchase' THEN 'Soybeans' WHEN 'error' THEN '-' ELSE NULL END AS grain_type,
  'flat' AS warehouse_type
FROM events
"""


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical readings derived from the ``events`` table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(READINGS_SQL.replace("FROM events", "FROM {events}"), events=events)


def any_charset(spark: SparkSession, encoding: str) -> None:
    """Lets Spark use Java's charsets, if ``encoding`` is not one of its own."""
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; without ``schema`` every column is text. GBK needs
    Spark's Java charsets, which are switched on for the session."""
    any_charset(spark, encoding)
    reader = spark.read.option("header", True).option("encoding", encoding).option("timestampNTZFormat", ISO_TIME)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def parse_time(text) -> F.Column:
    """A timestamp without zone from ISO text or any of ``TIME_FORMATS``, else null."""
    return F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS])


def standardize(df: DataFrame, strict: bool = False) -> DataFrame:
    """Canonical names, a parsed ``detection_time``, numbers as doubles and
    positions as integers, whichever of them are there. Text that does not
    parse becomes null; with ``strict`` an unreadable or missing time is an
    error. Unknown columns pass."""
    df = df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(RENAMES)
    text = {c: F.col(c).cast("string") for c in df.columns}
    casts = {c: text[c].try_cast("double") for c in NUMBERS if c in text}
    casts = {c: F.when(~F.isnan(v), v) for c, v in casts.items()}
    casts |= {c: text[c].try_cast("double").try_cast("int") for c in POSITIONS if c in text}
    if "detection_time" in text and dict(df.dtypes)["detection_time"] == "string":
        at = parse_time(F.col("detection_time"))
        if strict:
            at = F.when(F.col("detection_time").isNull() | at.isNull(), F.raise_error("unreadable detection_time")).otherwise(at)
        casts["detection_time"] = at
    elif strict and "detection_time" not in text:
        raise ValueError("no detection_time column")
    return df.withColumns(casts)


def _located(df: DataFrame) -> DataFrame:
    """``df``, just read from files, with the place of each row: its file, the
    start of the block that a task read, and a number that grows in the block."""
    place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    return df.select("*", *place, F.monotonically_increasing_id().alias("_at"))


def _numbered(located: DataFrame, name: str = "row_id") -> DataFrame:
    rows = stored(located, "located")
    parts = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of a file
    parts = sized(parts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "blocks")
    number = (F.col("_first") + F.col("_at") - F.col("_low")).alias(name)
    return rows.join(parts, ["_file", "_block"]).select(number, *[c for c in rows.columns if c not in ("_file", "_block", "_at")])


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``df``, just read from files, with each row's gapless number from 0 in
    the order of the files' paths and of the rows in them. The rows are stored
    with their places, so the numbers are the same however files were split."""
    return _numbered(_located(df), name)


def canonical(df: DataFrame) -> DataFrame:
    """``df`` under canonical names and types, if it is in the export format
    (it has ``temp`` and ``batch``) or has a time under any of its usual names;
    else as it is."""
    names = [c.strip() for c in df.columns]
    if {"temp", "batch"} <= set(names):
        return standardize(df)
    at = next((c for c in ("detection_time", *TIME_NAMES) if c in names), None)
    return df if at is None else standardize(df.toDF(*["detection_time" if c == at else c for c in names]))


def load_readings(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """Readings of CSV files. A file in the export format is standardized; of
    one under canonical names the types are, and its time column is named
    detection_time. Without a column row_id the rows are numbered by their
    place. A file without a header gives an empty frame without columns."""
    try:
        df = read_csv(spark, path, encoding=encoding)
    except Exception as e:  # Spark cannot infer columns of an empty file
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], StructType([]))
    if not df.columns:
        return df
    return canonical(df if "row_id" in {c.strip() for c in df.columns} else numbered(df))


# ------------------------------------------------------- folders of datasets


def _dataset(path: Column) -> Column:
    """The name of the dataset that a file belongs to, a file or folder *.csv."""
    return F.regexp_extract(path, r"/([^/]+)\.csv(?:/[^/]+)?$", 1)


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(dataset): the CSV datasets below ``path``. Lists files, reads none."""
    files = spark.read.format("binaryFile").load(f"{path}/*.csv")
    return files.select(_dataset(F.col("path")).alias("dataset")).distinct()


def _by_header(spark: SparkSession, path: str, dataset: str | None) -> list[DataFrame]:
    """One frame of text columns, ``dataset`` and the rows' places for all
    datasets of equal header, in the order of the headers' first datasets. The
    header of each dataset is read by a small job of its own, eight at once. A
    part file whose header differs from its dataset's is an error."""
    names = [dataset] if dataset is not None else sorted(r["dataset"] for r in list_datasets(spark, path).collect())
    paths = {n: f"{path}/" + re.sub(r"([\[\]{}*?^\\])", r"\\\1", n) + ".csv" for n in names}

    def header(name: str) -> tuple:
        try:
            return tuple(read_csv(spark, paths[name]).columns)
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return ()

    with ThreadPoolExecutor(8) as pool:
        headers = dict(zip(names, pool.map(header, names), strict=True))
    groups: dict[tuple, list[str]] = {}
    for name, columns in headers.items():
        if columns:
            groups.setdefault(columns, []).append(paths[name])
    out = []
    for columns, of in groups.items():
        reader = spark.read.option("header", True).option("enforceSchema", False)
        df = _located(reader.schema(StructType([StructField(c, StringType()) for c in columns])).csv(of))
        plain = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
        out.append(df.withColumn("dataset", _dataset(plain)))
    return out


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_dataset_dir(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The rows of all CSV datasets below ``path`` (files or folders named
    ``*.csv``), as text, with a column ``dataset``, the name without its
    ending; or of one of them, of which alone files are read. Columns are
    matched by name; one that a dataset lacks is null there."""
    frames = _by_header(spark, path, dataset)
    if not frames:
        return spark.createDataFrame([], "dataset string")
    return _together(frames).drop("_file", "_block", "_at")


def load_datasets(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Like ``read_dataset_dir``, under canonical names and types, the rows
    numbered as ``row_id`` over all datasets read."""
    frames = _by_header(spark, path, dataset)
    if not frames:
        return spark.createDataFrame([], "row_id long, dataset string")
    return _numbered(_together([canonical(df.drop("row_id")) for df in frames]))


# ------------------------------------------------- ingest with a fault count


def with_faults(df: DataFrame) -> DataFrame:
    """``standardize`` with a column ``faults``, an array of (column, reason,
    value): a time that is ``missing``, and cells that are ``unreadable`` as
    the time or number they should be. Empty cells and missing markers of
    numbers are no faults."""
    raw = df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(RENAMES)
    texts = {c: F.col(c).cast("string") for c in ("detection_time", *NUMBERS, *POSITIONS) if c in raw.columns}
    kept = raw.withColumns({f"_raw_{c}": t for c, t in texts.items()})
    out = standardize(kept)

    def fault(column: str, reason: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"), F.col(f"_raw_{column}").alias("value")))

    found = []
    for c in texts:
        text = F.trim(f"_raw_{c}")
        empty = F.col(f"_raw_{c}").isNull() | text.isin(*NO_VALUE)
        found.append(fault(c, "unreadable", ~empty & F.col(c).isNull()))
        if c == "detection_time":
            found.append(fault(c, "missing", empty))
    faults = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<struct<column:string,reason:string,value:string>>")
    return out.withColumn("faults", faults).drop(*[f"_raw_{c}" for c in texts])


def ingest(df: DataFrame, path: str, most: float | None = None) -> dict[str, int]:
    """Writes the standardized rows of ``df`` below ``path``, those with faults
    apart (``rejected``), and returns the counts that were observed while they
    were written: ``rows``, ``rejected`` and one for each column that has
    faults. More than a share ``most`` of rejected rows (0: any) is an error
    after the writing, so that the faults can be looked at."""
    rows = with_faults(df)
    columns = [c for c in ("detection_time", *NUMBERS, *POSITIONS) if c in rows.columns]
    seen = Observation()
    bad = F.size("faults") > 0

    def faults_of(column: str) -> Column:
        return F.size(F.filter("faults", lambda x: x["column"] == F.lit(column)))

    per = [F.coalesce(F.sum(faults_of(c)), F.lit(0)).alias(c) for c in columns]
    counted = rows.observe(seen, F.count("*").alias("rows"), F.count_if(bad).alias("rejected"), *per)
    counted.withColumn("rejected", bad).write.mode("overwrite").partitionBy("rejected").parquet(path)
    counts = {k: v for k, v in seen.get.items() if v or k in ("rows", "rejected")}
    if most is not None and counts["rejected"] > most * counts["rows"]:
        raise ValueError(f"{counts['rejected']} of {counts['rows']} rows rejected: {counts}")
    return counts


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The rows without faults that ``ingest`` wrote."""
    return spark.read.parquet(path).where("cast(rejected as string) = 'false'").drop("rejected", "faults")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The rejected rows, one for each fault, with its column, reason and value."""
    rows = spark.read.parquet(path).where("cast(rejected as string) = 'true'").withColumn("fault", F.explode("faults"))
    return rows.select(*[c for c in rows.columns if c not in ("rejected", "faults", "fault")], "fault.*")


# ------------------------------------------------------- partitioned readings


def write_store(df: DataFrame, path: str) -> None:
    """Readings as Parquet in folders by ``site`` (the granary_id) and ``day``.
    Days of a site that are there already are replaced, others stay. A large
    day is split over several files, small ones are written by one task."""
    rows = df.withColumns({"site": F.col("granary_id").cast("string"), "day": F.to_date("detection_time")})
    writer = rows.hint("rebalance", "site", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("site", "day").parquet(path)


def read_store(spark: SparkSession, path: str, granary: str | None = None, heap: str | None = None, first=None, last=None) -> DataFrame:
    """Readings of a store: of one warehouse and silo, from day ``first`` to
    ``last``. Warehouse and days are folders, so only their files are read."""
    found = spark.read.parquet(path).schema
    kinds = {"site": "string", "day": "date"}  # as text, 007 is no number
    schema = ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in found.fields)
    df = spark.read.schema(schema).parquet(path)
    if granary is not None:
        df = df.where(F.col("site") == granary)
    if first is not None:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col("day") <= F.lit(last).cast("date"))
    if heap is not None:
        df = df.where(F.col("heap_id") == heap)
    return df.drop("site", "day")


def local_datasets(path: str) -> list[str]:
    """Sorted names of the CSV datasets of a local folder, as a user picks one."""
    return sorted(os.path.basename(p)[: -len(".csv")] for p in glob.glob(f"{path}/*.csv"))


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """CSV with a header, times to the microsecond; one folder of part files."""
    any_charset(df.sparkSession, encoding)
    writer = df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", ISO_TIME)
    writer.option("encoding", encoding).csv(path)
