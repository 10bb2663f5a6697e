"""Landed JSON of weather and company services."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silocast.sources.readings import ISO_TIME

WEATHER = "location string, time timestamp_ntz, temperature_outside double, humidity_outside double"
ENDPOINTS = ("granaries", "heaps", "sensors", "operations")


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    """The landed records, or an empty frame of ``schema`` where none landed."""
    try:
        return spark.read.schema(schema).option("timestampNTZFormat", ISO_TIME).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def land(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Adds records to a landing folder, one JSON object a line."""
    df.write.mode("append").option("timestampNTZFormat", ISO_TIME).partitionBy(*by).json(path)


def read_weather(spark: SparkSession, path: str, location: str, start, end) -> DataFrame:
    """Weather records of ``location`` from ``start`` to ``end``, both included."""
    df = _json(spark, path, WEATHER)
    return df.where((F.col("location") == location) & F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def read_entity(spark: SparkSession, path: str, endpoint: str, schema, params: dict | None = None) -> DataFrame:
    """Records of one company ``endpoint`` (a folder ``endpoint=...``) whose
    fields equal ``params``."""
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint {endpoint!r}")
    df = _json(spark, f"{path}/endpoint={endpoint}", schema)
    for column, value in (params or {}).items():
        df = df.where(F.col(column) == value)
    return df
