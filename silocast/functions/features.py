"""Calendar, cyclic, spatial and label features, and feature frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silocast.operators.ordering import with_row_index
from silocast.sources.readings import TIME_NAMES
from silocast.sources.storage import sized

#: Columns that are no features; columns unknown for days to come.
NOT_FEATURES = (
    "temperature_grain", "detection_time", "granary_id", "heap_id", "forecast_day", "line_no", "layer_no", "line", "layer",
)
ENVIRONMENT = ("temperature_inside", "temperature_outside", "humidity_warehouse", "humidity_outside")
MEASURED = ("avg_in_temp", "max_temp", "min_temp")
#: levels of a column up to which its codes are part of the plan
INLINE_LEVELS = 256


def time_column(df: DataFrame, at: str = "detection_time") -> str:
    """``at`` if it is there, else the first of the usual names."""
    for name in (at, *TIME_NAMES):
        if name in df.columns:
            return name
    raise KeyError(f"no column {at!r} and none of {', '.join(TIME_NAMES)}")


def time_features(df: DataFrame, at: str = "detection_time") -> DataFrame:
    at = time_column(df, at)
    t = F.col(at)
    if dict(df.dtypes)[at] == "string":
        t = F.try_to_timestamp(t).cast("timestamp_ntz")
    df = df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)})
    turn = {"month": 12, "hour": 24}
    for name, n in turn.items():
        angle = F.col(name) * F.lit(2 * math.pi / n)
        df = df.withColumns({f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)})
    return df


def spatial_features(df: DataFrame) -> DataFrame:
    """grid_index, where all three grid columns exist; null if one is null."""
    axes = [f"grid_{a}" for a in "xyz"]
    if not set(axes) <= set(df.columns):
        return df
    x, y, z = (F.col(a).cast("int").cast("string") for a in axes)
    return df.withColumn("grid_index", F.concat(x, F.lit("_"), y, F.lit("_"), z))


def label_levels(df: DataFrame, column: str) -> DataFrame:
    """(level, code): sorted distinct values numbered from 0."""
    levels = df.select(F.col(column).alias("level")).na.drop().distinct()
    return with_row_index(levels, ["level"], name="code").withColumn("code", F.col("code").cast("int"))


def encode_labels(df: DataFrame, column: str, levels: DataFrame | None = None) -> DataFrame:
    """``column``_code from ``levels`` (default: its own); unseen or null: -1."""
    levels = label_levels(df, column) if levels is None else levels
    return _coded(df, {f"{column}_code": column}, levels.select(F.lit(column).alias("column"), "level", "code"))


def fit_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, code) of the sorted distinct values of ``columns``,
    stored: one aggregation over ``df`` for all of them. Levels are numbered in
    ranges, so a column may have any number of them."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns])).alias("x"))
    values = values.select("x.column", "x.level").where("level is not null").distinct()
    return with_row_index(values, ["level"], ["column"], "code").withColumn("code", F.col("code").cast("int"))


def _coded(df: DataFrame, out: dict[str, str], dictionary: DataFrame) -> DataFrame:
    """``df`` with codes: ``out`` says from which column each new one comes. A
    column of up to INLINE_LEVELS levels gets them from a map in the plan;
    others from a join, a broadcast one up to the size that ``sized`` sets."""
    of = sorted(set(out.values()))
    few: dict[str, dict] = {c: {} for c in of}
    for r in dictionary.where(F.col("column").isin(of) & (F.col("code") <= INLINE_LEVELS)).collect():
        few[r["column"]][r["level"]] = r["code"]  # at most INLINE_LEVELS + 1 rows a column
    new = {}
    for name, c in out.items():
        levels = few[c]
        if len(levels) <= INLINE_LEVELS:
            codes = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]) if levels else None
            new[name] = F.lit(-1) if codes is None else F.coalesce(F.try_element_at(codes, F.col(c)), F.lit(-1))
    df = df.withColumns(new)
    for name, c in out.items():
        if name not in new:
            levels = sized(dictionary.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code")), "levels")
            df = df.join(levels, F.col(c) == F.col("_level"), "left")
            df = df.withColumn(name, F.coalesce("_code", F.lit(-1))).drop("_level", "_code")
    return df


def encode(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` replaced by their codes in ``dictionary``; unseen or null: -1."""
    own = {f"_code_of_{c}": c for c in columns}
    out = _coded(df, own, dictionary).drop(*columns).withColumnsRenamed(own)
    return out.select(*df.columns)


def future_safe(df: DataFrame) -> DataFrame:
    """Without the columns that are unknown for days to come."""
    return df.drop(*ENVIRONMENT, *MEASURED)


def select_features(df: DataFrame, target: str = "temperature_grain", keep: tuple = ("row_id",)) -> DataFrame:
    """Features, text among them as codes of the frame itself, the target as
    ``target`` and the columns ``keep``."""
    text = [c for c, t in df.dtypes if t == "string" and c not in (*NOT_FEATURES, *keep)]
    out = encode(df, fit_dictionary(df, text), text) if text else df
    features = [c for c in df.columns if c not in (*NOT_FEATURES, *keep, target)]
    return out.select(*[c for c in keep if c in df.columns], *features, F.col(target).alias("target"))


def align_features(df: DataFrame, names: list[str], keep: tuple = ()) -> DataFrame:
    """The columns ``names`` in that order; one that is absent is 0, nulls
    stay, others go."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in names])
