"""Positions and nearest values along an order, without one task for all rows.

Rows are dealt into sorted ranges of even size and stored with the number of
their range, whatever share of them one group, day or null time holds. What
crosses the ranges (counts and last or first values) is carried over a table
with one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silocast.sources.storage import sized, stored


def row_order(df: DataFrame, at: str = "detection_time") -> list[str]:
    """The columns that order readings: the time, then row_id; in a frame
    without one all other columns, so only equal rows tie."""
    return [at, *(["row_id"] if "row_id" in df.columns else [c for c in df.columns if c != at])]


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def in_ranges(df: DataFrame, order: list[str], by: list[str] = ()) -> DataFrame:
    """``df`` sorted by (by, order) in ranges of even size, stored: ``_range``
    is the number of a row's range and ``_at`` grows along it."""
    keys = list(dict.fromkeys([*by, *order]))
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(rows.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranges")


def _joined(rows: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the row of ``parts`` for their group and range."""
    parts = sized(parts.withColumnsRenamed({c: f"_by_{c}" for c in by} | {"_range": "_of"}), "parts")
    on = [_same(c, f"_by_{c}") for c in by] + [F.col("_range") == F.col("_of")]
    return rows.join(parts, on).drop("_of", *[f"_by_{c}" for c in by])


def _counted(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """One row per group and range: its rows (_n), its lowest _at (_low), the
    rows of the group before it (_first) and ``more`` aggregates."""
    parts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"), *more)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def with_row_index(df: DataFrame, order: list[str], by: list[str] = (), name: str = "row_index") -> DataFrame:
    """``df`` with each row's gapless number from 0 along ``order`` within
    ``by``; nulls come first. Runs the jobs that store the ranges."""
    rows, by = in_ranges(df, order, by), list(by)
    rows = _joined(rows, _counted(rows, by), by)
    return rows.withColumn(name, F.col("_first") + F.col("_at") - F.col("_low")).drop("_range", "_at", "_first", "_low")


def with_neighbours(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_i``, the row's number within ``by``, and for every column
    c the structs ``_prev_c`` and ``_next_c`` (i, v): number and value of the
    nearest row at or before, at or after this one that has a value."""
    rows, by = in_ranges(df, order, by), list(by)
    at = {c: F.when(F.col(c).isNotNull(), F.col("_at")) for c in columns}
    ends = [f(F.struct(F.col("_at").alias("i"), F.col(c).alias("v")), at[c]).alias(f"_{k}_{c}") for k, f in (("last", F.max_by), ("head", F.min_by)) for c in columns]
    parts = _counted(rows, by, *ends)
    number = lambda i: F.col("_first") + i - F.col("_low")
    for c in (f"_{k}_{c}" for k in ("last", "head") for c in columns):  # places become numbers within the group
        parts = parts.withColumn(c, F.when(F.col(c).isNotNull(), F.struct(number(F.col(c)["i"]).alias("i"), F.col(c)["v"].alias("v"))))
    past = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *by, "_range", "_low", "_first",
        *[F.last(f"_last_{c}", True).over(past).alias(f"_last_{c}") for c in columns],
        *[F.last(f"_head_{c}", True).over(ahead).alias(f"_head_{c}") for c in columns],
    )
    rows = _joined(rows, parts, by).withColumn("_i", number(F.col("_at")))
    pair = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v"))) for c in columns}
    within = Window.partitionBy(*by, "_range")
    up = within.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    down = within.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_prev_{c}": F.coalesce(F.last(pair[c], True).over(up), f"_last_{c}") for c in columns})
    rows = rows.withColumns({f"_next_{c}": F.coalesce(F.last(pair[c], True).over(down), f"_head_{c}") for c in columns})
    return rows.drop("_range", "_at", "_low", "_first", *[f"_{k}_{c}" for k in ("last", "head") for c in columns])


def assign_folds(df: DataFrame, order: list[str], n_splits: int = 5) -> DataFrame:
    """``df`` with ``row_index`` and ``fold``: of n rows fold f of k tests the
    rows from n - (k - f + 1) * t on, t = n div (k + 1) of them, and trains on
    all rows before; the first rows are in no fold (null)."""
    rows = with_row_index(df, order)
    n = rows.count()
    size = n // (n_splits + 1)
    if not size:
        return rows.withColumn("fold", F.lit(None).cast("int"))
    fold = n_splits - F.floor((n - 1 - F.col("row_index")) / size)
    return rows.withColumn("fold", F.when(fold >= 1, fold).cast("int"))
