"""Missing markers, duplicates, empty columns and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silocast.operators.ordering import row_order, with_neighbours
from silocast.sources.storage import stored

MARKERS, NUMBER_MARKER = ("-", "NA", "N/A"), -999
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
NUMERIC_STRATEGIES, STRATEGIES = ("mean", "median", "interpolate"), ("ffill", "bfill", "mode")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def clean_markers(df: DataFrame) -> DataFrame:
    """Whole-cell markers become null, by column type."""
    numbers = set(numeric_columns(df))
    out = {c: F.when(F.col(c) != NUMBER_MARKER, F.col(c)) for c in numbers}
    out |= {c: F.when(~F.col(c).isin(*MARKERS), F.col(c)) for c, t in df.dtypes if t == "string"}
    return df.withColumns(out)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nulls only (one aggregation); a frame
    without rows keeps all."""
    rows, *counts = df.agg(F.count("*"), *[F.count(c) for c in df.columns]).first()
    return df.select(*[c for c, n in zip(df.columns, counts, strict=True) if n]) if rows else df


def drop_repeated(df: DataFrame, identity: str = "row_id") -> DataFrame:
    """One row of those that are equal but for ``identity``, the first."""
    if identity not in df.columns:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != identity]
    return df.groupBy(*others).agg(F.min(identity).alias(identity)).select(*df.columns)


def clean_basic(df: DataFrame) -> DataFrame:
    """Trimmed names, markers as nulls, no empty column, no repeated row. The
    row_id that tells the rows of a file apart makes no difference."""
    df = clean_markers(df.toDF(*[c.strip() for c in df.columns]))
    return drop_repeated(drop_empty_columns(df))


def exact_median(df: DataFrame, column: str, at_most: int = 100_000) -> float | None:
    """The middle value, or the mean of the middle two, of the non-null values.

    Approximate percentiles close in on the middle until so few rows are left
    that their values can be counted one by one; each pass is one aggregation.
    """
    band = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = left = band.count()
    if not n:
        return None
    ranks, below = ((n - 1) // 2, n // 2), 0
    while left > at_most:
        at = [(r - below) / left for r in ranks]
        ends = band.agg(F.percentile_approx("v", [max(0.0, at[0] - 1e-3), min(1.0, at[1] + 1e-3)], 10_000).alias("p")).first().p
        got = band.agg(F.count_if(F.col("v") < ends[0]).alias("less"), F.count_if(F.col("v").between(*ends)).alias("inside")).first()
        if got.inside == left or not below + got.less <= ranks[0] <= ranks[1] < below + got.less + got.inside:
            break
        below, left, band = below + got.less, got.inside, band.where(F.col("v").between(*ends))
    found, seen = {}, below
    for r in band.groupBy("v").count().orderBy("v").toLocalIterator():
        seen += r["count"]
        for k in ranks:
            if seen > k:
                found.setdefault(k, r["v"])
        if len(found) == len(set(ranks)):
            break
    return (found[ranks[0]] + found[ranks[1]]) / 2


def fill_numeric(df: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """Nulls of ``columns`` become the column's global mean or exact median."""
    if how not in ("mean", "median"):
        raise ValueError(f"unknown strategy {how!r}")
    if how == "median":
        values = stored(df.select(*columns), "median")  # read again by each pass
        return df.withColumns({c: F.coalesce(c, F.lit(exact_median(values, c))) for c in columns})
    means = df.agg(*[F.avg(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(c, F.lit(m).cast("double")) for c, m in zip(columns, means, strict=True)})


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of ``columns`` become the column's most frequent value, the
    smallest of equally frequent ones."""
    for c in columns:
        best = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1)
        best = best.agg(F.first(c).alias("_fill"))
        df = df.crossJoin(F.broadcast(best)).withColumn(c, F.coalesce(c, "_fill")).drop("_fill")  # one row
    return df


def fill_along(
    df: DataFrame, columns: list[str], by: list[str], order: list[str], how: str = "ffill", limit: int | None = None
) -> DataFrame:
    """Nulls take the last seen value (``ffill``), the next one (``bfill``) or a
    value on the line between the two by row position (``interpolate``; leading
    gaps stay, trailing ones take the last value), along ``order`` within
    ``by``. Of a gap ``limit`` rows at most are filled; 0 fills none."""
    if how not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"unknown strategy {how!r}")
    rows = with_neighbours(df, columns, by, order)
    i, out = F.col("_i"), {}
    for c in columns:
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        near = F.lit(True) if limit is None else ((n.i - i) if how == "bfill" else (i - p.i)) <= limit
        if how == "interpolate":
            step = (n.v - p.v) * (i - p.i) / F.nullif(n.i - p.i, F.lit(0))
            value = F.when(n.v.isNull(), p.v).otherwise(p.v + step)
        else:
            value = n.v if how == "bfill" else p.v
        out[c] = F.coalesce(F.col(c), F.when(near, value))
    return rows.withColumns(out).select(*df.columns)


def fill_missing(
    df: DataFrame, strategy: str = "ffill", numeric_strategy: str = "mean", limit: int | None = None,
    by: list[str] = ("heap_id",), order: list[str] | None = None,
) -> DataFrame:
    """All columns but those of ``by``, the time and row_id filled: numbers by
    ``numeric_strategy``, the others by ``strategy``, along ``order`` (default:
    that of ``row_order``). ``limit`` bounds the fills along time."""
    if numeric_strategy not in NUMERIC_STRATEGIES or strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {numeric_strategy!r} or {strategy!r}")
    by, order = [c for c in by if c in df.columns], list(order or row_order(df))
    numbers = [c for c in numeric_columns(df) if c not in (*by, order[0], "row_id")]
    others = [c for c in df.columns if c not in (*numbers, *by, order[0], "row_id")]
    names = df.columns
    if numeric_strategy == "interpolate":
        df = fill_along(df, numbers, by, order, "interpolate", limit)
    elif numbers:
        kinds = dict(df.dtypes)
        df = fill_numeric(df, numbers, numeric_strategy)
        df = df.withColumns({c: F.col(c).cast(kinds[c]) for c in numbers if kinds[c] not in ("float", "double")})
    if others:
        df = fill_mode(df, others) if strategy == "mode" else fill_along(df, others, by, order, strategy, limit)
    return df.select(*names)
