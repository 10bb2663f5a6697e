"""The registered queries on sensor readings and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silocast.functions import features as ft
from silocast.operators import cleaning as cl
from silocast.operators import forecast as fc
from silocast.operators import models as md
from silocast.operators import results as rs
from silocast.operators.ordering import assign_folds
from silocast.sources import landing
from silocast.sources import readings as rd
from silocast.sources.readings import READINGS_SQL, sensor_readings
from silocast.sources.storage import scratch

TEMPS = ["temperature_grain", "temperature_inside"]
ORDER = ["detection_time", "row_id"]
PROBE = list(fc.PROBE)
GAP_DAYS = (27, 28)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query function, and its SQL where there is one."""
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------------- frames


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean_markers(sensor_readings(spark, sf_dir))


def _repeated(df: DataFrame) -> DataFrame:
    return df.union(df.where("row_id % 50 = 0"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.mean_predictor(*fc.split(_clean(spark, sf_dir)))


def _future(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    train, _ = fc.split(_clean(spark, sf_dir))
    return fc.mean_predictor(train, fc.make_future(train, horizon))


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).where(~F.dayofmonth("detection_time").isin(*GAP_DAYS))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.prepare(_repeated(sensor_readings(spark, sf_dir)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _export(df: DataFrame) -> DataFrame:
    """Readings as text under export names, some of it unreadable."""
    text = lambda c: F.col(c).cast("string")
    slashed = F.date_format("detection_time", "yyyy/MM/dd HH:mm:ss")
    return df.select(
        text("row_id").alias("row_id"), F.concat(F.lit("S"), "granary_id").alias("storepoint_id"),
        F.col("granary_id").alias(" storepointName"), F.col("heap_id").alias("storeName"),
        F.concat(F.lit("W"), "heap_id").alias("storeId"), (F.col("grid_x") + 110.5).cast("string").alias("kdjd"),
        (F.col("grid_y") + 30.25).cast("string").alias("kdwd"), F.lit("一号库区").alias("kqdz"), F.lit("L").alias("locatType"),
        F.col("warehouse_type").alias("storeType"), text("grid_x").alias("line_no"), text("grid_z").alias("layer_no"),
        F.when(F.col("row_id") % 5 == 0, slashed).otherwise(text("detection_time")).alias("batch"),
        F.when(F.col("row_id") % 19 == 0, "bad").otherwise(text("temperature_grain")).alias("temp"),
        text("grid_x").alias("x"), text("grid_y").alias("y"), text("grid_z").alias("z"),
        text("temperature_inside").alias("indoor_temp"), text("humidity_warehouse").alias("indoor_humidity"),
        text("temperature_outside").alias("outdoor_temp"), text("humidity_outside").alias("outdoor_humidity"),
    )


# ---------------------------------------------------------------- SQL parts

_R = f"WITH raw AS ({READINGS_SQL})"
_REPLACE = """SELECT * REPLACE (nullif(temperature_grain, -999e0) AS temperature_grain,
  nullif(temperature_inside, -999e0) AS temperature_inside,
  CASE WHEN grain_type NOT IN ('-', 'NA', 'N/A') THEN grain_type END AS grain_type) FROM raw"""
_C = _R + f", r AS ({_REPLACE})"


def _split_sql(horizon: int = 5) -> str:
    """CTEs of the split by the last days; ``e`` has the mean predictions."""
    return f""", alldays AS (SELECT DISTINCT CAST(detection_time AS DATE) AS day FROM r),
days AS (SELECT day, CAST({horizon + 1} - row_number() OVER (ORDER BY day DESC) AS INT) AS forecast_day FROM alldays
  QUALIFY row_number() OVER (ORDER BY day DESC) <= {horizon} AND count(*) OVER () > {horizon + 1}),
train AS (SELECT * FROM r WHERE CAST(detection_time AS DATE) NOT IN (SELECT day FROM days)),
held AS (SELECT r.*, forecast_day FROM r JOIN days ON CAST(detection_time AS DATE) = day),
means AS (SELECT heap_id, avg(temperature_grain) AS predicted_temp FROM train GROUP BY 1),
e AS (SELECT held.*, predicted_temp FROM held LEFT JOIN means USING (heap_id))"""


_SPLIT = _split_sql()
_S = _C + _SPLIT
_G = _R + f", r AS ({_REPLACE} WHERE day(detection_time) NOT IN {GAP_DAYS})" + _SPLIT


def _future_sql(of: str = "train", horizon: int = 5) -> str:
    """CTE ``fut``: the frame of days to come after ``of``, with predictions."""
    return f""", one AS (SELECT max(detection_time) AS last, max(detection_cycle) AS cycle,
  arg_min(grain_type, (detection_time, row_id)) FILTER (grain_type IS NOT NULL) AS grain_type,
  arg_min(warehouse_type, (detection_time, row_id)) FILTER (warehouse_type IS NOT NULL) AS warehouse_type FROM {of}),
probes AS (SELECT DISTINCT granary_id, heap_id, grid_x, grid_y, grid_z FROM {of}),
fut0 AS (SELECT probes.*, grain_type, warehouse_type, cycle + h AS detection_cycle, CAST(h AS INT) AS forecast_day,
  last + to_days(CAST(h AS INT)) AS detection_time FROM probes, one, range(1, {horizon + 1}) k(h))"""


_FUT = _future_sql() + ", fut AS (SELECT fut0.*, predicted_temp FROM fut0 LEFT JOIN means USING (heap_id))"
_TIME = """CAST(year(detection_time) AS INT) AS year, CAST(month(detection_time) AS INT) AS month,
  CAST(day(detection_time) AS INT) AS day, CAST(hour(detection_time) AS INT) AS hour"""
_WAVES = """round(sin(month * pi() / 6), 6) AS month_sin, round(cos(month * pi() / 6), 6) AS month_cos,
  round(sin(hour * pi() / 12), 6) AS hour_sin, round(cos(hour * pi() / 12), 6) AS hour_cos"""
_GRID = "grid_x || '_' || grid_y || '_' || grid_z"
_PREP = _C + f""", u AS (SELECT DISTINCT * FROM r),
p AS (SELECT * REPLACE (coalesce(temperature_grain, avg(temperature_grain) OVER ()) AS temperature_grain,
    coalesce(temperature_inside, avg(temperature_inside) OVER ()) AS temperature_inside,
    last_value(grain_type IGNORE NULLS) OVER (PARTITION BY heap_id ORDER BY detection_time, row_id ROWS UNBOUNDED PRECEDING) AS grain_type),
  {_TIME}, {_GRID} AS grid_index FROM u)"""
_METRICS = """SELECT {by} CASE WHEN count(b) > 1 THEN round(CASE WHEN var_pop(b) = 0 THEN CASE WHEN sum(l) = 0 THEN 100.0 ELSE 0.0 END
    ELSE least(100.0, greatest(0.0, 100 * (1 - sum(l) / (var_pop(b) * count(b))))) END, 6) END AS confidence,
  round(CASE WHEN avg(abs(a - p) / nullif(a, 0)) IS NOT NULL THEN greatest(0.0, 100 - 100 * avg(abs(a - p) / nullif(a, 0))) END, 6) AS accuracy, round(sqrt(avg(pow(a - p, 2))), 6) AS rmse,
  round(avg(abs(a - p)), 6) AS mae, round(100 * avg(abs(a - p) / nullif(a, 0)), 6) AS mape, count(b) AS n
FROM (SELECT {by} temperature_grain AS a, predicted_temp AS p,
  CASE WHEN temperature_grain IS NOT NULL AND predicted_temp IS NOT NULL THEN temperature_grain END AS b,
  CASE WHEN temperature_grain IS NOT NULL AND predicted_temp IS NOT NULL THEN pow(temperature_grain - predicted_temp, 2) END AS l FROM {of})"""
_SCORES = ("confidence", "accuracy", "rmse", "mae", "mape")
_LIMIT = "CASE grain_type " + " ".join(f"WHEN '{g}' THEN {t}" for g, t in fc.THRESHOLDS.items()) + " ELSE 28.0 END"
_KEYS = ("row_id", "granary_id", "heap_id")
_STANDARD = _R + """ SELECT row_id, granary_id, heap_id, 'W' || heap_id AS warehouse_id,
  CASE WHEN row_id % 5 = 0 THEN date_trunc('second', detection_time) ELSE detection_time END AS detection_time,
  CASE WHEN row_id % 19 = 0 THEN NULL ELSE temperature_grain END AS temperature_grain, grid_x, grid_z AS layer_no,
  grid_x + 110.5e0 AS longitude, '一号库区' AS address_cn, humidity_outside FROM raw"""
_STANDARD_COLUMNS = (
    "granary_id", "heap_id", "warehouse_id", "detection_time", "temperature_grain", "grid_x", "layer_no",
    "longitude", "address_cn", "humidity_outside",
)


# ------------------------------------------------------------------ sources


@query("read_csv", _R + " SELECT row_id, heap_id, detection_time, temperature_grain, grain_type, '一号仓' || heap_id AS note FROM raw")
def _(spark, sf_dir):
    rows = sensor_readings(spark, sf_dir).select("row_id", "heap_id", "detection_time", "temperature_grain", "grain_type")
    rows = rows.withColumn("note", F.concat(F.lit("一号仓"), "heap_id"))
    path = scratch(spark, "gbk")
    rd.write_csv(rows, path, "GBK")
    return rd.read_csv(spark, path, rows.schema, "GBK")


@query("standardize", _STANDARD)
def _(spark, sf_dir):
    out = rd.standardize(_export(sensor_readings(spark, sf_dir)))
    return out.select(F.col("row_id").cast("long").alias("row_id"), *_STANDARD_COLUMNS)


@query("load_readings", _STANDARD)
def _(spark, sf_dir):
    path = scratch(spark, "export")
    rd.write_csv(_export(sensor_readings(spark, sf_dir)), path)
    return rd.load_readings(spark, path).select(F.col("row_id").cast("long").alias("row_id"), *_STANDARD_COLUMNS)


@query("read_dataset_dir", _R + " SELECT row_id, heap_id, granary_id AS dataset FROM raw WHERE granary_id <> 'G0'")
def _(spark, sf_dir):
    path = scratch(spark, "datasets")
    rows = sensor_readings(spark, sf_dir).select("row_id", "heap_id", "granary_id")
    for name in ("G0", "G1", "G2"):
        rd.write_csv(rows.where(F.col("granary_id") == name), f"{path}/{name}.csv")
    out = rd.read_dataset_dir(spark, path).where("dataset <> 'G0'")
    return out.select(F.col("row_id").cast("long").alias("row_id"), "heap_id", "dataset")


_NUMBERED = _R + """, f AS (SELECT * REPLACE (row_number() OVER (ORDER BY detection_time, row_id) - 1 AS row_id) FROM raw)"""


def _file(spark: SparkSession, sf_dir: str) -> str:
    """A CSV folder of the readings in time order, without their row_id."""
    path = scratch(spark, "unnumbered")
    rd.write_csv(sensor_readings(spark, sf_dir).orderBy(*ORDER).drop("row_id"), path)
    return path


@query("load_readings_numbered", _NUMBERED + " SELECT row_id, detection_time, heap_id, temperature_grain FROM f")
def _(spark, sf_dir):
    return rd.load_readings(spark, _file(spark, sf_dir)).select("row_id", "detection_time", "heap_id", "temperature_grain")


def _mixed(spark: SparkSession, sf_dir: str) -> str:
    """Three datasets: two orders of columns, and one with a column more."""
    path = scratch(spark, "mixed")
    rows = sensor_readings(spark, sf_dir).withColumn("extra", F.col("row_id") % 5)
    columns = {"G0": ("row_id", "heap_id", "temperature_outside"), "G1": ("temperature_outside", "row_id", "heap_id"),
               "G2": ("heap_id", "extra", "temperature_outside", "row_id")}
    for name, own in columns.items():
        rd.write_csv(rows.where(F.col("granary_id") == name).select(*own), f"{path}/{name}.csv")
    return path


@query("read_dataset_dir_mixed", _R + """ SELECT row_id, heap_id, temperature_outside, CASE WHEN granary_id = 'G2' THEN row_id % 5 END AS extra,
  granary_id AS dataset FROM raw""")
def _(spark, sf_dir):
    out = rd.read_dataset_dir(spark, _mixed(spark, sf_dir))
    numbers = {"row_id": "long", "extra": "long", "temperature_outside": "double"}
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in numbers.items()], "heap_id", "dataset")


@query("read_dataset_chosen", _R + " SELECT row_id, heap_id, temperature_outside FROM raw WHERE granary_id = 'G1'")
def _(spark, sf_dir):
    out = rd.read_dataset_dir(spark, _mixed(spark, sf_dir), "G1")
    return out.select(F.col("row_id").cast("long").alias("row_id"), "heap_id", F.col("temperature_outside").cast("double").alias("temperature_outside"))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export with unreadable and missing times and an unreadable number."""
    n, rows = F.col("row_id").cast("long"), _export(sensor_readings(spark, sf_dir))
    at = F.when(n % 37 == 0, "soon").when(n % 41 == 0, F.lit(None)).otherwise(F.col("batch"))
    return rows.withColumns({"batch": at, "x": F.when(n % 29 == 0, "left").otherwise(F.col("x"))})


@query("standardize_rejects", _R + """ SELECT * FROM (SELECT 'detection_time' AS "column", 'unreadable' AS reason, count(*) FILTER (row_id % 37 = 0) AS n FROM raw
UNION ALL SELECT 'detection_time', 'missing', count(*) FILTER (row_id % 37 <> 0 AND row_id % 41 = 0) FROM raw
UNION ALL SELECT 'grid_x', 'unreadable', count(*) FILTER (row_id % 29 = 0) FROM raw
UNION ALL SELECT 'temperature_grain', 'unreadable', count(*) FILTER (row_id % 19 = 0) FROM raw) WHERE n > 0""")
def _(spark, sf_dir):
    path = scratch(spark, "ingest")
    rd.ingest(_faulty(spark, sf_dir), path)
    return rd.quarantine(spark, path).groupBy("column", "reason").agg(F.count("*").alias("n"))


@query("ingest_accepted", _STANDARD + " WHERE row_id % 37 <> 0 AND row_id % 41 <> 0 AND row_id % 29 <> 0 AND row_id % 19 <> 0")
def _(spark, sf_dir):
    path = scratch(spark, "ingest")
    rd.ingest(_faulty(spark, sf_dir), path)
    return rd.ingested(spark, path).select(F.col("row_id").cast("long").alias("row_id"), *_STANDARD_COLUMNS)


@query("readings_store", _R + """ SELECT row_id, granary_id, heap_id, detection_time FROM raw WHERE heap_id = 'G1-H0'
  AND CAST(detection_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'""")
def _(spark, sf_dir):
    path = scratch(spark, "store")
    rows = sensor_readings(spark, sf_dir)
    rd.write_store(rows, path)
    rd.write_store(rows.where("day(detection_time) = 7"), path)  # a day that comes again replaces itself
    return rd.read_store(spark, path, "G1", "G1-H0", "2024-01-05", "2024-01-10").select(*_KEYS, "detection_time")


@query("weather_landed", _R + """ SELECT granary_id AS location, detection_time AS time, temperature_outside, humidity_outside FROM raw
WHERE granary_id = 'G1' AND detection_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'""")
def _(spark, sf_dir):
    path = scratch(spark, "weather")
    rows = sensor_readings(spark, sf_dir)
    named = F.col("granary_id").alias("location"), F.col("detection_time").alias("time")
    landing.land(rows.select(*named, "temperature_outside", "humidity_outside"), path)
    return landing.read_weather(spark, path, "G1", "2024-01-05 00:00:00", "2024-01-10 12:00:00")


@query("company_landed", _R + " SELECT DISTINCT granary_id, heap_id FROM raw WHERE granary_id = 'G1'")
def _(spark, sf_dir):
    path = scratch(spark, "company")
    heaps = sensor_readings(spark, sf_dir).select("granary_id", "heap_id").distinct()
    landing.land(heaps.withColumn("endpoint", F.lit("heaps")), path, ["endpoint"])
    return landing.read_entity(spark, path, "heaps", "granary_id string, heap_id string", {"granary_id": "G1"})


@query("write_csv_roundtrip", _R + " SELECT * FROM raw")
def _(spark, sf_dir):
    path = scratch(spark, "csv")
    rows = sensor_readings(spark, sf_dir)
    rd.write_csv(rows, path)
    return rd.read_csv(spark, path, rows.schema)


# ----------------------------------------------------------------- cleaning


@query("clean_markers", _C + f" SELECT {', '.join(_KEYS)}, temperature_grain, temperature_inside, grain_type FROM r")
def _(spark, sf_dir):
    return _clean(spark, sf_dir).select(*_KEYS, *TEMPS, "grain_type")


@query("clean_dedup", _C + " SELECT DISTINCT row_id, temperature_grain, temperature_inside FROM (FROM r UNION ALL FROM r WHERE row_id % 50 = 0)")
def _(spark, sf_dir):
    return _repeated(_clean(spark, sf_dir)).dropDuplicates().select("row_id", *TEMPS)


@query("clean_basic", _C + " SELECT DISTINCT * FROM r")
def _(spark, sf_dir):
    rows = _repeated(sensor_readings(spark, sf_dir)).withColumn("notes", F.lit("NA"))
    return cl.clean_basic(rows.toDF(*[f" {c} " for c in rows.columns]))


@query("fill_mean", _C + """ SELECT row_id, round(coalesce(temperature_grain, avg(temperature_grain) OVER ()), 6) AS temperature_grain,
  round(coalesce(temperature_inside, avg(temperature_inside) OVER ()), 6) AS temperature_inside FROM r""")
def _(spark, sf_dir):
    return _rounded(cl.fill_numeric(_clean(spark, sf_dir), TEMPS), *TEMPS).select("row_id", *TEMPS)


@query("fill_median", _C + """, m AS (SELECT quantile_cont(temperature_grain, 0.5) AS a, quantile_cont(temperature_inside, 0.5) AS b FROM r)
SELECT row_id, round(coalesce(temperature_grain, a), 6) AS temperature_grain,
  round(coalesce(temperature_inside, b), 6) AS temperature_inside FROM r, m""")
def _(spark, sf_dir):
    return _rounded(cl.fill_numeric(_clean(spark, sf_dir), TEMPS, "median"), *TEMPS).select("row_id", *TEMPS)


@query("fill_mode", _C + """ SELECT row_id, coalesce(grain_type, (SELECT grain_type FROM r WHERE grain_type IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, grain_type LIMIT 1)) AS grain_type FROM r""")
def _(spark, sf_dir):
    return cl.fill_mode(_clean(spark, sf_dir), ["grain_type"]).select("row_id", "grain_type")


def _along(how: str, limit: int | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = ["temperature_grain"] + ["grain_type"] * (how != "interpolate")
        out = cl.fill_along(_clean(spark, sf_dir), columns, ["heap_id"], ORDER, how, limit).select("row_id", *columns)
        return _rounded(out, "temperature_grain")

    return run


def _along_sql(how: str, limit: int | None) -> str:
    last = {"prev": "last_value({}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            "next": "first_value({}) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}
    columns = ["temperature_grain"] + ["grain_type"] * (how != "interpolate")
    near = ", ".join(
        f"{last[k].format(f'{c} IGNORE NULLS')} AS {k}_{c}, {last[k].format(f'CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS')} AS {k}_i_{c}"
        for c in columns for k in last
    )
    out = []
    for c in columns:
        p, n, pi, ni = f"prev_{c}", f"next_{c}", f"prev_i_{c}", f"next_i_{c}"
        value = {"ffill": p, "bfill": n, "interpolate": f"CASE WHEN {n} IS NULL THEN {p} ELSE {p} + ({n} - {p}) * (i - {pi}) / nullif({ni} - {pi}, 0) END"}[how]
        far = "true" if limit is None else f"{ni} - i <= {limit}" if how == "bfill" else f"i - {pi} <= {limit}"
        value = f"coalesce({c}, CASE WHEN {far} THEN {value} END)"
        out.append(f"{f'round({value}, 6)' if c == 'temperature_grain' else value} AS {c}")
    return _C + f""", n AS (SELECT *, row_number() OVER (PARTITION BY heap_id ORDER BY detection_time, row_id) AS i FROM r),
k AS (SELECT *, {near} FROM n WINDOW w AS (PARTITION BY heap_id ORDER BY i)) SELECT row_id, {', '.join(out)} FROM k"""


for _how, _limit in (("ffill", None), ("bfill", None), ("ffill", 2), ("bfill", 1), ("interpolate", None), ("interpolate", 1)):
    query(f"fill_{_how}" + "_limit" * (_limit is not None), _along_sql(_how, _limit))(_along(_how, _limit))


@query("prepare", _PREP + f""" SELECT row_id, round(temperature_grain, 6) AS temperature_grain, round(temperature_inside, 6) AS temperature_inside,
  grain_type, year, month, day, hour, {_WAVES}, grid_index FROM p""")
def _(spark, sf_dir):
    waves = ("month_sin", "month_cos", "hour_sin", "hour_cos")
    return _rounded(_prepared(spark, sf_dir), *TEMPS, *waves).select("row_id", *TEMPS, "grain_type", "year", "month", "day", "hour", *waves, "grid_index")


@query("prepare_file", _NUMBERED + f""", r AS ({_REPLACE.replace("FROM raw", "FROM f")})
SELECT row_id, heap_id, round(coalesce(temperature_grain, avg(temperature_grain) OVER ()), 6) AS temperature_grain,
  last_value(grain_type IGNORE NULLS) OVER (PARTITION BY heap_id ORDER BY detection_time, row_id ROWS UNBOUNDED PRECEDING) AS grain_type FROM r""")
def _(spark, sf_dir):
    out = md.prepare(rd.load_readings(spark, _file(spark, sf_dir)))
    return _rounded(out, "temperature_grain").select("row_id", "heap_id", "temperature_grain", "grain_type")


# ----------------------------------------------------------------- features


@query("time_features", _C + f", t AS (SELECT row_id, {_TIME} FROM r) SELECT *, {_WAVES} FROM t")
def _(spark, sf_dir):
    waves = ("month_sin", "month_cos", "hour_sin", "hour_cos")
    renamed = _clean(spark, sf_dir).withColumnRenamed("detection_time", "datetime")  # found by its usual name
    return _rounded(ft.time_features(renamed), *waves).select("row_id", "year", "month", "day", "hour", *waves)


_NULL_Z = "CASE WHEN row_id % 7 = 0 THEN NULL ELSE grid_z END"


@query("spatial_features", _C + f" SELECT row_id, grid_x || '_' || grid_y || '_' || ({_NULL_Z}) AS grid_index FROM r")
def _(spark, sf_dir):
    rows = _clean(spark, sf_dir).withColumn("grid_z", F.expr(_NULL_Z))
    return ft.spatial_features(rows).select("row_id", "grid_index")


@query("encode_labels", _C + """, l AS (SELECT grain_type, row_number() OVER (ORDER BY grain_type) - 1 AS code FROM (SELECT DISTINCT grain_type FROM r WHERE grain_type IS NOT NULL))
SELECT row_id, CAST(coalesce(code, -1) AS INT) AS grain_type_code FROM r LEFT JOIN l USING (grain_type)""")
def _(spark, sf_dir):
    return ft.encode_labels(_clean(spark, sf_dir), "grain_type").select("row_id", "grain_type_code")


@query("encode_with_dictionary", _S + """, l AS (SELECT grain_type, row_number() OVER (ORDER BY grain_type) - 1 AS code
  FROM (SELECT DISTINCT grain_type FROM train WHERE grain_type <> 'Soybeans'))
SELECT row_id, CAST(coalesce(code, -1) AS INT) AS grain_type FROM e LEFT JOIN l USING (grain_type)""")
def _(spark, sf_dir):
    train, held = fc.split(_clean(spark, sf_dir))
    dictionary = ft.fit_dictionary(train.where("grain_type <> 'Soybeans'"), ["grain_type", "warehouse_type"])
    return ft.encode(held, dictionary, ["grain_type"]).select("row_id", "grain_type")


_CODES = """CAST(CASE WHEN grain_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY grain_type NULLS LAST) - 1 END AS INT) AS grain_type,
  CAST(dense_rank() OVER (ORDER BY grid_index) - 1 AS INT) AS grid_index"""


@query("feature_matrix", _PREP + f" SELECT row_id, round(temperature_inside, 6) AS temperature_inside, {_CODES}, month, round(temperature_grain, 6) AS target FROM p")
def _(spark, sf_dir):
    out = ft.select_features(_prepared(spark, sf_dir))
    return _rounded(out, "temperature_inside", "target").select("row_id", "temperature_inside", "grain_type", "grid_index", "month", "target")


@query("preview", _PREP + f" SELECT row_id, {_CODES}, hour FROM p ORDER BY row_id LIMIT 100")
def _(spark, sf_dir):
    return ft.select_features(_prepared(spark, sf_dir)).select("row_id", "grain_type", "grid_index", "hour").orderBy("row_id").limit(100)


@query("align_features", _PREP + " SELECT row_id, grid_z, grid_x, year, CAST(0 AS DOUBLE) AS absent, round(temperature_inside, 6) AS temperature_inside FROM p")
def _(spark, sf_dir):
    out = ft.align_features(_prepared(spark, sf_dir), ["grid_z", "grid_x", "year", "absent", "temperature_inside"], ("row_id",))
    return _rounded(out, "temperature_inside")


@query("future_safe_projection", _C + " SELECT * EXCLUDE (temperature_inside, temperature_outside, humidity_warehouse, humidity_outside) FROM r")
def _(spark, sf_dir):
    return ft.future_safe(_clean(spark, sf_dir))


# ------------------------------------------------------- splits and filters


@query("split_train", _S + " SELECT row_id, heap_id FROM train")
def _(spark, sf_dir):
    return fc.split(_clean(spark, sf_dir))[0].select("row_id", "heap_id")


@query("split_eval", _S + " SELECT row_id, forecast_day FROM e")
def _(spark, sf_dir):
    return fc.split(_clean(spark, sf_dir))[1].select("row_id", "forecast_day")


@query("time_series_folds", _C + """, n AS (SELECT row_id, row_number() OVER (ORDER BY detection_time, row_id) - 1 AS row_index, count(*) OVER () AS n FROM r),
f AS (SELECT row_id, row_index, 5 - (n - 1 - row_index) // (n // 6) AS fold FROM n)
SELECT row_id, row_index, CAST(CASE WHEN fold >= 1 THEN fold END AS INT) AS fold FROM f""")
def _(spark, sf_dir):
    return assign_folds(_clean(spark, sf_dir), ORDER).select("row_id", "row_index", "fold")


@query("filter_warehouse", _C + " SELECT row_id, granary_id, heap_id FROM r WHERE granary_id = 'G1'")
def _(spark, sf_dir):
    return fc.filter_site(_clean(spark, sf_dir), "G1").select(*_KEYS)


@query("filter_silo", _C + " SELECT row_id, granary_id, heap_id FROM r WHERE granary_id = 'G1' AND heap_id = 'G1-H0'")
def _(spark, sf_dir):
    return fc.filter_site(_clean(spark, sf_dir), "G1", "G1-H0").select(*_KEYS)


@query("warehouse_silo_options", _C + " SELECT DISTINCT granary_id, heap_id FROM r WHERE granary_id IS NOT NULL AND heap_id IS NOT NULL ORDER BY 1, 2")
def _(spark, sf_dir):
    return _clean(spark, sf_dir).select("granary_id", "heap_id").na.drop().distinct().orderBy("granary_id", "heap_id")


# ------------------------------------------------------ metrics and reports


@query("forecast_summary", _S + """ SELECT forecast_day, round(avg(temperature_grain), 6) AS actual_mean, round(avg(predicted_temp), 6) AS pred_mean,
  round(100 * abs((avg(predicted_temp) - avg(temperature_grain)) / nullif(avg(temperature_grain), 0)), 6) AS pct_error, any_value(confidence) AS confidence_pct
FROM e JOIN (""" + _METRICS.format(by="forecast_day,", of="e") + " GROUP BY 1) USING (forecast_day) GROUP BY 1")
def _(spark, sf_dir):
    return _rounded(fc.forecast_summary(_evaluated(spark, sf_dir)), "actual_mean", "pred_mean", "pct_error", "confidence_pct")


@query("overall_metrics", _S + " " + _METRICS.format(by="", of="e"))
def _(spark, sf_dir):
    return _rounded(fc.overall_metrics(_evaluated(spark, sf_dir)), *_SCORES)


@query("metrics_by_silo", _S + " " + _METRICS.format(by="granary_id, heap_id,", of="e") + " GROUP BY 1, 2")
def _(spark, sf_dir):
    return _rounded(fc.overall_metrics(_evaluated(spark, sf_dir), ["granary_id", "heap_id"]), *_SCORES)


_RIVALS = {"heap": ["heap_id"], "probe": PROBE, "grain": ["grain_type"]}
_RIVALS_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS model, held.temperature_grain, m.p AS predicted_temp FROM held LEFT JOIN (SELECT {', '.join(by)}, avg(temperature_grain) AS p FROM train GROUP BY ALL) m ON "
    + " AND ".join(f"held.{c} IS NOT DISTINCT FROM m.{c}" for c in by)
    for k, by in _RIVALS.items()
)


@query("leaderboard", _S + f", rivals AS ({_RIVALS_SQL}), s AS (" + _METRICS.format(by="model,", of="rivals") + """ GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY confidence DESC NULLS LAST, accuracy DESC NULLS LAST, model) AS INT) AS rank, model, confidence, accuracy, rmse, mae FROM s""")
def _(spark, sf_dir):
    train, held = fc.split(_clean(spark, sf_dir))
    scored = [fc.mean_predictor(train, held, by).select("temperature_grain", "predicted_temp", F.lit(k).alias("model")) for k, by in _RIVALS.items()]
    metrics = fc.overall_metrics(scored[0].union(scored[1]).union(scored[2]), ["model"])
    return _rounded(fc.leaderboard(metrics), "confidence", "accuracy", "rmse", "mae")


_HOURLY = """, hourly AS (SELECT heap_id, grid_x, grid_y, grid_z, CAST(hour(detection_time) AS INT) AS hour, avg(temperature_grain) AS p FROM train GROUP BY ALL),
h AS (SELECT held.*, p AS predicted_temp FROM held LEFT JOIN hourly ON held.heap_id = hourly.heap_id AND held.grid_x = hourly.grid_x
  AND held.grid_y = hourly.grid_y AND held.grid_z = hourly.grid_z AND CAST(hour(held.detection_time) AS INT) = hourly.hour)"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = (df.withColumn("hour", F.hour("detection_time")) for df in fc.split(_clean(spark, sf_dir)))
    return fc.mean_predictor(train, held, ["heap_id", "grid_x", "grid_y", "grid_z", "hour"])


@query("alerts", _S + _HOURLY + f" SELECT row_id, grain_type, round(predicted_temp, 6) AS predicted_temp, CAST({_LIMIT} AS DOUBLE) AS threshold FROM h WHERE predicted_temp >= {_LIMIT}")
def _(spark, sf_dir):
    return _rounded(fc.alerts(_hourly(spark, sf_dir)), "predicted_temp").select("row_id", "grain_type", "predicted_temp", "threshold")


@query("alert_any", _S + _HOURLY + f""" SELECT granary_id, heap_id, bool_or(coalesce(predicted_temp >= {_LIMIT}, false)) AS alert,
  count(*) FILTER (predicted_temp >= {_LIMIT}) AS n_alerts FROM h GROUP BY 1, 2""")
def _(spark, sf_dir):
    return fc.alert_any(_hourly(spark, sf_dir))


@query("daily_series", _C + " SELECT CAST(detection_time AS DATE) AS day, round(avg(temperature_grain), 6) AS mean_temp, count(temperature_grain) AS n FROM r GROUP BY 1 ORDER BY 1")
def _(spark, sf_dir):
    return _rounded(fc.daily_series(_clean(spark, sf_dir)), "mean_temp").orderBy("day")


_ALL_ROWS = """, f AS (SELECT row_id, detection_time, forecast_day, temperature_grain, predicted_temp, false AS is_forecast FROM e
UNION ALL BY NAME SELECT row_id, detection_time, temperature_grain, false AS is_forecast FROM train
UNION ALL BY NAME SELECT detection_time, forecast_day, predicted_temp, true AS is_forecast FROM fut)"""


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = fc.split(_clean(spark, sf_dir))
    return fc.prediction_frame(train, fc.mean_predictor(train, held), fc.mean_predictor(train, fc.make_future(held, 3)))


_FUT_HELD = _future_sql("held", 3) + ", fut AS (SELECT fut0.*, predicted_temp FROM fut0 LEFT JOIN means USING (heap_id))"


@query("prediction_frame", _S + _FUT_HELD + _ALL_ROWS + " SELECT row_id, detection_time, forecast_day, temperature_grain, round(predicted_temp, 6) AS predicted_temp, is_forecast FROM f")
def _(spark, sf_dir):
    out = _rounded(_all_rows(spark, sf_dir), "predicted_temp")
    return out.select("row_id", "detection_time", "forecast_day", "temperature_grain", "predicted_temp", "is_forecast")


@query("forecast_series", _S + _FUT_HELD + _ALL_ROWS + """, k AS (SELECT max(CAST(detection_time AS DATE)) AS last FROM f WHERE temperature_grain IS NOT NULL)
SELECT CAST(detection_time AS DATE) AS day, 'actual' AS series, round(avg(temperature_grain), 6) AS mean_temp FROM f WHERE temperature_grain IS NOT NULL GROUP BY 1
UNION ALL SELECT CAST(detection_time AS DATE) AS day, CASE WHEN CAST(detection_time AS DATE) > last THEN 'future' ELSE 'eval' END AS series,
  round(avg(predicted_temp), 6) AS mean_temp FROM f, k WHERE predicted_temp IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf_dir):
    return _rounded(fc.split_series(_all_rows(spark, sf_dir)), "mean_temp")


@query("future_summary", _S + _FUT + " SELECT forecast_day, round(avg(predicted_temp), 6) AS pred_mean, round(max(predicted_temp), 6) AS pred_max, round(min(predicted_temp), 6) AS pred_min FROM fut GROUP BY 1")
def _(spark, sf_dir):
    return _rounded(fc.future_summary(_future(spark, sf_dir)), "pred_mean", "pred_max", "pred_min")


@query("prediction_stats", _S + " SELECT round(min(predicted_temp), 6) AS pred_min, round(avg(predicted_temp), 6) AS pred_mean, round(max(predicted_temp), 6) AS pred_max FROM e")
def _(spark, sf_dir):
    return _rounded(fc.prediction_stats(_evaluated(spark, sf_dir)), "pred_min", "pred_mean", "pred_max")


_DRIFT = ("grid_x", "grid_y", "grid_z", "year", "month", "day", "hour", "month_sin", "month_cos", "hour_sin", "hour_cos")
_DRIFT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs((SELECT avg({c}) FROM a) - (SELECT avg({c}) FROM b)), 6) AS abs_diff" for c in _DRIFT)
_DRIFT_ROWS = "SELECT *, sin(month * pi() / 6) AS month_sin, cos(month * pi() / 6) AS month_cos, sin(hour * pi() / 12) AS hour_sin, cos(hour * pi() / 12) AS hour_cos FROM (SELECT grid_x, grid_y, grid_z, " + _TIME + " FROM {})"


@query("feature_drift", _S + _FUT + f", a AS ({_DRIFT_ROWS.format('e')}), b AS ({_DRIFT_ROWS.format('fut')}) {_DRIFT_SQL} ORDER BY abs_diff DESC, feature LIMIT 20")
def _(spark, sf_dir):
    before = ft.time_features(fc.split(_clean(spark, sf_dir))[1])
    return _rounded(fc.feature_drift(before, _future(spark, sf_dir), list(_DRIFT)), "abs_diff")


_TENTH = "floor(({}) * 10 + 0.5) / 10"


@query("grid_snapshot", _S + f""" SELECT row_id, granary_id, heap_id, grid_x, grid_y, grid_z, round(coalesce(predicted_temp, temperature_grain), 6) AS value,
  round(predicted_temp - temperature_grain, 6) AS diff, concat_ws(' | ', 'Pred ' || format('{{:.1f}}', {_TENTH.format('predicted_temp')}),
  'Actual ' || format('{{:.1f}}', {_TENTH.format('temperature_grain')}), 'Δ ' || format('{{:+.1f}}', {_TENTH.format('predicted_temp - temperature_grain')})) AS label
FROM e WHERE forecast_day = 3""")
def _(spark, sf_dir):
    return _rounded(fc.grid_snapshot(_evaluated(spark, sf_dir), 3), "value", "diff")


# ----------------------------------------------------- frames of other days

_FRAME = f"""SELECT granary_id, heap_id, grid_x, grid_y, grid_z, grain_type, warehouse_type, detection_cycle, forecast_day, detection_time,
  {_TIME}, {_GRID} AS grid_index, CAST(NULL AS DOUBLE) AS temperature_grain FROM fut0"""


@query("future_frame", _C + _future_sql("r", 3) + " " + _FRAME)
def _(spark, sf_dir):
    return fc.make_future(_clean(spark, sf_dir), 3).drop("month_sin", "month_cos", "hour_sin", "hour_cos")


@query("gap_fill", _G + f""", ends AS (SELECT min(day) AS a, max(day) AS b FROM days),
missing AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day, a FROM ends),
gaps AS (SELECT day, CAST(datediff('day', a, day) + 1 AS INT) AS forecast_day FROM missing WHERE day NOT IN (SELECT day FROM days))
SELECT p.*, forecast_day, CAST(day AS TIMESTAMP) AS detection_time, round(predicted_temp, 6) AS predicted_temp, {_GRID} AS grid_index, true AS is_forecast
FROM (SELECT DISTINCT granary_id, heap_id, grid_x, grid_y, grid_z FROM train) p CROSS JOIN gaps LEFT JOIN means USING (heap_id)""")
def _(spark, sf_dir):
    train, held = fc.split(_gappy(spark, sf_dir))
    out = fc.mean_predictor(train, fc.gap_fill(train, held)).withColumn("is_forecast", F.lit(True))
    return _rounded(out, "predicted_temp").select(*PROBE, "forecast_day", "detection_time", "predicted_temp", "grid_index", "is_forecast")


@query("fill_missing_days", _S + _FUT + """ SELECT granary_id, heap_id, grid_x, grid_y, grid_z, forecast_day, detection_time, round(predicted_temp, 6) AS predicted_temp
FROM fut WHERE forecast_day IN (2, 4)""")
def _(spark, sf_dir):
    train, held = fc.split(_clean(spark, sf_dir))
    out = fc.mean_predictor(train, fc.fill_missing_days(held.where("forecast_day not in (2, 4)"), train))
    return _rounded(out, "predicted_temp").select(*PROBE, "forecast_day", "detection_time", "predicted_temp")


@query("gap_fill_no_probe", _G + """, ends AS (SELECT min(day) AS a, max(day) AS b FROM days),
missing AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day, a FROM ends)
SELECT CAST(day AS TIMESTAMP) AS detection_time, CAST(datediff('day', a, day) + 1 AS INT) AS forecast_day, CAST(NULL AS DOUBLE) AS temperature_grain
FROM missing WHERE day NOT IN (SELECT day FROM days)""")
def _(spark, sf_dir):
    train, held = fc.split(_gappy(spark, sf_dir).drop(*PROBE))  # one row stands for all probes
    return fc.gap_fill(train, held).select("detection_time", "forecast_day", "temperature_grain")


_GAPS = """, ends AS (SELECT min(day) AS a, max(day) AS b FROM days),
missing AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day, a FROM ends),
gaps AS (SELECT day, CAST(datediff('day', a, day) + 1 AS INT) AS offset_days FROM missing WHERE day NOT IN (SELECT day FROM days))"""


@query("evaluate_with_gaps", _G + _GAPS + """ SELECT row_id, granary_id, heap_id, grid_x, grid_y, grid_z, detection_time, forecast_day,
  CAST(datediff('day', a, CAST(detection_time AS DATE)) + 1 AS INT) AS eval_offset_days, temperature_grain, round(predicted_temp, 6) AS predicted_temp, false AS is_forecast
FROM e, ends
UNION ALL SELECT row_id, granary_id, heap_id, grid_x, grid_y, grid_z, detection_time, NULL, NULL, temperature_grain, NULL, false FROM train
UNION ALL SELECT NULL, p.*, CAST(day AS TIMESTAMP), offset_days, offset_days, NULL, round(predicted_temp, 6), true
FROM (SELECT DISTINCT granary_id, heap_id, grid_x, grid_y, grid_z FROM train) p CROSS JOIN gaps LEFT JOIN means USING (heap_id)""")
def _(spark, sf_dir):
    out = fc.evaluated_with_gaps(*fc.split(_gappy(spark, sf_dir)), fc.mean_predictor)
    columns = ("detection_time", "forecast_day", "eval_offset_days", "temperature_grain", "predicted_temp", "is_forecast")
    return _rounded(out, "predicted_temp").select("row_id", *PROBE, *columns)


def _again_sql(horizon: int) -> str:
    """Rows of one silo after an evaluation over ``horizon`` days."""
    return f"""SELECT {horizon} AS horizon, * FROM ({_C} {_split_sql(horizon)} {_future_sql("train", horizon)},
fut AS (SELECT fut0.*, predicted_temp FROM fut0 LEFT JOIN means USING (heap_id))
SELECT heap_id, forecast_day, temperature_grain, predicted_temp, false AS is_forecast FROM e
UNION ALL SELECT heap_id, forecast_day, NULL, predicted_temp, true FROM fut WHERE forecast_day NOT IN (SELECT forecast_day FROM e)) WHERE heap_id = 'G1-H0'"""


@query("reevaluate", f"""SELECT CAST(horizon AS INT) AS horizon, forecast_day, count(*) FILTER (NOT is_forecast) AS n_actual, count(*) FILTER (is_forecast) AS n_filled,
  round(avg(predicted_temp), 6) AS pred_mean, round(avg(abs(temperature_grain - predicted_temp)), 6) AS mae
FROM ({_again_sql(3)} UNION ALL {_again_sql(35)}) GROUP BY 1, 2""")
def _(spark, sf_dir):
    store, rows = rs.ResultStore(spark, scratch(spark, "results")), _clean(spark, sf_dir)
    parts = [rs.reevaluate(store, "heap mean", rows, fc.mean_predictor, h, "G1", "G1-H0") for h in (3, 35)]  # 30 days: the second is all filled
    out = rs.reevaluation_report(parts[0].unionByName(parts[1]))
    return _rounded(out, "pred_mean", "mae")


# ------------------------------------------------------------------- models

_SMALL = {"n_trees": 5, "maxDepth": 4, "measure": False}


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fc.split(_prepared(spark, sf_dir))


def _scored(model: md.Model, rows: DataFrame) -> DataFrame:
    return model.predict(rows).select("row_id", "temperature_grain", "predicted_temp")


def _trained(algo: str, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, held = _parts(spark, sf_dir)
        model = md.train(train, algo, **_SMALL | params)
        return _scored(model, held).withColumn("trees", F.lit(model.meta["trees"]))

    return run


query("train_rf")(_trained("rf"))
query("train_gbt")(_trained("hgb", n_trees=3, maxDepth=3))
query("train_gbt_early_stop")(_trained("hgb", n_trees=40, maxDepth=3, early_stop=True))
query("train_gb")(_trained("gb", n_trees=4))
query("train_gbt_sampled")(_trained("lgbm", n_trees=3, maxDepth=3))
query("predict")(_trained("rf", future_safe=True))


@query("time_series_cv")
def _(spark, sf_dir):
    return md.cross_validate(_prepared(spark, sf_dir), "rf", n_trees=3, n_splits=3, maxDepth=3).select("row_id", "fold", "predicted_temp")


@query("time_series_cv_metrics")
def _(spark, sf_dir):
    found = md.time_series_cv(_prepared(spark, sf_dir), "gb")
    pooled = fc.overall_metrics(found.predictions).select("mae", "rmse", "n")
    return pooled.withColumn("trees", F.lit(found.model.pipeline.stages[-1].getNumTrees))


@query("model_save_load", _S + " SELECT row_id, true AS agree FROM e")
def _(spark, sf_dir):
    train, held = _parts(spark, sf_dir)
    path = scratch(spark, "models")
    model = md.train(train, "rf", **_SMALL)
    name = md.save_model(model, path, md.model_name("Sensor Readings", "rf", 5))
    both = md.load_model(spark, name, f"{path}-absent", path).predict(model.predict(held).withColumnRenamed("predicted_temp", "before"))
    return both.select("row_id", F.col("before").eqNullSafe(F.col("predicted_temp")).alias("agree"))


@query("model_registry", """SELECT * FROM (VALUES ('sensor_readings_fs_rf_5', 'rf', 5, true), ('sensor_readings_rf_5', 'rf', 5, false))
  m(name, algo, n_trees, future_safe) WHERE EXISTS (SELECT 1 FROM events) ORDER BY name""")
def _(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    path = scratch(spark, "models")
    for safe in (False, True):
        model = md.train(train, "rf", future_safe=safe, **_SMALL)
        md.save_model(model, path, md.model_name("Sensor Readings", "rf", 5, safe))
    return md.list_models(spark, path, f"{path}-absent")


@query("evaluate_models")
def _(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    train, _ = fc.split(rows)
    models = {k: md.train(train, k, **_SMALL | {"n_trees": 2, "maxDepth": 3}) for k in ("rf", "lgbm")}
    return md.evaluate(models, rows)


@query("forecast")
def _(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    out = md.forecast(md.train(rows, "rf", future_safe=True, **_SMALL), rows)
    return out.select(*PROBE, "forecast_day", "detection_time", "predicted_temp", "is_forecast")
