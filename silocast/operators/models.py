"""Tree models on readings: training, cross-validation, storage, evaluation, forecasts.

Spark's trees bin features, so results are near to, not equal to, those of
other tree libraries. Categories are coded by a dictionary that is fitted on
the training rows and saved with the model.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silocast.functions import features as ft
from silocast.operators import forecast as fc
from silocast.operators.cleaning import clean_basic, fill_missing
from silocast.operators.ordering import assign_folds, row_order, with_row_index
from silocast.operators.results import ResultStore
from silocast.sources.storage import stored

TARGET = "temperature_grain"
ALGORITHMS = ("rf", "hgb", "gb", "lgbm")
#: folds of a cross-validation, and how many of its models are fitted at once
SPLITS, AT_ONCE = 5, 6
#: rows of vectors that one task of a fit holds (about 11 MB in each of up to four caches)
TASK_ROWS = 100_000
#: tasks of models fitted side by side for each core: their rows stay cached
CORE_TASKS = 8
#: the share of last rows that boosting is stopped by
STOP_SHARE = 0.1


def prepare(df: DataFrame, by: list[str] = ("heap_id",), order: list[str] | None = None) -> DataFrame:
    """Cleaned, filled and with time and grid features, stored: what trains and
    predicts on it reads one file. Needs no row_id; see ``row_order``."""
    clean = stored(clean_basic(df), "clean")
    filled = fill_missing(clean, by=by, order=order or row_order(clean, ft.time_column(clean)))
    return stored(ft.spatial_features(ft.time_features(filled)), "prepared")


@dataclass
class Model:
    """A fitted pipeline and what it needs to be applied to other frames."""

    pipeline: PipelineModel
    dictionary: DataFrame
    features: list[str]
    text: list[str]
    meta: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with predicted_temp; its own columns stay as they are. Absent
        features count as 0, and so do nulls."""
        own = [F.col(c).alias(f"_f_{c}") if c in df.columns else F.lit(0.0).alias(f"_f_{c}") for c in self.features]
        coded = _numeric(df.select("*", *own), self.features, [c for c in self.text if c in df.columns], self.dictionary)
        return self.pipeline.transform(coded).select(*df.columns, F.col("prediction").alias("predicted_temp"))


def _numeric(df: DataFrame, names: list[str], text: list[str], dictionary: DataFrame) -> DataFrame:
    """``df`` with the columns _f_... of ``names`` as doubles, ``text`` coded."""
    levels = dictionary.withColumn("column", F.concat(F.lit("_f_"), "column"))
    coded = ft.encode(df, levels, [f"_f_{c}" for c in text]) if text else df
    return coded.withColumns({f"_f_{c}": F.coalesce(F.col(f"_f_{c}").cast("double"), F.lit(0.0)) for c in names})


def regressor(algo: str, n_trees: int, **params):
    """The tree learner of a short name: random forest, histogram boosting,
    classic boosting, or boosting on sampled features. Forests grow as deep as
    Spark's trees can (30)."""
    common = {"featuresCol": "_features", "labelCol": TARGET, "seed": 42}
    if algo == "rf":
        return RandomForestRegressor(**common | {"numTrees": n_trees, "featureSubsetStrategy": "all", "maxDepth": 30} | params)
    if algo in ("hgb", "gb"):
        own = {"maxBins": 255, "minInstancesPerNode": 20, "maxDepth": 5} if algo == "hgb" else {"maxDepth": 3}
        return GBTRegressor(**common | {"maxIter": n_trees, "stepSize": 0.1} | own | params)
    if algo == "lgbm":
        return GBTRegressor(**common | {"maxIter": n_trees, "stepSize": 0.05, "featureSubsetStrategy": "0.8", "maxDepth": 5} | params)
    raise ValueError(f"unknown algorithm {algo!r}")


@dataclass
class _Design:
    """Readings as feature vectors, stored, and how they were made."""

    data: DataFrame
    assembler: VectorAssembler
    dictionary: DataFrame
    names: list[str]
    text: list[str]

    def fit(self, rows: DataFrame, algo: str, n_trees: int, params: dict, early_stop: bool = False, beside: int = 1):
        """A learner fitted to ``rows`` of ``data`` that have a target. With
        ``early_stop`` the last of them (STOP_SHARE) are set apart and boosting
        ends when their error grows no smaller. The learner caches its rows by
        partition, so more than TASK_ROWS are dealt out evenly first. Of
        ``beside`` fits that run at once each has tasks for its share of the
        cores, or more where TASK_ROWS call for them: to store what a tree
        leaves costs each task nearly the same, however few its rows."""
        rows = rows.where(F.col(TARGET).isNotNull())
        if early_stop:
            cut = rows.approxQuantile("row_index", [1 - STOP_SHARE], 0.001)
            rows = rows.withColumn("_held", F.col("row_index") > F.lit(cut[0] if cut else 0.0))
            params = params | {"validationIndicatorCol": "_held"}
        n = -(-rows.count() // TASK_ROWS)
        share = max(1, rows.sparkSession.sparkContext.defaultParallelism // beside)
        if n > 1:
            rows = rows.repartition(max(n, share), *[c for c in ("row_index",) if c in rows.columns])
        elif beside > 1:
            rows = rows.coalesce(share)
        return regressor(algo, n_trees, **params).fit(rows)

    def model(self, learned) -> Model:
        return Model(PipelineModel(stages=[self.assembler, learned]), self.dictionary, self.names, self.text)


def _design(rows: DataFrame, keep: list[str] = ()) -> _Design:
    """The vectors of ``rows``; categories are coded by all of them."""
    skip = (*ft.NOT_FEATURES, "row_id", "row_index", "fold", "is_forecast", "predicted_temp", "eval_offset_days", "dataset")
    names = [c for c in rows.columns if c not in skip]
    text = [c for c, t in rows.dtypes if t == "string" and c in names]
    empty = "column string, level string, code int"
    dictionary = ft.fit_dictionary(rows, text) if text else rows.sparkSession.createDataFrame([], empty)
    own = rows.select(*dict.fromkeys([*keep, TARGET]), *[F.col(c).alias(f"_f_{c}") for c in names])
    assembler = VectorAssembler(inputCols=[f"_f_{c}" for c in names], outputCol="_features")
    data = assembler.transform(_numeric(own, names, text, dictionary)).drop(*[f"_f_{c}" for c in names])
    return _Design(stored(data, "vectors"), assembler, dictionary, names, text)


def errors(df: DataFrame) -> dict:
    """Mean absolute error and RMSE of ``predicted_temp``."""
    r = fc.overall_metrics(df).first()
    return {"mae": r["mae"], "rmse": r["rmse"]}


def train(
    df: DataFrame, algo: str = "rf", n_trees: int = 200, future_safe: bool = False, test_size: float = 0.2,
    order: list[str] | None = None, train_until=None, measure: bool = True, early_stop: bool | None = None, **params,
) -> Model:
    """A model of prepared readings. A random forest learns from the first 80 %
    along ``order`` and is measured on the rest; boosting on sampled features
    learns from all and is measured on the same rows (``in_sample``); the other
    kinds learn from all and are measured by cross-validation. ``early_stop``
    (default: for histogram boosting) ends boosting by its last rows in time;
    meta has the number of ``trees`` that came of it. ``train_until``: later
    days are left out. Without ``measure`` the model comes without errors."""
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algo!r}")
    if train_until is not None:
        df = df.where(F.to_date("detection_time") <= F.lit(train_until).cast("date"))
    rows = ft.future_safe(df) if future_safe else df
    order = list(order or row_order(rows))
    early_stop = algo == "hgb" if early_stop is None else early_stop and algo != "rf"
    meta = {"algo": algo, "n_trees": n_trees, "future_safe": future_safe, "early_stop": early_stop, "params": params}
    # the place in time matters for what is set apart only
    indexed = with_row_index(rows, order) if algo == "rf" or early_stop else rows
    if algo == "rf":
        n = indexed.count()
        cut = n - -(-int(round(n * test_size * 1e6)) // 1_000_000)
        design = _design(indexed.where(F.col("row_index") < cut), ["row_index"])
    else:
        design = _design(indexed, ["row_index"] if early_stop else [])
    learned = design.fit(design.data, algo, n_trees, params, early_stop)
    model = design.model(learned)
    meta["trees"] = learned.getNumTrees
    if measure and algo == "rf":
        meta |= errors(model.predict(indexed.where(F.col("row_index") >= cut))) | {"measured": "last_rows"}
    elif measure and algo == "lgbm":
        meta |= errors(model.predict(rows)) | {"measured": "in_sample"}
    elif measure:
        found = time_series_cv(rows, algo, n_trees, SPLITS, order, early_stop=early_stop, refit=False, **params)
        meta |= found.errors | {"measured": "cross_validation"}
    model.meta = meta
    return model


@dataclass
class CrossValidation:
    """Rows of all folds with ``fold`` and ``predicted_temp``, their pooled
    errors, and the model fitted to all rows, if asked for."""

    predictions: DataFrame
    errors: dict
    model: Model | None


def time_series_cv(
    df: DataFrame, algo: str = "hgb", n_trees: int = 300, n_splits: int = SPLITS, order: list[str] | None = None,
    early_stop: bool = False, refit: bool = True, at_once: int = AT_ONCE, **params,
) -> CrossValidation:
    """Expanding-window cross-validation: each fold is predicted by a model of
    all earlier rows. The vectors of all folds are made and stored once; up to
    ``at_once`` models are fitted side by side, those of most rows first, each
    in a scheduler pool of its own, so that small stages of one fill the gaps
    of another where the scheduler is FAIR. Fits that fill the cores by
    themselves run one after another, so the cached rows stay within
    CORE_TASKS for each core or those of one fit."""
    spark = df.sparkSession
    rows = assign_folds(df, list(order or row_order(df)), n_splits)
    design = _design(rows, [*df.columns, "row_index", "fold"])
    data = design.data
    parts = data.groupBy("fold").agg(F.min("row_index").alias("first"), F.count("*").alias("n")).collect()
    starts = {r["fold"]: r["first"] for r in parts if r["fold"] is not None}
    jobs = [(None, data)] * bool(refit and starts) + [(f, data.where(F.col("row_index") < starts[f])) for f in sorted(starts, reverse=True)]
    tasks = max(1, -(-sum(r["n"] for r in parts) // TASK_ROWS))
    at_once = max(1, min(at_once, CORE_TASKS * spark.sparkContext.defaultParallelism // tasks))

    @inheritable_thread_target(spark)
    def fit(fold, part):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{fold}")
        try:
            return fold, design.fit(part, algo, n_trees, params, early_stop, min(at_once, len(jobs)))
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as pool:
        fitted = dict(pool.map(lambda job: fit(*job), jobs))
    keep = [*df.columns, "row_index", "fold"]
    out = [m.transform(data.where(F.col("fold") == f)).select(*keep, F.col("prediction").alias("predicted_temp")) for f, m in reversed(fitted.items()) if f is not None]
    none = rows.where("false").withColumn("predicted_temp", F.lit(None).cast("double")).select(*keep, "predicted_temp")
    predictions = stored(reduce(DataFrame.union, out), "folds") if out else none
    return CrossValidation(predictions, errors(predictions), design.model(fitted[None]) if None in fitted else None)


def cross_validate(df: DataFrame, algo: str = "hgb", n_trees: int = 300, n_splits: int = SPLITS, order: list[str] | None = None, **params) -> DataFrame:
    """The rows of all folds with their predictions; see ``time_series_cv``."""
    return time_series_cv(df, algo, n_trees, n_splits, order, refit=False, **params).predictions


# ------------------------------------------------------------------ storage


def model_name(dataset: str, algo: str, n_trees: int, future_safe: bool = False) -> str:
    """The name that a model gets: dataset in lower case, kind, size."""
    return f"{dataset.lower().replace(' ', '_')}_{'fs_' if future_safe else ''}{algo}_{n_trees}"


def save_model(model: Model, path: str, name: str) -> str:
    """Writes the pipeline, the dictionary and one row of metadata."""
    spark = model.dictionary.sparkSession
    model.pipeline.write().overwrite().save(f"{path}/{name}/pipeline")
    model.dictionary.write.mode("overwrite").parquet(f"{path}/{name}/dictionary")
    meta = json.dumps({"name": name, "features": model.features, "text": model.text, **model.meta})
    spark.createDataFrame([(name, meta)], "name string, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/meta")
    return name


def load_model(spark: SparkSession, name: str, *paths: str) -> Model | None:
    """The model ``name`` of the first of ``paths`` that has it, else None."""
    for path in paths:
        try:
            meta = json.loads(spark.read.parquet(f"{path}/{name}/meta").first()["meta"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        dictionary = spark.read.parquet(f"{path}/{name}/dictionary")
        return Model(PipelineModel.load(f"{path}/{name}/pipeline"), dictionary, meta.pop("features"), meta.pop("text"), meta)
    return None


def list_models(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, algo, n_trees, future_safe): the distinct models of all ``paths``,
    by name; a path without models adds none."""
    found = []
    for path in paths:
        try:
            found.append(spark.read.parquet(f"{path}/*/meta").select("name", "meta"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    none = spark.createDataFrame([], "name string, meta string")
    out = reduce(DataFrame.union, found, none).dropDuplicates(["name"])
    parsed = F.from_json("meta", "algo string, n_trees int, future_safe boolean").alias("m")
    return out.select("name", parsed).select("name", "m.*").orderBy("name")


# --------------------------------------------------------------- composites


def predictor(model: Model) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """``model`` as a function of training rows and rows to predict."""
    return lambda train_rows, rows: model.predict(ft.future_safe(rows) if model.meta.get("future_safe") else rows)


def evaluate(models: dict[str, Model], df: DataFrame, horizon: int = 5, store: ResultStore | None = None) -> DataFrame:
    """Metrics per model over one shared split, in one aggregation. With a
    ``store`` the predictions of each model stay there, those of calendar days
    without readings among them."""
    shared = fc.split(df, horizon)
    # of a model that has nothing to predict a row without metrics remains
    none = df.select(*[F.lit(None).cast("double").alias(c) for c in ("temperature_grain", "predicted_temp")]).limit(1)
    scored = [none.withColumn("model", F.lit(name)) for name in models]
    for name, m in models.items():
        if store is None:  # training rows have no prediction, gaps no temperature: no metric counts either
            rows = m.predict(ft.future_safe(shared[1]) if m.meta.get("future_safe") else shared[1])
        else:
            store.put(fc.evaluated_with_gaps(*shared, predictor(m)), name, horizon)
            rows = store.get(name, horizon)
        scored.append(rows.select("temperature_grain", "predicted_temp", F.lit(name).alias("model")))
    return fc.overall_metrics(reduce(DataFrame.union, scored), ["model"])


def forecast(model: Model, df: DataFrame, horizon: int = 7) -> DataFrame:
    """Predictions of every probe for the ``horizon`` days to come."""
    future = fc.make_future(ft.future_safe(df) if model.meta.get("future_safe") else df, horizon)
    return model.predict(future).withColumn("is_forecast", F.lit(True))
