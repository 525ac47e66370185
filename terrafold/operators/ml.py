"""Tree-ensemble regressors under block cross-validation, on Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.columns import require_columns
from terrafold.functions.scalars import block_label, with_residuals
from terrafold.operators.explain import feature_importance
from terrafold.operators.folds import spatial_folds
from terrafold.operators.joins import union_all
from terrafold.operators.metrics import cv_summary, metrics_by_fold, regression_metrics
from terrafold.operators.sampling import random_split
from terrafold.session import materialize, scratch_path
from terrafold.sources.models import load_model, save_model
from terrafold.sources.tables import read_run_metrics, write_run_metrics

MAX_TREE_DEPTH = 30  # Spark ML's limit; stands for "no limit"
TASK_BYTES = 128_000_000  # of training rows as Spark ML holds them, in one task

# Search spaces of the two model families.
FOREST_GRID = {
    "n_estimators": [300, 500, 800, 1000],
    "max_depth": [None, 20, 30],
    "min_samples_leaf": [1, 2, 3, 5],
    "max_features": ["sqrt", "log2"],
}
BOOSTED_GRID = {
    "n_estimators": [400, 500, 600, 800],
    "max_depth": [6, 8, 10],
    "learning_rate": [0.03, 0.05, 0.07],
    "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.7, 0.8],
}


def forest(
    n_estimators: int = 300,
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    max_features: str = "sqrt",
    seed: int = 42,
    max_bins: int = 32,
    max_memory_mb: int = 1024,
    bootstrap: bool = True,
) -> RandomForestRegressor:
    """Random forest; a depth of None means Spark's deepest tree.

    Without ``bootstrap`` every tree sees every row once.

    Deep trees pass over the data once per group of open nodes, so the memory
    for node statistics is above Spark's default, and node ids are kept with
    the rows instead of being found again from the root.
    """
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="label",
        predictionCol="predicted",
        numTrees=int(n_estimators),
        maxDepth=MAX_TREE_DEPTH if max_depth is None else int(max_depth),
        minInstancesPerNode=int(min_samples_leaf),
        featureSubsetStrategy=str(max_features),
        seed=seed,
        maxBins=max_bins,
        maxMemoryInMB=max_memory_mb,
        bootstrap=bool(bootstrap),
        cacheNodeIds=True,
    )


def boosted_trees(
    n_estimators: int = 400,
    max_depth: int = 6,
    learning_rate: float = 0.05,
    subsample: float = 0.8,
    colsample_bytree: float = 0.8,
    reg_lambda: float | None = None,
    min_info_gain: float = 0.0,
    seed: int = 42,
    max_bins: int = 256,
) -> GBTRegressor:
    """Gradient-boosted trees on squared error.

    Spark draws the feature share per node instead of per tree, and has no
    leaf regularisation, so a ``reg_lambda`` other than None is refused.
    """
    if reg_lambda is not None:
        raise ValueError("Spark's boosted trees have no leaf regularisation: leave reg_lambda out")
    return GBTRegressor(
        featuresCol="features",
        labelCol="label",
        predictionCol="predicted",
        lossType="squared",
        maxIter=int(n_estimators),
        maxDepth=int(max_depth),
        stepSize=float(learning_rate),
        subsamplingRate=float(subsample),
        featureSubsetStrategy="all" if float(colsample_bytree) >= 1 else str(float(colsample_bytree)),
        minInfoGain=min_info_gain,
        seed=seed,
        maxBins=max_bins,
    )


FAMILIES = {"forest": forest, "boosted": boosted_trees}


def assemble(
    df: DataFrame, features: Sequence[str], target: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Project to ``keep``, a ``features`` vector and, with a target, ``label``."""
    require_columns(df, [*features, *keep, *([target] if target else [])])
    numbers = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    label = [F.col(target).cast("double").alias("label")] if target else []
    narrow = df.select(*keep, *label, *numbers)
    names = [f"_x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(narrow).drop(*names)


def _fit(estimator, rows: DataFrame, n_rows: int):
    """Fit on ``features`` and ``label`` of a stored table of ``n_rows`` rows.

    Every pass of a fit reads the rows as Spark ML holds them: unpacked, with a
    count and a node id for every tree, many times what they take on disk. So
    many rows are dealt evenly over partitions of about ``TASK_BYTES``.
    """
    rows = rows.select("features", "label")
    first = rows.select(F.size(vector_to_array("features"))).first()
    trees = estimator.getNumTrees() if isinstance(estimator, RandomForestRegressor) else 1
    needed = -(-n_rows * (224 + 12 * (first[0] if first else 0) + 8 * trees) // TASK_BYTES)
    if needed > 1:
        rows = rows.repartition(max(needed, rows.rdd.getNumPartitions()))
    return estimator.fit(rows)


def oof_predictions(
    df: DataFrame,
    estimator,
    features: Sequence[str],
    target: str,
    fold: str = "fold",
    keep: Sequence[str] = ("row_id", "crop", "lat", "lon"),
    model: str = "model",
    parallelism: int = 4,
) -> DataFrame:
    """Out-of-fold prediction of every row, in the predictions layout.

    The assembled table is stored once, partitioned by fold, so each fit
    skips the files of its test fold. Fits run side by side from driver
    threads.
    """
    table = assemble(df, features, target, [*dict.fromkeys([*keep, fold])])
    return _oof(materialize(table, "features", fold), estimator, fold, keep, model, parallelism)


def _oof(
    table: DataFrame, estimator, fold: str, keep: Sequence[str], model: str, parallelism: int
) -> DataFrame:
    """Out-of-fold predictions from a stored table with ``features`` and ``label``."""
    sizes = dict(table.groupBy(fold).count().collect())
    folds = sorted(sizes)
    n_rows = sum(sizes.values())

    def predict(k) -> DataFrame:
        fitted = _fit(estimator, table.where(F.col(fold) != k), n_rows - sizes[k])
        return fitted.transform(table.where(F.col(fold) == k))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(predict, folds))
    scored = union_all(*parts).select(
        F.col(fold).alias("fold"), *[c for c in keep if c != fold],
        F.col("label").alias("observed"), "predicted",
    )
    return with_residuals(scored).withColumn("model", F.lit(model))


def _fold_table(oof: DataFrame) -> DataFrame:
    scores = metrics_by_fold(oof)
    total = scores.select(F.sum("n_test").alias("n")).scalar()
    return scores.select("model", "fold", (total - F.col("n_test")).alias("n_train"), "n_test", "r2", "rmse", "mae")


def random_forest_cv(
    df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", parallelism: int = 4, **hp
) -> DataFrame:
    """Fold scores of a random forest: ``model, fold, n_train, n_test, r2, rmse, mae``."""
    oof = oof_predictions(df, forest(**hp), features, target, fold, (), "forest", parallelism)
    return _fold_table(materialize(oof, "oof"))


def boosted_trees_cv(
    df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", parallelism: int = 4, **hp
) -> DataFrame:
    """Fold scores of boosted trees, same layout as :func:`random_forest_cv`."""
    oof = oof_predictions(df, boosted_trees(**hp), features, target, fold, (), "boosted", parallelism)
    return _fold_table(materialize(oof, "oof"))


def full_fit(df: DataFrame, estimator, features: Sequence[str], target: str):
    """Fit on all rows and return the model."""
    table = materialize(assemble(df, features, target), "features")
    return _fit(estimator, table, table.count())


def holdout_eval(
    df: DataFrame,
    estimator,
    features: Sequence[str],
    target: str,
    key: str,
    test_size: float = 0.2,
    seed: int = 42,
):
    """Fit on the training rows of an exact random split; return model and test scores."""
    split = random_split(df, key, test_size, seed, "_test")
    table = materialize(assemble(split, features, target, ["_test"]), "features")
    train = table.where(~F.col("_test"))
    fitted = _fit(estimator, train, train.count())
    scored = fitted.transform(table.where("_test"))
    return fitted, regression_metrics(scored, "label", "predicted").withColumnRenamed("n", "n_test")


def random_search(
    df: DataFrame,
    configs: DataFrame | Sequence[Mapping],
    blocks: Sequence[float],
    family: str,
    features: Sequence[str],
    target: str,
    k: int = 5,
    lat: str = "lat",
    lon: str = "lon",
    parallelism: int = 4,
    records: str | None = None,
    full_fits: bool = True,
) -> DataFrame:
    """Score every configuration under every block size; one row per run.

    A finished run keeps its fold table, its model fitted on all rows and that model's
    feature importances (see :func:`run_folds`, :func:`run_importances`,
    :func:`run_model`; the latter two not without ``full_fits``). They go to a folder of their own for every attempt;
    the run's record (parameters and fold summary) is written last and names the folder.
    So a stopped search keeps what it has, and what an unfinished attempt left
    is never read. The runs table is read back from the records, and a run
    that is already recorded is not repeated.
    """
    spark = df.sparkSession
    records = (records or scratch_path(spark, "runs")).rstrip("/")
    # A configuration table is a few rows of a finite grid.
    listed = [r.asDict() for r in configs.collect()] if isinstance(configs, DataFrame) else [dict(c) for c in configs]
    fold_of = {b: f"fold_{block_label(b)}" for b in blocks}
    folded = df
    for b, name in fold_of.items():
        folded = spatial_folds(folded, b, k, lat, lon, name).drop("block_id")
    # One stored table serves every configuration and block size.
    table = materialize(assemble(folded, features, target, list(fold_of.values())), "search")
    n_rows = table.count()
    short = {"forest": "rf", "boosted": "gbt"}[family]
    done = run_artifacts(spark, records)

    def run(job) -> None:
        block, config = job
        hp = {name: v for name, v in config.items() if name != "config_id"}
        name = f"{short}_{config['config_id']}_block{block_label(block)}_rs"
        if name in done:
            return
        oof = _oof(table, FAMILIES[family](**hp), fold_of[block], (), name, 1)
        kept = f"{records}/artifacts/{name}-{uuid.uuid4().hex}"
        metrics_by_fold(oof).withColumnRenamed("model", "run_name").write.parquet(f"{kept}/folds")
        folds = spark.read.parquet(f"{kept}/folds").withColumnRenamed("run_name", "model")
        summary = cv_summary(folds).drop("model").first().asDict()
        if full_fits:
            save_model(_fit(FAMILIES[family](**hp), table, n_rows), f"{kept}/model")
            named = feature_importance(spark, f"{kept}/model", features).withColumn("run_name", F.lit(name))
            named.select("run_name", "feature", "importance", "share").write.parquet(f"{kept}/importance")
        write_run_metrics(
            spark,
            f"{records}/{name}.json",
            {
                "run_name": name,
                "model_name": type(FAMILIES[family]()).__name__,
                "n_rows": n_rows,
                "n_features_used": len(features),
                "params": hp | {"spatial_block_deg": float(block), "n_splits": k},
                "spatial_cv": summary,
                "artifacts": kept,
            },
        )

    jobs = [(b, c) for c in listed for b in blocks]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        list(pool.map(run, jobs))
    return read_run_metrics(spark, f"{records}/*.json")


def run_artifacts(spark: SparkSession, records: str) -> dict[str, str | None]:
    """Folder of the kept results of every recorded run; None for records that name none."""
    try:
        found = spark.read.option("multiLine", True).json(f"{records.rstrip('/')}/*.json")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # nothing recorded yet
            return {}
        raise
    if "run_name" not in found.columns:
        return {}
    folder = F.col("artifacts") if "artifacts" in found.columns else F.lit(None).cast("string")
    # One row per run of the search.
    return {r[0]: r[1] for r in found.where("run_name is not null").select("run_name", folder).collect()}


def _kept_tables(spark: SparkSession, records: str, name: str) -> DataFrame:
    folders = [f for f in run_artifacts(spark, records).values() if f]
    if not folders:
        raise ValueError(f"no recorded run under {records}")
    return spark.read.parquet(*[f"{f}/{name}" for f in folders])


def run_folds(spark: SparkSession, records: str) -> DataFrame:
    """Fold scores of all recorded runs: ``run_name, fold`` and the scores."""
    return _kept_tables(spark, records, "folds")


def run_importances(spark: SparkSession, records: str) -> DataFrame:
    """Importances of the full fits of all recorded runs: ``run_name, feature, importance, share``."""
    return _kept_tables(spark, records, "importance")


def run_model(spark: SparkSession, records: str, name: str):
    """The model of a recorded run, fitted on all rows."""
    folder = run_artifacts(spark, records).get(name)
    if folder is None:
        raise ValueError(f"no recorded run {name!r} under {records}")
    return load_model(spark, f"{folder}/model")


def best_run_per_block(
    runs: DataFrame, metric: str = "spatial_r2_mean", block: str = "spatial_block_deg"
) -> DataFrame:
    """The run with the highest metric for each block size; ties go to the first name."""
    scored = runs.where(F.col(metric).isNotNull() & F.col(block).isNotNull())
    best = scored.groupBy(block).agg(F.max(metric).alias("_best"))
    top = scored.join(best, block).where(F.col(metric) == F.col("_best"))
    first = top.groupBy(block).agg(F.min_by(F.struct(*runs.columns), F.col("run_name")).alias("_run"))
    return first.select("_run.*")


def best_run(runs: DataFrame, block_deg: float, **names: str) -> dict:
    """The best run of one block size as a dict; raises if that size was never run."""
    column = names.get("block", "spatial_block_deg")
    row = best_run_per_block(runs.where(F.col(column) == block_deg), **names).first()
    if row is None:
        raise ValueError(f"no run with {column} = {block_deg}")
    return row.asDict()
