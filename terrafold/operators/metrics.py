"""Regression scores and error reports over a predictions table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import require_columns
from terrafold.operators.binning import attach_edges, bin_by_edges, quantile_edges, with_interval_label


def score_columns(target: str = "observed", pred: str = "predicted") -> dict[str, Column]:
    """Aggregates for r2, rmse and mae, all from one pass over the complete pairs.

    A constant target scores 1 when it is met exactly and 0 otherwise; fewer
    than two complete pairs have no r2.
    """
    error = F.col(target) - F.col(pred)
    y = F.when(error.isNotNull(), F.col(target).cast("double"))
    n = F.count(error)
    sse = F.sum(error * error)
    spread = F.var_pop(y) * n
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(spread == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - sse / spread)
    )
    return {"r2": r2, "rmse": F.sqrt(F.avg(error * error)), "mae": F.avg(F.abs(error))}


def regression_metrics(
    df: DataFrame, target: str = "observed", pred: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """``by..., n, r2, rmse, mae``; n counts the pairs in which neither value is NULL."""
    scores = [c.alias(name) for name, c in score_columns(target, pred).items()]
    return df.groupBy(*by).agg(F.count(F.col(target) - F.col(pred)).alias("n"), *scores)


def metrics_by_fold(preds: DataFrame) -> DataFrame:
    """Scores of each model and fold: ``model, fold, n_test, r2, rmse, mae``."""
    require_columns(preds, ["model", "fold", "observed", "predicted"], "predictions")
    return regression_metrics(preds, by=["model", "fold"]).withColumnRenamed("n", "n_test")


def cv_summary(fold_metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and sample standard deviation of the fold scores, and the fold count."""
    aggs = []
    for m in ("r2", "rmse", "mae"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*by).agg(*aggs, F.count_distinct("fold").alias("n_splits"))


def cv_report(oof: DataFrame) -> DataFrame:
    """Per model: fold-mean summary next to the pooled out-of-fold scores, from one scan."""
    model, fold = F.col("model"), F.col("fold")
    scores = oof.groupingSets([[model, fold], [model]], model, fold).agg(
        F.grouping("fold").alias("_pooled"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(name) for name, c in score_columns().items()],
    )
    one_fold, pooled = F.col("_pooled") == 0, F.col("_pooled") == 1
    aggs = []
    for m in ("r2", "rmse", "mae"):
        of_fold = F.when(one_fold, F.col(m))
        aggs += [F.avg(of_fold).alias(f"{m}_mean"), F.stddev_samp(of_fold).alias(f"{m}_std")]
    overall = [F.max(F.when(pooled, F.col(m))).alias(f"overall_cv_{m}") for m in ("r2", "rmse", "mae")]
    return scores.groupBy("model").agg(
        *aggs, F.count_if(one_fold).alias("n_splits"), F.max(F.when(pooled, F.col("n"))).alias("n"), *overall
    )


def _model_columns(residual_std: bool = True) -> list[Column]:
    cols = [
        F.count(F.lit(1)).alias("n"),
        *[c.alias(name) for name, c in score_columns().items()],
        F.avg("observed").alias("mean_observed"),
        F.avg("predicted").alias("mean_predicted"),
        F.avg("residual").alias("mean_residual"),
    ]
    if residual_std:
        cols.append(F.stddev_samp("residual").alias("residual_std"))
    return [*cols, F.avg("abs_error").alias("mean_abs_error")]


def metrics_by_model(preds: DataFrame) -> DataFrame:
    """Scores and error summary per model, best r2 first."""
    return preds.groupBy("model").agg(*_model_columns()).orderBy(F.desc("r2"), "model")


def metrics_by_model_category(preds: DataFrame, category: str = "crop") -> DataFrame:
    """The same per model and category."""
    named = preds.where(F.col(category).isNotNull())
    return (
        named.groupBy("model", category)
        .agg(*_model_columns())
        .orderBy(F.asc(category), F.desc("r2"), "model")
    )


def metrics_all_levels(preds: DataFrame, category: str = "crop") -> DataFrame:
    """Both tables above from a single scan; ``level`` is ``model`` or ``category``."""
    m, c = F.col("model"), F.col(category)
    return (
        preds.groupingSets([[m, c], [m]], m, c)
        .agg(F.grouping(category).alias("_rolled"), *_model_columns())
        .where((F.col("_rolled") == 1) | F.col(category).isNotNull())
        .withColumn("level", F.when(F.col("_rolled") == 1, "model").otherwise("category"))
        .drop("_rolled")
    )


def subgroup_metrics(preds: DataFrame, by: str = "crop") -> DataFrame:
    """Scores and mean errors per subgroup, in subgroup order."""
    named = preds.where(F.col(by).isNotNull())
    return named.groupBy(by).agg(*_model_columns(residual_std=False)).orderBy(by)


def error_by_observed_bin(
    preds: DataFrame, q: int = 5, edges_from: str = "union", keep_empty: bool = True
) -> DataFrame:
    """Error summary per model and quantile bin of the observed value.

    ``edges_from`` is ``"union"`` (one set of edges over all rows, so models
    are compared on equal ranges), ``"own"`` (edges of each model alone) or
    the name of a model whose edges serve all. Bins without rows are kept with
    ``n = 0`` and their label, in either mode, unless ``keep_empty`` is false.
    """
    by = ["model"] if edges_from == "own" else []
    source = preds if edges_from in ("union", "own") else preds.where(F.col("model") == edges_from)
    edges = quantile_edges(source, "observed", q, by)
    binned = bin_by_edges(preds, "observed", edges, q + 1, by)
    # Only fixed-width values are aggregated, which keeps this a hash aggregation.
    report = (
        binned.where(F.col("bin").isNotNull())
        .groupBy("model", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("observed").alias("observed_min"),
            F.max("observed").alias("observed_max"),
            F.avg("observed").alias("observed_mean"),
            F.avg("predicted").alias("predicted_mean"),
            F.avg("residual").alias("residual_mean"),
            F.stddev_samp("residual").alias("residual_std"),
            F.avg("abs_error").alias("abs_error_mean"),
            F.avg("squared_error").alias("squared_error_mean"),
        )
    )
    # Every model with all bins of its edges, whether rows fall into them or not.
    limits = edges if by else attach_edges(report.select("model").distinct(), edges)
    numbers = F.explode(F.sequence(F.lit(0), F.size("edges") - 2))
    grid = limits.where(F.size("edges") > 1).select("model", "edges", numbers.alias("bin"))
    grid = grid.select(
        "model", "bin", F.get("edges", F.col("bin")).alias("bin_lo"), F.get("edges", F.col("bin") + 1).alias("bin_hi")
    )
    full = with_interval_label(grid).drop("bin_lo", "bin_hi").join(report, ["model", "bin"], "left" if keep_empty else "inner")
    measures = [c for c in report.columns if c not in ("model", "bin", "n")]
    return full.select("model", "bin", "bin_label", F.coalesce("n", F.lit(0)).alias("n"), *measures)


# Names of the five observed-value bins, lowest first.
BIN_LABELS = ["Lowest", "Low-mid", "Middle", "High-mid", "Highest"]


def mae_by_reference_bin(
    preds: DataFrame,
    reference: str,
    labels: Sequence[str] = BIN_LABELS,
    models: Sequence[str] | None = None,
    digits: int = 2,
    empty_bins: bool = False,
) -> DataFrame:
    """Mean absolute error per labelled bin, models side by side.

    Edges are the observed quantiles of ``reference`` and serve every model.
    Raises when ties leave fewer bins than labels. Without ``models`` the report
    is long, ``bin, bin_label, model, mae`` for every model there is;
    with ``empty_bins`` it has every bin of every model, NULL where there are no rows.
    """
    q = len(labels)
    edges = quantile_edges(preds.where(F.col("model") == reference), "observed", q)
    found = edges.select(F.size("edges") - 1).first()[0]
    if found != q:
        raise ValueError(f"{q} labels do not match {found} distinct bins")
    binned = bin_by_edges(preds, "observed", edges, q + 1).where(F.col("bin").isNotNull())
    if models is None:
        name = F.get(F.array(*[F.lit(x) for x in labels]), F.col("bin"))
        long = binned.groupBy("bin", "model").agg(F.round(F.avg("abs_error"), digits).alias("mae"))
        if not empty_bins:
            return long.select("bin", name.alias("bin_label"), "model", "mae").orderBy("bin", "model")
        each = F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("bin", "bin_label")
        every = preds.select("model").dropna().distinct().select("model", each)
        return every.join(long, ["bin", "model"], "left").select("bin", "bin_label", "model", "mae").orderBy("bin", "model")
    measured = binned.groupBy("bin").agg(
        *[F.avg(F.when(F.col("model") == m, F.col("abs_error"))).alias(f"mae_{m}") for m in models]
    )
    names = F.array(*[F.lit(x) for x in labels])
    # The label grid comes from the stored edge row, so absent bins stay visible.
    grid = edges.select(F.posexplode(names).alias("bin", "bin_label"))
    return (
        grid.join(measured, "bin", "left")
        .select("bin", "bin_label", *[F.round(f"mae_{m}", digits).alias(f"mae_{m}") for m in models])
        .orderBy("bin")
    )


def plot_extent(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shared minimum and maximum of observed and predicted values."""
    return preds.groupBy(*by).agg(
        F.least(F.min("observed"), F.min("predicted")).alias("extent_min"),
        F.greatest(F.max("observed"), F.max("predicted")).alias("extent_max"),
    )


def error_line_series(report: DataFrame) -> DataFrame:
    """Error and residual lines over the mean observed value, from a per-bin report."""
    return report.select("model", "bin", "observed_mean", "abs_error_mean", "residual_mean")
