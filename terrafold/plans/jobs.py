"""The usual end-to-end jobs, each a chain of operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.scalars import (
    KEYWORD_RULES,
    block_label,
    cell_identifier,
    feature_group_keyword,
    feature_group_prefix,
)
from terrafold.operators.binning import histogram
from terrafold.operators.compare import paired_deltas, paired_tests
from terrafold.operators.explain import (
    bias_summary,
    contribution_by_category,
    feature_importance,
    group_importance,
    indicator_contribution_summary,
    mean_abs_contribution,
    top_k_features,
    tree_contributions,
)
from terrafold.operators.folds import mean_baseline_cv, spatial_folds
from terrafold.operators.joins import pair_models, union_all
from terrafold.operators.metrics import (
    cv_report,
    error_by_observed_bin,
    mae_by_reference_bin,
    metrics_by_fold,
    metrics_by_model,
    metrics_by_model_category,
)
from terrafold.operators.prep import Prepared, prepare
from terrafold.operators.sampling import sample_exact_n, sample_per_group, stratified_sample
from terrafold.session import materialize
from terrafold.sources.climate import (
    CLIMATE_PARAMS,
    CLIMATE_PERIODS,
    enrich_climatology,
    ingest_climatology,
)
from terrafold.sources.grids import (
    DEPTH_WEIGHTS,
    SOIL_PROPERTIES,
    UNIT_DIVISORS,
    GridMeta,
    depth_weighted_mean,
    grid_to_points,
    rescale,
    sample_grid_at_points,
)


def sample_points(
    layers: Mapping[str, tuple[DataFrame, GridMeta]],
    n_zero: int = 10_000,
    n_nonzero: int = 40_000,
    q: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Stratified points of every crop layer, with cell identifiers."""
    placed = [
        grid_to_points(cells, grid).select(
            F.lit(crop).alias("crop"), "lat", "lon", "row", "col", "suitability"
        )
        for crop, (cells, grid) in layers.items()
    ]
    every = union_all(*placed).withColumn("cell_id", cell_identifier("crop", "row", "col"))
    drawn = stratified_sample(
        every, "crop", "suitability", "cell_id", n_zero, n_nonzero, q, seed, ["lat", "lon"]
    )
    return drawn.select("cell_id", "crop", "lat", "lon", "row", "col", "suitability")


def add_climate(
    points: DataFrame,
    responses: DataFrame,
    params: Sequence[str] = CLIMATE_PARAMS,
    periods: Sequence[str] = CLIMATE_PERIODS,
    scalar_params: Sequence[str] = (),
) -> DataFrame:
    """Points with climate columns and ``power_error``."""
    return enrich_climatology(points, ingest_climatology(responses, "cell_id", params, periods, scalar_params))


def add_soil(
    points: DataFrame,
    cells: DataFrame,
    grids: Mapping[str, GridMeta],
    properties: Sequence[str] = SOIL_PROPERTIES,
) -> DataFrame:
    """Points with one ``sg_{property}_0_30`` column per soil property.

    Layers are named ``{property}_{depth}``; all of them are sampled in one
    join per grid geometry, rescaled, and averaged over depth.
    """
    layers = {f"{p}_{d}": grids[f"{p}_{d}"] for p in properties for d in DEPTH_WEIGHTS}
    wide = sample_grid_at_points(points, cells, layers)
    wide = rescale(wide, {f"{p}_{d}": UNIT_DIVISORS[p] for p in properties for d in DEPTH_WEIGHTS})
    for p in properties:
        weights = {f"{p}_{d}": w for d, w in DEPTH_WEIGHTS.items()}
        wide = depth_weighted_mean(wide, weights, f"sg_{p}_0_30")
    return wide.drop(*layers)


def build_model_table(
    points: DataFrame,
    responses: DataFrame,
    soil_cells: DataFrame,
    soil_grids: Mapping[str, GridMeta],
    params: Sequence[str] = CLIMATE_PARAMS,
    periods: Sequence[str] = CLIMATE_PERIODS,
    properties: Sequence[str] = SOIL_PROPERTIES,
) -> Prepared:
    """Enrich points with climate and soil, then prepare them for modelling.

    The merged table is stored once, because preparation reads it for the
    medians, for the missing-value check and for the rows themselves.
    """
    merged = add_soil(add_climate(points, responses, params, periods), soil_cells, soil_grids, properties)
    return prepare(materialize(merged, "merged"), "cell_id")


def evaluate_mean_baseline(
    prepared: DataFrame,
    target: str = "suitability",
    row_id: str = "cell_id",
    blocks: Sequence[float] = (0.5, 2.0),
    k: int = 5,
) -> DataFrame:
    """Fold-mean and pooled scores of the mean baseline, one row per block size."""
    runs = []
    for degrees in blocks:
        folds = spatial_folds(prepared, degrees, k)
        name = f"mean_baseline_block{block_label(degrees)}"
        oof = mean_baseline_cv(folds, target, "fold", (row_id, "crop", "lat", "lon"), name)
        runs.append(cv_report(oof).withColumn("spatial_block_deg", F.lit(float(degrees))))
    return union_all(*runs)


@dataclass
class Comparison:
    """Reports over the stored predictions of two models."""

    by_fold: DataFrame
    by_model: DataFrame
    by_category: DataFrame
    by_observed_bin: DataFrame
    by_labelled_bin: DataFrame
    residual_histogram: DataFrame
    differences: DataFrame
    tests: DataFrame
    plot_sample: DataFrame


def compare_models(
    a: DataFrame, b: DataFrame, names: tuple[str, str] = ("A", "B"), q: int = 5, plot_rows: int = 20_000
) -> Comparison:
    """Every comparison report of two prediction tables; positive differences favour the second."""
    first, second = (t.withColumn("model", F.lit(n)) for t, n in zip((a, b), names))
    preds = materialize(union_all(first, second), "predictions")
    folds = materialize(metrics_by_fold(preds), "fold-scores")
    sides = [folds.where(F.col("model") == n).drop("model") for n in names]
    paired = pair_models(*sides, on="fold")
    deltas = paired_deltas(paired)
    return Comparison(
        by_fold=folds,
        by_model=metrics_by_model(preds),
        by_category=metrics_by_model_category(preds),
        by_observed_bin=error_by_observed_bin(preds, q),
        by_labelled_bin=mae_by_reference_bin(preds, names[0], models=list(names)),
        residual_histogram=histogram(preds, "residual", 40, -6000, 6000, ["model"]),
        differences=paired,
        tests=paired_tests(deltas),
        plot_sample=sample_per_group(preds, "model", "row_index", plot_rows),
    )


@dataclass
class Explanation:
    """Importances and contributions of one saved ensemble."""

    importances: DataFrame
    top: DataFrame
    grouped: DataFrame
    contributions: DataFrame
    mean_abs: DataFrame
    mean_abs_grouped: DataFrame
    by_category: DataFrame
    indicator: DataFrame
    bias: DataFrame


def explain_model(
    spark: SparkSession,
    prepared: DataFrame,
    model_path: str,
    features: Sequence[str],
    row_id: str = "cell_id",
    category: str = "crop",
    rows: int = 5_000,
    top: int = 30,
    rules=KEYWORD_RULES,
) -> Explanation:
    """Importances of the whole model and contributions over a sample of rows."""
    importances = materialize(feature_importance(spark, model_path, features), "importances")
    sample = sample_exact_n(prepared, row_id, rows)
    contribs = materialize(
        tree_contributions(sample, model_path, features, row_id, [category]), "contributions"
    )
    means = materialize(mean_abs_contribution(contribs), "mean-contributions")
    return Explanation(
        importances=importances,
        top=top_k_features(importances, top),
        grouped=group_importance(importances, feature_group_prefix("feature")),
        contributions=contribs,
        mean_abs=means,
        mean_abs_grouped=group_importance(
            means, feature_group_keyword("feature", rules), "mean_abs_contrib"
        ),
        by_category=contribution_by_category(contribs, category),
        indicator=indicator_contribution_summary(contribs),
        bias=bias_summary(contribs.select(row_id, "bias").distinct()),
    )
