"""Every operator as a query over the given tables, under its inventory name.

Each query reads whole tables. Measured doubles are rounded here, and only
here, so that sums taken in another order still compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import functions as fn
from terrafold import operators as op
from terrafold import sources as src
from terrafold.plans import fixtures as fx
from terrafold.session import materialize, scratch_path

TILE = 6  # rows and columns of a tile: 12 x 30 tiles

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 4, only: list[str] | None = None) -> DataFrame:
    """Round double columns; adding 0.0 turns -0.0 into 0.0."""
    doubles = [c for c, t in df.dtypes if t == "double" and (only is None or c in only)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in doubles})


# --- sources and sinks -------------------------------------------------------


@query
def read_table(spark, sf):
    return src.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query
def write_table(spark, sf):
    df = fx.points(spark, sf)
    path = scratch_path(spark, "points") + ".csv"
    src.write_table(df, path)
    return src.read_table(spark, path, df.schema)


@query
def read_model_ready(spark, sf):
    ready = op.prepare(fx.points(spark, sf).drop("n_lines"), "row_id", check=False)
    base = src.write_model_ready(
        ready.table, scratch_path(spark, "ready"), "v1", "row_id", "suitability",
        ["lat", "lon", "crop"], exclude=["cell_id"], report=ready.report,
    )
    table, listed = src.read_model_ready(spark, base, views=True)
    return table.select("row_id", "crop", "suitability", *listed["X_cols"])


@query
def write_model_ready(spark, sf):
    ready = op.prepare(fx.points(spark, sf).drop("n_lines"), "row_id", check=False)
    base = src.write_model_ready(
        ready.table, scratch_path(spark, "ready"), "v1", "row_id", "suitability",
        ["lat", "lon", "crop"], exclude=["cell_id"], report=ready.report,
    )
    return src.read_model_ready(spark, base)[0].drop("cell_id")


@query
def split_by_category_sink(spark, sf):
    path = scratch_path(spark, "by-crop")
    df = fx.points(spark, sf).select("row_id", "crop", "suitability")
    src.split_by_category_sink(df, "crop", path)
    return spark.read.parquet(path).where(F.col("category_key") == "wheat").drop("category_key")


@query
def read_predictions(spark, sf):
    read = []
    for model in ("A", "B"):
        path = scratch_path(spark, "preds") + ".csv"
        src.write_table(fx.predictions(spark, sf).where(F.col("model") == model).drop("model"), path)
        read.append(src.read_predictions(spark, path, model))
    return op.union_all(*read)


@query
def read_predictions_lenient(spark, sf):
    foreign = fx.predictions(spark, sf).select(
        F.col("fold").cast("string").alias("CV_Fold"), F.col("observed").alias("y_true"), F.col("predicted").alias("Pred")
    )
    out = src.read_predictions_lenient(foreign, "X")
    return rounded(op.regression_metrics(out, by=["model", "fold"]))


@query
def read_predictions_lenient_file(spark, sf):
    foreign = fx.predictions(spark, sf).select(
        F.col("predicted").alias("prediction"), F.col("model").alias("run"), F.col("fold").alias("Fold"), F.col("observed").alias("Y_True")
    )
    path = scratch_path(spark, "foreign") + ".csv"
    src.write_table(foreign.where("run = 'A'").drop("run"), path)
    other = scratch_path(spark, "foreign") + ".csv"
    src.write_table(foreign.where("run = 'B'").drop("run"), other)
    both = op.union_all(*[src.read_predictions_lenient(p, m, spark) for p, m in ((path, "A"), (other, "B"))])
    return rounded(op.regression_metrics(both, by=["model", "fold"]))


@query
def write_reports(spark, sf):
    folder = scratch_path(spark, "reports")
    scores = op.metrics_by_fold(fx.predictions(spark, sf))
    src.write_reports({"folds": rounded(scores)}, folder, "json")
    return spark.read.json(f"{folder}/folds.json").withColumn("fold", F.col("fold").cast("int"))


@query
def publish_reports_csv(spark, sf):
    """Two CSV reports published together, a set that fails half-way, and the first set read back."""
    folder = scratch_path(spark, "published")
    predictions = fx.predictions(spark, sf)
    by_fold = rounded(op.metrics_by_fold(predictions))
    src.publish_tables(spark, {"folds": by_fold, "models": rounded(op.metrics_by_model(predictions))}, folder, "csv")
    broken = by_fold.select(F.raise_error(F.lit("the second table fails")).cast("string").alias("broken"))
    try:
        src.publish_tables(spark, {"folds": by_fold.limit(0), "models": broken}, folder, "csv")
    except Exception as error:  # Spark raises its own types from within tasks
        if "the second table fails" not in str(error):
            raise
    return src.read_published(spark, folder)["folds"]


@query
def read_run_metrics(spark, sf):
    folder = scratch_path(spark, "runs")
    for row in fx.runs(spark, sf).collect():  # one row per run: two models, two block sizes
        r = row.asDict()
        spatial = {k.removeprefix("spatial_"): v for k, v in r.items()
                   if k.startswith("spatial_") and k != "spatial_block_deg"}
        record = {"run_name": r["run_name"], "model_name": r["model_name"],
                  "params": {"spatial_block_deg": r["spatial_block_deg"]}, "spatial_cv": spatial}
        src.write_run_metrics(spark, f"{folder}/{r['run_name']}.json", record)
    return rounded(src.read_run_metrics(spark, f"{folder}/*.json").drop("file"))


@query
def ingest_climatology(spark, sf):
    return src.ingest_climatology(fx.climate_responses(spark, sf), "cell_id", fx.PARAMS, fx.PERIODS)


@query
def ingest_climatology_single_numbers(spark, sf):
    """A parameter that the service reports as one number instead of one per period."""
    row = F.substring_index("cell_id", "_", -1).cast("long")
    added = F.concat(F.lit('"parameter":{"SNODP":'), (row % 50).cast("string"), F.lit(","))
    responses = fx.climate_responses(spark, sf).withColumn("body", F.replace("body", F.lit('"parameter":{'), added))
    return src.ingest_climatology(responses, "cell_id", fx.PARAMS, ["ANN"], ["SNODP"])


@query
def flatten_climatology(spark, sf):
    landed = fx.climate_responses(spark, sf).where("status = 200")
    return src.flatten_climatology(src.parse_climatology(landed), fx.PARAMS, fx.PERIODS).drop("body", "status")


@query
def grid_to_points(spark, sf):
    return src.grid_to_points(fx.grid_cells(spark, sf), fx.GRID)


# --- columns and filters -----------------------------------------------------


@query
def resolve_columns(spark, sf):
    df = fx.points(spark, sf).withColumnsRenamed({"lat": "Latitude", "lon": "LNG", "crop": "main_crop_code"})
    names = fn.resolve_columns(df)
    return df.select("row_id", *[F.col(c).alias(role) for role, c in names.items()])


@query
def select_by_keyword(spark, sf):
    df = fx.points(spark, sf)
    return df.select("row_id", *fn.select_by_keyword(df))


@query
def select_by_affix(spark, sf):
    df = fx.points(spark, sf)
    return df.select("row_id", *fn.select_by_affix(df, "sg_", "_0_30"))


@query
def require_columns(spark, sf):
    return fn.require_columns(fx.points(spark, sf), ["cell_id", "lat", "lon"]).select("cell_id", "lat", "lon")


@query
def drop_columns(spark, sf):
    drop = ["cell_id", "row", "col", "power_error", "lat", "lon", "n_lines", "power_lat"]
    return fn.drop_columns(fx.points(spark, sf), drop)


@query
def keep_numeric(spark, sf):
    return fn.keep_numeric(fx.points(spark, sf))[0].drop("n_lines")


@query
def drop_failed_rows(spark, sf):
    return op.drop_failed_rows(fx.points(spark, sf).select("row_id", "suitability", "power_error"))


@query
def drop_all_missing(spark, sf):
    df = fx.points(spark, sf).select("row_id", "sg_clay_0_30", "sg_sand_0_30")
    return op.drop_all_missing(df, ["sg_clay_0_30", "sg_sand_0_30"])


@query
def drop_counts(spark, sf):
    steps = {
        "failed": F.col("power_error").isNotNull(),
        "bare": F.col("sg_clay_0_30").isNull() & F.col("sg_sand_0_30").isNull(),
    }
    return rounded(op.drop_counts(fx.points(spark, sf), steps), 8)


@query
def dropna_subset(spark, sf):
    return op.dropna_subset(fx.points(spark, sf).select("row_id", "qty", "sg_clay_0_30"), ["qty", "sg_clay_0_30"])


@query
def finite_filter(spark, sf):
    odd = (F.when(F.col("row_id") % 19 == 0, F.lit(float("nan")))
           .when(F.col("row_id") % 23 == 0, F.lit(float("inf"))).otherwise(F.col("ext")))
    df = fx.points(spark, sf).select("row_id", "lat", "lon", odd.alias("measure"))
    return op.finite_filter(df, ["lat", "lon", "measure"])


@query
def category_filter(spark, sf):
    df = fx.points(spark, sf).select("row_id", F.initcap("crop").alias("crop"))
    return op.category_filter(df, "crop", "WHEAT")


@query
def coerce_numeric(spark, sf):
    text = F.when(F.col("row_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("suitability").cast("string"))
    df = fx.points(spark, sf).select("row_id", text.alias("score"))
    return op.coerce_numeric(df, ["score"])


@query
def assert_no_missing(spark, sf):
    df = fx.points(spark, sf).select("row_id", "lat", "lon", "suitability")
    return op.assert_no_missing(df)


# --- joins and unions --------------------------------------------------------


@query
def enrich_left(spark, sf):
    features = src.ingest_climatology(fx.climate_responses(spark, sf), "cell_id", ["T2M"], ["ANN"])
    left = fx.points(spark, sf).select("cell_id", "crop", "suitability")
    return op.enrich_left(left, features, "cell_id")


@query
def enrich_climatology(spark, sf):
    features = src.ingest_climatology(fx.climate_responses(spark, sf), "cell_id", ["T2M"], ["ANN"])
    lat = F.when(F.col("row_id") % 31 != 0, F.col("lat"))
    left = fx.points(spark, sf).select("cell_id", "crop", lat.alias("lat"), "lon")
    return src.enrich_climatology(left, features).drop("power_lon", "power_lat", "power_elevation_m")


@query
def sample_grid_at_points(spark, sf):
    spots = fx.points(spark, sf).select("row_id", "lat", "lon")
    return src.sample_grid_at_points(spots, fx.grid_cells(spark, sf), dict.fromkeys(fx.DEPTHS, fx.GRID))


@query
def sample_tiled_grid(spark, sf):
    """The same lookup from tiles, for points in a small region: few tiles are read."""
    cells = src.write_tiles(fx.grid_cells(spark, sf), scratch_path(spark, "tiled-grid"), TILE)
    return src.sample_grid_at_points(fx.stations(spark, sf), cells, dict.fromkeys(fx.DEPTHS, fx.GRID), tile=TILE)


@query
def depth_weighted_mean(spark, sf):
    spots = fx.points(spark, sf).select("row_id", "lat", "lon")
    wide = src.sample_grid_at_points(spots, fx.grid_cells(spark, sf), dict.fromkeys(fx.DEPTHS, fx.GRID))
    wide = src.rescale(wide, dict.fromkeys(fx.DEPTHS, 10))
    weights = {"0-5cm": 5 / 30, "5-15cm": 10 / 30, "15-30cm": 15 / 30}
    return rounded(src.depth_weighted_mean(wide, weights, "sg_clay_0_30").select("row_id", "sg_clay_0_30"), 6)


@query
def pair_models(spark, sf):
    scores = materialize(op.metrics_by_fold(fx.predictions(spark, sf)), "scores")
    a, b = (scores.where(F.col("model") == m).drop("model") for m in "AB")
    return rounded(op.pair_models(a, b, "fold"))


@query
def align_tables(spark, sf):
    df = fx.points(spark, sf)
    return op.align_tables(
        df.select("row_id", "qty"), df.select("row_id", "suitability"), df.select("row_id", "crop", "lat", "lon")
    )


@query
def category_bin_grid(spark, sf):
    bands = fx.points(spark, sf).withColumn("bin", F.floor(F.col("suitability") / 1000).cast("int"))
    counts = bands.groupBy("crop", "bin").agg(F.count(F.lit(1)).alias("n"))
    return op.category_bin_grid(counts, ["crop"], "bin", 11)


@query
def union_all(spark, sf):
    df = fx.points(spark, sf)
    wheat = df.where("crop = 'wheat'").select("row_id", "crop", "qty")
    maize = df.where("crop = 'maize'").select("crop", "row_id", "suitability")
    return op.union_all(wheat, maize)


# --- scalar expressions ------------------------------------------------------


@query
def encode_category(spark, sf):
    crop = F.when(F.col("row_id") % 5 == 0, F.initcap("crop")).when(F.col("row_id") % 7 != 0, F.col("crop"))
    df = fx.points(spark, sf).select("row_id", crop.alias("crop"))
    return df.withColumn("is_wheat", fn.encode_category("crop"))


@query
def spatial_block(spark, sf):
    return fx.points(spark, sf).select(
        "row_id", fn.spatial_block(2.0).alias("block_2"), fn.spatial_block(0.5).alias("block_05")
    )


@query
def clip_target(spark, sf):
    shifted = F.when(F.col("row_id") % 29 != 0, F.col("suitability") * 2 - 3000)
    return fx.points(spark, sf).select("row_id", fn.clip_target(shifted).alias("clipped"))


@query
def with_residuals(spark, sf):
    return fn.with_residuals(fx.predictions(spark, sf).select("model", "row_index", "observed", "predicted"))


@query
def feature_group_prefix(spark, sf):
    names = fx.contributions(spark, sf).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("feature_group", fn.feature_group_prefix("feature"))


@query
def feature_group_keyword(spark, sf):
    names = fx.contributions(spark, sf).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("feature_group", fn.feature_group_keyword("feature"))


# --- scores and reports ------------------------------------------------------


@query
def regression_metrics(spark, sf):
    return rounded(op.regression_metrics(fx.predictions(spark, sf)))


@query
def metrics_by_fold(spark, sf):
    return rounded(op.metrics_by_fold(fx.predictions(spark, sf)))


@query
def metrics_by_model(spark, sf):
    return rounded(op.metrics_by_model(fx.predictions(spark, sf)))


@query
def metrics_by_model_category(spark, sf):
    return rounded(op.metrics_by_model_category(fx.predictions(spark, sf)))


@query
def metrics_all_levels(spark, sf):
    return rounded(op.metrics_all_levels(fx.predictions(spark, sf)))


@query
def subgroup_metrics(spark, sf):
    return rounded(op.subgroup_metrics(fx.predictions(spark, sf)))


@query
def cv_summary(spark, sf):
    return rounded(op.cv_summary(op.metrics_by_fold(fx.predictions(spark, sf))))


@query
def cv_report(spark, sf):
    return rounded(op.cv_report(fx.predictions(spark, sf)))


@query
def error_by_observed_bin(spark, sf):
    return rounded(op.error_by_observed_bin(fx.predictions(spark, sf)))


@query
def error_by_observed_bin_single(spark, sf):
    return rounded(op.error_by_observed_bin(fx.predictions(spark, sf), edges_from="own"))


@query
def error_line_series(spark, sf):
    return rounded(op.error_line_series(op.error_by_observed_bin(fx.predictions(spark, sf))))


@query
def mae_by_reference_bin(spark, sf):
    return op.mae_by_reference_bin(fx.predictions(spark, sf), "A", models=["A", "B"])


@query
def mae_by_reference_bin_long(spark, sf):
    """The open-ended form, with a model that has no rows in the lower bins."""
    rows = fx.predictions(spark, sf)
    high = rows.where("model = 'B' and observed > 3000").withColumn("model", F.lit("high"))
    return op.mae_by_reference_bin(rows.unionByName(high), "A", empty_bins=True)


@query
def plot_extent(spark, sf):
    return op.plot_extent(fx.predictions(spark, sf), ["model"])


@query
def missing_profile(spark, sf):
    return op.missing_profile(fx.points(spark, sf), ["sg_clay_0_30", "sg_sand_0_30", "qty", "power_error", "crop"])


@query
def value_counts(spark, sf):
    return op.value_counts(fx.points(spark, sf), "power_error")


@query
def distinct_counts(spark, sf):
    df = fx.points(spark, sf).withColumn("block_id", fn.spatial_block(2.0))
    return op.distinct_counts(df, ["block_id", "crop", "sg_clay_0_30"], at_least=2)


@query
def describe_target(spark, sf):
    return rounded(op.describe_target(fx.points(spark, sf), "suitability", [0.1, 0.25, 0.5, 0.75, 0.9], ["crop"]))


@query
def zero_rate(spark, sf):
    return rounded(op.zero_rate(fx.points(spark, sf), "suitability", ["crop"], expected=0.2), 8)


@query
def median_impute(spark, sf):
    df = fx.points(spark, sf).select("row_id", "sg_clay_0_30", "sg_sand_0_30", "qty")
    return op.median_impute(df, ["sg_clay_0_30", "sg_sand_0_30", "qty"])


@query
def corr_with_target(spark, sf):
    return rounded(op.corr_with_target(fx.points(spark, sf), ["qty", "ext", "sg_clay_0_30", "sg_sand_0_30"], "suitability"), 6)


@query
def prep_report(spark, sf):
    soil = ["sg_clay_0_30", "sg_sand_0_30"]
    r = op.prep_report(fx.points(spark, sf), "suitability", soil)
    nested = [F.col(f"soil_missing_{when}_pct.{c}").alias(f"{when}_{c}") for when in ("before", "after") for c in soil]
    return rounded(r.select(*[c for c in r.columns if not c.startswith("soil_missing")], *nested), 6)


@query
def histogram(spark, sf):
    return rounded(op.histogram(fx.predictions(spark, sf), "residual", 40, -6000, 6000, ["model"]))


@query
def histogram_minmax(spark, sf):
    return rounded(op.histogram_minmax(fx.points(spark, sf), "suitability", 60, ["crop"]))


@query
def residual_histogram(spark, sf):
    return rounded(op.histogram_minmax(fx.predictions(spark, sf), "residual", 70, ["model"]))


@query
def boxplot_stats(spark, sf):
    return op.boxplot_stats(fx.points(spark, sf), "ext", "crop")


# --- samples and bins --------------------------------------------------------


@query
def stratified_sample(spark, sf):
    df = fx.points(spark, sf).select("row_id", "cell_id", "crop", "lat", "lon", "suitability")
    return op.stratified_sample(df, "crop", "suitability", "row_id", 8, 403, q=8, required=["lat", "lon"])


@query
def sample_exact_n(spark, sf):
    df = fx.points(spark, sf).select("row_id", "suitability", "qty")
    return op.sample_exact_n(df, "row_id", 1000)


@query
def sample_per_group(spark, sf):
    df = fx.predictions(spark, sf).select("model", "row_index", "observed", "predicted")
    return op.sample_per_group(df, "model", "row_index", 700)


@query
def random_split(spark, sf):
    return op.random_split(fx.points(spark, sf).select("row_id", "suitability"), "row_id")


@query
def quantile_bins(spark, sf):
    df = fx.points(spark, sf).where("suitability > 0").select("row_id", "crop", "suitability")
    return op.quantile_bins(df, "suitability", 8, ["crop"])


@query
def cut_by_edges(spark, sf):
    df = fx.points(spark, sf).select("row_id", "suitability")
    return op.cut_by_edges(df, "suitability", [0, 1000, 2500, 5000, 9000], ["low", "mid", "high", "top"], "band")


@query
def exact_quantiles(spark, sf):
    q = op.exact_quantiles(fx.points(spark, sf), "ext", [0.1, 0.5, 0.99], ["crop"], rows_per_task=1_000)
    return rounded(q.select("crop", "n", *[F.get("quantiles", F.lit(i)).alias(f"q{i}") for i in range(3)]), 6)


# --- folds and validation ----------------------------------------------------


@query
def group_kfold(spark, sf):
    return op.spatial_folds(fx.points(spark, sf), 10.0).select("row_id", "block_id", "fold")


@query
def fold_means(spark, sf):
    df = fx.points(spark, sf).withColumn("fold", (F.col("row_id") % 5 + 1).cast("int"))
    return rounded(op.fold_means(df, "suitability"))


@query
def mean_baseline_cv(spark, sf):
    folds = op.spatial_folds(fx.points(spark, sf), 10.0)
    oof = op.mean_baseline_cv(folds, "suitability")
    return rounded(op.metrics_by_fold(oof))


@query
def mean_baseline_folds(spark, sf):
    folds = op.spatial_folds(fx.points(spark, sf), 10.0)
    return rounded(op.mean_baseline_folds(folds, "suitability"))


@query
def mean_baseline_summary(spark, sf):
    folds = op.spatial_folds(fx.points(spark, sf), 10.0)
    return rounded(op.cv_summary(op.metrics_by_fold(op.mean_baseline_cv(folds, "suitability"))))


# --- model comparison --------------------------------------------------------


def _deltas(spark, sf):
    preds = fx.predictions(spark, sf)
    scores = materialize(op.regression_metrics(preds, by=["model", "crop", "fold"]), "scores")
    a, b = (scores.where(F.col("model") == m).drop("model") for m in "AB")
    return op.paired_deltas(op.pair_models(a, b, ["crop", "fold"]), ["crop", "fold"])


@query
def paired_deltas(spark, sf):
    return rounded(_deltas(spark, sf))


@query
def paired_tests(spark, sf):
    return rounded(op.paired_tests(_deltas(spark, sf), ["crop", "metric"]))


# --- explanations ------------------------------------------------------------


@query
def mean_abs_contribution(spark, sf):
    return rounded(op.mean_abs_contribution(fx.contributions(spark, sf)))


@query
def contribution_by_category(spark, sf):
    return rounded(op.contribution_by_category(fx.contributions(spark, sf)))


@query
def group_importance(spark, sf):
    imp = op.mean_abs_contribution(fx.contributions(spark, sf)).withColumnRenamed("mean_abs_contrib", "importance")
    return rounded(op.group_importance(imp, fn.feature_group_keyword("feature")))


@query
def indicator_contribution_summary(spark, sf):
    return rounded(op.indicator_contribution_summary(fx.contributions(spark, sf)))


@query
def bias_summary(spark, sf):
    rows = fx.predictions(spark, sf).select(F.col("predicted").alias("bias"))
    return rounded(op.bias_summary(rows))


@query
def top_k_features(spark, sf):
    return rounded(op.top_k_features(op.mean_abs_contribution(fx.contributions(spark, sf)), 3, "mean_abs_contrib"))


@query
def best_run_per_block(spark, sf):
    return rounded(op.best_run_per_block(fx.runs(spark, sf)))


# --- fitted models (no SQL equivalent) ---------------------------------------

FEATURES = ["qty", "sg_clay_0_30", "sg_sand_0_30", "lat", "is_wheat"]
SMALL_FOREST = {"n_estimators": 8, "max_depth": 5, "min_samples_leaf": 3}
SMALL_BOOSTED = {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.2, "max_bins": 64}


def _model_table(spark, sf):
    ready = op.prepare(fx.points(spark, sf).drop("n_lines", "ext"), "row_id", drop_location=False, check=False)
    return op.assert_no_missing(materialize(ready.table, "prepared"), FEATURES)


@query
def random_forest_cv(spark, sf):
    return op.random_forest_cv(
        op.spatial_folds(_model_table(spark, sf), 2.0), FEATURES, "suitability", **SMALL_FOREST
    )


@query
def boosted_trees_cv(spark, sf):
    return op.boosted_trees_cv(
        op.spatial_folds(_model_table(spark, sf), 2.0), FEATURES, "suitability", **SMALL_BOOSTED
    )


@query
def oof_predictions(spark, sf):
    folds = op.spatial_folds(_model_table(spark, sf), 2.0)
    return op.oof_predictions(folds, op.forest(**SMALL_FOREST), FEATURES, "suitability", model="forest")


@query
def oof_coverage(spark, sf):
    """Each point once, in the fold of its block, predicted within the target's range."""
    df = fx.points(spark, sf).select(
        "row_id", "crop", "lat", "lon", "suitability", F.coalesce("qty", F.lit(0.0)).alias("qty"),
        fn.encode_category("crop").alias("is_wheat"),
    )
    oof = op.oof_predictions(
        op.spatial_folds(df, 10.0), op.forest(4, 4), ["qty", "lat", "lon", "is_wheat"], "suitability"
    )
    return oof.select(
        "row_id", "crop", "fold", "observed",
        F.col("predicted").between(0, 10000).alias("in_range"),
        (F.col("residual") == F.col("observed") - F.col("predicted")).alias("consistent"),
    )


@query
def holdout_eval(spark, sf):
    return op.holdout_eval(
        _model_table(spark, sf), op.forest(**SMALL_FOREST), FEATURES, "suitability", "row_id"
    )[1]


@query
def random_search(spark, sf):
    grid = {"n_estimators": [4, 6], "max_depth": [3, 4], "min_samples_leaf": [1, 3], "max_features": ["sqrt", "log2"]}
    configs = op.param_sampler(spark, grid, 2)
    return op.random_search(
        _model_table(spark, sf), configs, [2.0], "forest", FEATURES, "suitability", k=3
    )


def _saved(spark, sf, estimator):
    model = op.full_fit(_model_table(spark, sf), estimator, FEATURES, "suitability")
    return src.save_model(model, scratch_path(spark, "model"))


@query
def save_load_model(spark, sf):
    table = _model_table(spark, sf)
    fitted = op.full_fit(table, op.forest(**SMALL_FOREST), FEATURES, "suitability")
    loaded = src.load_model(spark, src.save_model(fitted, scratch_path(spark, "model")))
    rows = fitted.transform(op.assemble(table, FEATURES, "suitability", ["row_id"]))
    both = loaded.setPredictionCol("reloaded").transform(rows)
    return both.select("row_id", "label", (F.col("predicted") == F.col("reloaded")).alias("same"))


@query
def feature_importance(spark, sf):
    return op.feature_importance(spark, _saved(spark, sf, op.forest(**SMALL_FOREST)), FEATURES)


@query
def full_fit(spark, sf):
    return op.feature_importance(spark, _saved(spark, sf, op.boosted_trees(**SMALL_BOOSTED)), FEATURES)


@query
def tree_contributions(spark, sf):
    path = _saved(spark, sf, op.boosted_trees(**SMALL_BOOSTED))
    return op.tree_contributions(
        _model_table(spark, sf), path, FEATURES, "row_id", ["crop"], spark.sparkContext.defaultParallelism
    )


@query
def contribution_additivity(spark, sf):
    """Distance between each prediction and its bias plus contributions."""
    table = _model_table(spark, sf)
    path = _saved(spark, sf, op.forest(**SMALL_FOREST))
    parts = op.tree_contributions(
        table, path, FEATURES, "row_id", partitions=spark.sparkContext.defaultParallelism
    )
    total = parts.groupBy("row_id").agg((F.sum("contribution") + F.first("bias")).alias("total"))
    rows = op.assemble(table, FEATURES, None, ["row_id", "crop"])
    scored = src.load_model(spark, path).transform(rows).select("row_id", "crop", "predicted")
    return rounded(
        scored.join(total, "row_id").select("row_id", "crop", F.abs(F.col("predicted") - F.col("total")).alias("gap")), 6
    )


@query
def cell_identifier(spark, sf):
    return fx.points(spark, sf).select(
        "row_id", fn.cell_identifier("crop", F.floor((75 - F.col("lat")) / 2), F.floor((F.col("lon") + 180) / 2)).alias("cell")
    )


@query
def best_run_of_block(spark, sf):
    """The best run of each block size, looked up one by one, under its file-name-safe block label."""
    runs = materialize(fx.runs(spark, sf), "runs")
    best = [op.best_run(runs, d) | {"label": fn.block_label(d)} for d in (5.0, 10.0)]  # two rows
    columns = ["run_name", "label", "spatial_rmse_mean"]
    return rounded(spark.createDataFrame([tuple(b[c] for c in columns) for b in best], "run_name string, label string, spatial_rmse_mean double"))


# --- fitted models that SQL can replay: single cuts of columns with few values ----

CUT_FEATURES = ["n_lines", "sg_clay_0_30", "sg_sand_0_30", "is_wheat"]
ONE_CUT = {"n_estimators": 1, "max_depth": 1, "max_features": "all", "bootstrap": False}
TWO_CUTS = {"n_estimators": 2, "max_depth": 1, "learning_rate": 1.0, "subsample": 1.0, "colsample_bytree": 1.0}


def _cut_table(spark, sf):
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CUT_FEATURES[:3]]
    return fx.points(spark, sf).select(
        "row_id", "crop", "lat", "lon", "suitability", *filled, fn.encode_category("crop").alias("is_wheat")
    )


def _cut_folds(spark, sf):
    return op.spatial_folds(_cut_table(spark, sf), 10.0)


@query
def random_forest_cv_one_cut(spark, sf):
    return rounded(op.random_forest_cv(_cut_folds(spark, sf), CUT_FEATURES, "suitability", **ONE_CUT))


@query
def boosted_trees_cv_two_cuts(spark, sf):
    return rounded(op.boosted_trees_cv(_cut_folds(spark, sf), CUT_FEATURES, "suitability", **TWO_CUTS))


@query
def oof_predictions_one_cut(spark, sf):
    return rounded(op.oof_predictions(_cut_folds(spark, sf), op.forest(**ONE_CUT), CUT_FEATURES, "suitability"))


@query
def holdout_eval_two_cuts(spark, sf):
    scores = op.holdout_eval(_cut_table(spark, sf), op.boosted_trees(**TWO_CUTS), CUT_FEATURES, "suitability", "row_id")[1]
    return rounded(scores)


@query
def random_search_one_cut(spark, sf):
    configs = [{"config_id": f"leaf{n}", "min_samples_leaf": n, **ONE_CUT} for n in (1, 400)]
    runs = op.random_search(_cut_table(spark, sf), configs, [10.0], "forest", CUT_FEATURES, "suitability")
    return rounded(runs.drop("file"))


@query
def run_folds_one_cut(spark, sf):
    """The fold tables that the runs of a search keep."""
    records = scratch_path(spark, "runs")
    configs = [{"config_id": f"leaf{n}", "min_samples_leaf": n, **ONE_CUT} for n in (1, 400)]
    op.random_search(_cut_table(spark, sf), configs, [10.0], "forest", CUT_FEATURES, "suitability", records=records, full_fits=False)
    return rounded(op.run_folds(spark, records))


def _two_cuts_saved(spark, sf):
    model = op.full_fit(_cut_table(spark, sf), op.boosted_trees(**TWO_CUTS), CUT_FEATURES, "suitability")
    return src.save_model(model, scratch_path(spark, "model"))


@query
def full_fit_two_cuts(spark, sf):
    """The root of each tree of the fitted model: its column, cut and rows."""
    nodes = op.node_table(spark, _two_cuts_saved(spark, sf)).where(F.col("left") >= 0)
    names = F.array(*[F.lit(f) for f in CUT_FEATURES])
    return rounded(nodes.select("tree", F.get(names, F.col("feature_index")).alias("feature"), "threshold",
                                F.col("rows").cast("long").alias("n_rows"), "gain", "weight"))


@query
def feature_importance_two_cuts(spark, sf):
    return rounded(op.feature_importance(spark, _two_cuts_saved(spark, sf), CUT_FEATURES), 6)


@query
def tree_contributions_two_cuts(spark, sf):
    path = _two_cuts_saved(spark, sf)
    return rounded(op.tree_contributions(_cut_table(spark, sf), path, CUT_FEATURES, "row_id", ["crop"]))


@query
def bias_summary_of_model(spark, sf):
    path = _two_cuts_saved(spark, sf)
    explained = op.tree_contributions(_cut_table(spark, sf), path, CUT_FEATURES, "row_id")
    return rounded(op.bias_summary(explained.where(F.col("feature") == CUT_FEATURES[0])))
