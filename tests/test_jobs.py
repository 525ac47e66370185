"""The jobs end to end on small hand-made layers."""

from pyspark.sql import functions as F

from terrafold import operators as op
from terrafold import sources as src
from terrafold.plans import jobs

CROP_GRID = src.GridMeta(0.0, 40.0, 1.0, -1.0, nodata=-9)


def layer(spark, factor):
    cells = spark.range(1600).select(
        (F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"),
        F.when(F.col("id") % 5 == 0, 0).when(F.col("id") % 11 == 0, -9)
        .otherwise(F.col("id") * factor % 9000 + 1).cast("int").alias("value"),
    )
    return cells, CROP_GRID


def soil(spark):
    names = [f"{p}_{d}" for p in ("clay", "soc") for d in ("0-5cm", "5-15cm", "15-30cm")]
    grids = {n: src.GridMeta(0.0, 40.0, 2.0, -2.0, nodata=0) for n in names}
    cells = spark.range(400).select(
        (F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"),
        F.explode(F.array(*[F.lit(n) for n in names])).alias("grid_id"), F.col("id"),
    )
    value = F.when(F.col("id") % 40 == 0, 0).when((F.col("id") % 13 == 0) & F.col("grid_id").startswith("soc"), 0)
    return cells.withColumn("value", value.otherwise(F.col("id") + F.length("grid_id"))).drop("id"), grids


def test_from_layers_to_comparison(spark, tmp_path):
    points = jobs.sample_points({"wheat": layer(spark, 7), "maize": layer(spark, 13)}, 60, 240, 4).cache()
    assert points.columns == ["cell_id", "crop", "lat", "lon", "row", "col", "suitability"]
    assert points.count() == 600 and points.where("suitability = 0").count() == 120

    body = F.concat(
        F.lit('{"geometry":{"coordinates":[0,0]},"properties":{"elevation":5,"parameter":{"T2M":{"ANN":'),
        (F.col("suitability") / 100).cast("string"), F.lit("}}}}"),
    )
    failed = F.col("row") == 3
    responses = points.select(
        "cell_id", F.lit(1).alias("attempt"), F.when(failed, 503).otherwise(200).alias("status"),
        F.when(~failed, body).alias("body"),
    )
    cells, grids = soil(spark)
    ready = jobs.build_model_table(points, responses, cells, grids, ["T2M"], ["ANN"], ["clay", "soc"])
    assert ready.features == ["power_elevation_m", "T2M_ANN", "sg_clay_0_30", "sg_soc_0_30", "is_wheat"]
    r = ready.report.first()
    assert r["n_rows_in"] == 600 and r["dropped_failed_rows"] == points.where("row = 3").count()
    assert r["n_rows_out"] == ready.table.count() > 500

    base = jobs.evaluate_mean_baseline(ready.table, blocks=[5.0, 10.0])
    scores = {s["model"]: s for s in base.collect()}
    assert set(scores) == {"mean_baseline_block5p0", "mean_baseline_block10p0"}
    assert all(s["n"] == ready.table.count() and s["r2_mean"] <= 0 for s in scores.values())

    folds = op.spatial_folds(ready.table, 5.0)
    keep = ("cell_id", "crop", "lat", "lon")
    mean = op.mean_baseline_cv(folds, "suitability", "fold", keep)
    trees = op.oof_predictions(folds, op.forest(5, 4), ready.features, "suitability", keep=keep)
    out = jobs.compare_models(
        *[p.withColumnRenamed("cell_id", "row_index") for p in (mean, trees)], names=("mean", "forest"), plot_rows=50
    )
    assert out.by_model.first()["model"] == "forest"
    assert out.by_category.count() == 4 and out.by_fold.count() == 10
    assert all(t["n_folds"] == 5 and t["all_differences_positive"] for t in out.tests.collect())
    assert out.tests.where("wilcoxon_p_one_sided = 0.03125").count() == 3
    assert out.plot_sample.count() == 100 and out.residual_histogram.count() == 80
    assert [r["bin_label"] for r in out.by_labelled_bin.collect()] == ["Lowest", "Low-mid", "Middle", "High-mid", "Highest"]

    model = op.full_fit(ready.table, op.boosted_trees(5, 3, 0.3, max_bins=32), ready.features, "suitability")
    path = src.save_model(model, f"{tmp_path}/gbt")
    why = jobs.explain_model(spark, ready.table, path, ready.features, rows=100, top=2)
    assert why.top.first()["feature"] == "T2M_ANN" and why.top.count() == 2
    assert why.contributions.count() == 500 and why.mean_abs.first()["feature"] == "T2M_ANN"
    assert why.indicator.first()["feature_present"] and why.bias.first()["std_bias"] == 0.0
    assert {r["crop"] for r in why.by_category.collect()} == {"wheat", "maize"}
