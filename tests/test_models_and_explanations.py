import itertools
import math

import pytest
from pyspark.sql import functions as F

from terrafold import operators as op
from terrafold import sources as src
from terrafold.functions import feature_group_prefix
from terrafold.operators import ml
from terrafold.operators.explain import node_table
from terrafold.operators.ml import BOOSTED_GRID, FOREST_GRID

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("id")
    df = spark.range(1200).select(
        i.alias("row_id"),
        F.when(i % 2 == 0, "wheat").otherwise("maize").alias("crop"),
        (F.lit(-50.0) + (i * 37 % 1000) * 0.1).alias("lat"),
        (F.lit(-170.0) + (i * 91 % 3400) * 0.1).alias("lon"),
        ((i * 17) % 101).cast("double").alias("a"),
        ((i * 29) % 53).cast("double").alias("b"),
        (i % 2).cast("double").alias("c"),
    )
    y = F.col("a") * 3 + F.col("b") * F.col("b") / 10 + F.col("c") * 40
    return df.withColumn("y", y).cache()


@pytest.fixture(scope="module", params=["forest", "boosted"])
def saved(request, data, tmp_path_factory):
    est = (op.forest(6, 4, 2) if request.param == "forest" else op.boosted_trees(6, 3, 0.3, max_bins=64))
    model = op.full_fit(data, est, FEATURES, "y")
    path = src.save_model(model, str(tmp_path_factory.mktemp("m") / request.param))
    return request.param, model, path


def predicted(model, data):
    rows = op.assemble(data, FEATURES, None, ["row_id"])
    return {r["row_id"]: r["predicted"] for r in model.transform(rows).collect()}


def test_loaded_model_predicts_the_same(spark, data, saved):
    _, model, path = saved
    assert predicted(src.load_model(spark, path), data) == predicted(model, data)


def test_contributions_add_up(spark, data, saved):
    _, model, path = saved
    want = predicted(model, data)
    assert "a" in op.tree_contributions(data.limit(5), path, FEATURES, "row_id", ["a"]).columns
    parts = op.tree_contributions(data, path, FEATURES, "row_id", ["crop"])
    assert parts.columns == ["row_id", "crop", "feature", "value", "contribution", "bias"]
    total = parts.groupBy("row_id").agg((F.sum("contribution") + F.first("bias")).alias("t"), F.count("*").alias("n"))
    rows = total.collect()
    assert len(rows) == 1200 and all(r["n"] == 3 for r in rows)
    assert all(r["t"] == pytest.approx(want[r["row_id"]], abs=1e-6) for r in rows)


def test_several_blocks_give_the_same(spark, data, saved):
    _, _, path = saved
    few = data.where("row_id < 40")
    few = few.unionByName(few)  # copies of a key keep their rows
    one = op.tree_contributions(few, path, FEATURES).orderBy("row_id", "feature").collect()
    many = op.tree_contributions(few, path, FEATURES, leaves_per_block=20).orderBy("row_id", "feature").collect()
    assert [r["contribution"] for r in one] == pytest.approx([r["contribution"] for r in many], abs=1e-9)
    assert len(one) == len(many) == 40 * 2 * len(FEATURES)
    assert one[0]["bias"] == pytest.approx(many[0]["bias"])
    with pytest.raises(Exception, match="NULL or NaN"):
        op.tree_contributions(few.withColumn(FEATURES[0], F.lit(None).cast("double")), path, FEATURES).collect()


def test_contributions_equal_shapley_values_by_enumeration(spark, data, saved):
    kind, _, path = saved
    trees = {}
    for n in node_table(spark, path).collect():
        trees.setdefault(n["tree"], {})[n["node"]] = n

    def expected(nodes, n, x, known):
        if n["left"] < 0:
            return n["value"]
        left, right = nodes[n["left"]], nodes[n["right"]]
        if n["feature_index"] in known:
            return expected(nodes, left if x[n["feature_index"]] <= n["threshold"] else right, x, known)
        return (left["rows"] * expected(nodes, left, x, known) + right["rows"] * expected(nodes, right, x, known)) / n["rows"]

    def value(x, known):
        return sum(
            (1 / len(trees) if kind == "forest" else t[0]["weight"]) * expected(t, t[0], x, known)
            for t in trees.values()
        )

    sample = data.where("row_id in (0, 5, 77)")
    got = {(r["row_id"], r["feature"]): r["contribution"] for r in op.tree_contributions(sample, path, FEATURES).collect()}
    for row in sample.collect():
        x = [row[f] for f in FEATURES]
        for i, f in enumerate(FEATURES):
            others = [j for j in range(3) if j != i]
            phi = sum(
                math.factorial(s) * math.factorial(2 - s) / 6 * (value(x, {*c, i}) - value(x, set(c)))
                for s in range(3) for c in itertools.combinations(others, s)
            )
            assert got[row["row_id"], f] == pytest.approx(phi, abs=1e-6)


def test_importances(spark, saved):
    kind, model, path = saved
    rows = {r["feature"]: r for r in op.feature_importance(spark, path, FEATURES + ["unused"]).collect()}
    assert sum(r["importance"] for r in rows.values()) == pytest.approx(1.0) and rows["unused"]["importance"] == 0
    if kind == "forest":
        want = model.featureImportances.toArray()
        assert [rows[f]["importance"] for f in FEATURES] == pytest.approx(list(want))
    with pytest.raises(ValueError, match="only 1 names"):
        op.feature_importance(spark, path, ["a"])


def test_learners_beat_the_mean(spark, data):
    folds = op.spatial_folds(data, 20.0, 3)
    mean = op.cv_summary(op.metrics_by_fold(op.mean_baseline_cv(folds, "y"))).first()["rmse_mean"]
    for table in (
        op.random_forest_cv(folds, FEATURES, "y", n_estimators=5, max_depth=5),
        op.boosted_trees_cv(folds, FEATURES, "y", n_estimators=5, max_depth=3, learning_rate=0.3),
    ):
        rows = table.collect()
        assert len(rows) == 3 and all(r["n_train"] + r["n_test"] == 1200 for r in rows)
        assert op.cv_summary(table).first()["rmse_mean"] < mean / 2


def test_every_row_is_predicted_out_of_fold_once(spark, data):
    folds = op.spatial_folds(data, 20.0, 3)
    oof = op.oof_predictions(folds, op.forest(3, 3), FEATURES, "y", model="f")
    assert oof.count() == 1200 and oof.select("row_id").distinct().count() == 1200
    assert oof.join(folds.select("row_id", F.col("fold").alias("k")), "row_id").where("fold <> k").isEmpty()


def test_holdout_uses_the_exact_split(spark, data):
    model, scores = op.holdout_eval(data, op.forest(5, 5), FEATURES, "y", "row_id", 0.2)
    r = scores.first()
    assert r["n_test"] == 240 and r["r2"] > 0.5 and model.getNumTrees == 5


def test_search_records_runs_and_resumes(spark, data, tmp_path):
    configs = [{"config_id": "rs01", "n_estimators": 2, "max_depth": 3}, {"config_id": "rs02", "n_estimators": 2, "max_depth": 1}]
    folder = f"{tmp_path}/runs"
    runs = op.random_search(data, configs[:1], [10.0, 20.0], "forest", FEATURES, "y", 3, records=folder)
    assert {r["run_name"] for r in runs.collect()} == {"rf_rs01_block10p0_rs", "rf_rs01_block20p0_rs"}
    first = {r["run_name"]: r["spatial_r2_mean"] for r in runs.collect()}
    runs = op.random_search(data, configs, [10.0, 20.0], "forest", FEATURES, "y", 3, records=folder).collect()
    assert len(runs) == 4 and all(r["n_rows"] == 1200 and r["n_features_used"] == 3 for r in runs)
    assert all(r["spatial_r2_mean"] == first[r["run_name"]] for r in runs if r["run_name"] in first)
    best = {r["spatial_block_deg"]: r["run_name"] for r in op.best_run_per_block(spark.createDataFrame(runs)).collect()}
    assert best[10.0] == "rf_rs01_block10p0_rs"


def test_search_spaces_have_the_known_sizes():
    assert math.prod(map(len, FOREST_GRID.values())) == 96
    assert math.prod(map(len, BOOSTED_GRID.values())) == 216
    assert op.forest(max_depth=None).getMaxDepth() == 30
    b = op.boosted_trees(800, 10, 0.03, 0.8, 0.7)
    assert (b.getMaxIter(), b.getMaxDepth(), b.getStepSize(), b.getFeatureSubsetStrategy()) == (800, 10, 0.03, "0.7")


CONTRIBS = [
    (1, "Wheat", "is_wheat", 1.0, 4.0), (2, "maize", "is_wheat", 0.0, -2.0),
    (1, "Wheat", "T2M_ANN", 9.0, -1.0), (2, "maize", "T2M_ANN", 8.0, 3.0),
]


def test_contribution_tables(spark):
    c = spark.createDataFrame(CONTRIBS, "row_id int, crop string, feature string, value double, contribution double")
    means = {r["feature"]: (r["mean_abs_contrib"], r["importance_pct"]) for r in op.mean_abs_contribution(c).collect()}
    assert means == {"is_wheat": (3.0, 60.0), "T2M_ANN": (2.0, 40.0)}
    crop = {(r["crop"], r["feature"]): r["importance_pct"] for r in op.contribution_by_category(c).collect()}
    assert crop["wheat", "is_wheat"] == 80.0 and crop["maize", "T2M_ANN"] == 60.0
    s = op.indicator_contribution_summary(c).first()
    assert (s["overall_mean_contrib"], s["mean_contrib_when_1"], s["mean_contrib_when_0"]) == (1.0, 4.0, -2.0)
    assert (s["rows_when_1"], s["rows_when_0"], s["feature_present"]) == (1, 1, True)
    assert op.indicator_contribution_summary(c, "nope").first()["feature_present"] is False
    zero = op.mean_abs_contribution(c.withColumn("contribution", F.lit(0.0))).collect()
    assert all(r["importance_pct"] == 0.0 for r in zero)
    grouped = op.group_importance(
        op.mean_abs_contribution(c), feature_group_prefix("feature"), "mean_abs_contrib"
    ).collect()
    assert [(r["feature_group"], r["n_features"], r["share"]) for r in grouped] == [
        ("Crop indicator", 1, 0.6), ("Climate variables", 1, 0.4)]
    b = op.bias_summary(spark.createDataFrame([(1.0,), (3.0,)], "bias double")).first()
    assert (b["mean_bias"], b["std_bias"]) == (2.0, 1.0)


@pytest.mark.parametrize("family", ["forest", "boosted"])
def test_training_rows_are_dealt_over_bounded_partitions(data, monkeypatch, family):
    """Partitions of a fit follow the rows as Spark ML holds them, not the few files they were read from."""
    estimator, seen = ml.FAMILIES[family](2), []

    def fit(self, rows, params=None):
        seen.append([len(p) for p in rows.rdd.glom().collect()])

    monkeypatch.setattr(type(estimator), "fit", fit)
    rows = op.assemble(data, FEATURES, "y").coalesce(1)
    ml._fit(estimator, rows, 1200)
    monkeypatch.setattr(ml, "TASK_BYTES", 30_000)
    ml._fit(estimator, rows, 1200)
    assert seen[0] == [1200] and sum(seen[1]) == 1200 and len(seen[1]) > 8 and max(seen[1]) < 130
