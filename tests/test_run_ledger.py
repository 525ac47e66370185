"""What the runs of a search keep, also when it is stopped half-way."""

import pytest
from pyspark.sql import functions as F

from terrafold import operators as op
from terrafold import sources as src
from terrafold.operators import ml

FEATURES = ["a", "b"]
CONFIGS = [{"config_id": f"rs{n}", "n_estimators": 2, "max_depth": n} for n in (1, 3)]


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("id")
    df = spark.range(400).select(
        i.alias("row_id"), (F.lit(-50.0) + (i * 37 % 1000) * 0.1).alias("lat"), (F.lit(-170.0) + (i * 91 % 3400) * 0.1).alias("lon"),
        ((i * 17) % 101).cast("double").alias("a"), ((i * 29) % 53).cast("double").alias("b"),
    )
    return df.withColumn("y", F.col("a") * 3 + F.col("b")).cache()


def search(data, records):
    return op.random_search(data, CONFIGS, [20.0], "forest", FEATURES, "y", 3, parallelism=1, records=records)


def tables(spark, records):
    return [sorted(map(str, t(spark, records).collect())) for t in (op.run_folds, op.run_importances)]


def test_a_stopped_search_gives_the_same_tables(spark, data, tmp_path, monkeypatch):
    whole, stopped = f"{tmp_path}/whole", f"{tmp_path}/stopped"
    runs = search(data, whole)
    names = [r["run_name"] for r in runs.orderBy("run_name").collect()]
    assert names == ["rf_rs1_block20p0_rs", "rf_rs3_block20p0_rs"]
    folds = op.run_folds(spark, whole)
    assert folds.count() == 6 and folds.agg(F.sum("n_test")).first()[0] == 800
    means = {r["run_name"]: r["m"] for r in folds.groupBy("run_name").agg(F.avg("r2").alias("m")).collect()}
    assert means == pytest.approx({r["run_name"]: r["spatial_r2_mean"] for r in runs.collect()})
    shares = op.run_importances(spark, whole).groupBy("run_name").agg(F.sum("importance").alias("s"), F.count("*").alias("n")).collect()
    assert len(shares) == 2 and all(r["s"] == pytest.approx(1) and r["n"] == 2 for r in shares)
    assert op.run_model(spark, whole, names[1]).getNumTrees == 2

    write, calls = ml.write_run_metrics, []

    def fail_second(*args):
        calls.append(args[1])
        if len(calls) == 2:
            raise OSError("stopped")
        write(*args)

    monkeypatch.setattr(ml, "write_run_metrics", fail_second)
    with pytest.raises(OSError, match="stopped"):
        search(data, stopped)
    monkeypatch.setattr(ml, "write_run_metrics", write)
    assert list(op.run_artifacts(spark, stopped)) == names[:1]  # the second run's tables are there, but no record names them
    assert op.run_folds(spark, stopped).count() == 3
    search(data, stopped)
    assert tables(spark, stopped) == tables(spark, whole)


def test_unknown_runs_raise(spark, tmp_path):
    assert op.run_artifacts(spark, f"{tmp_path}/none") == {}
    with pytest.raises(ValueError, match="no recorded run"):
        op.run_folds(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no recorded run"):
        op.run_model(spark, f"{tmp_path}/none", "x")


def test_records_without_kept_results_are_listed(spark, tmp_path):
    src.write_run_metrics(spark, f"{tmp_path}/old.json", {"run_name": "old", "spatial_cv": {"r2_mean": 0.5}})
    assert op.run_artifacts(spark, str(tmp_path)) == {"old": None}
