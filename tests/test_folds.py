import hashlib
import random

import pytest
from pyspark.sql import functions as F

from terrafold import operators as op
from terrafold.functions import spatial_block


def greedy(sizes, k):
    """One block at a time: largest first, to the lightest fold."""
    loads, fold = [0] * k, {}
    for block in sorted(sizes, key=lambda b: (-sizes[b], hashlib.md5(b.encode()).hexdigest(), b)):
        f = loads.index(min(loads))
        fold[block] = f + 1
        loads[f] += sizes[block]
    return fold


def rows_of(spark, sizes):
    table = spark.createDataFrame([(b, n) for b, n in sizes.items()], "block string, n int")
    return table.select("block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


CASES = [
    ({f"b{i}": 1 for i in range(23)}, 5),
    ({"giant": 4000} | {f"b{i}": 1 for i in range(300)} | {f"c{i}": 3 for i in range(40)}, 5),
    ({f"b{i}": random.Random(i).choice([1, 1, 1, 2, 2, 5, 9, 40]) for i in range(200)}, 5),
    ({f"b{i}": random.Random(i + 7).randint(1, 60) for i in range(150)}, 3),
    ({"a": 10, "b": 9, "c": 7, "d": 7, "e": 7, "f": 1}, 2),
    ({f"b{i}": 2 for i in range(9)} | {"x": 11, "y": 4, "z": 4}, 4),
]


@pytest.mark.parametrize("sizes,k", CASES)
def test_fold_map_equals_plain_greedy(spark, sizes, k):
    got = {r["block"]: (r["fold"], r["n_rows"]) for r in op.fold_map(rows_of(spark, sizes), "block", k).collect()}
    want = greedy(sizes, k)
    assert got == {b: (want[b], sizes[b]) for b in sizes}


def test_too_few_blocks_raise(spark):
    with pytest.raises(ValueError, match="not enough"):
        op.fold_map(rows_of(spark, {"a": 3, "b": 2}), "block", 5)


def test_folds_partition_rows_and_hold_whole_blocks(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"),
        (F.lit(-60.0) + (F.col("id") * 37 % 1300) * 0.1).alias("lat"),
        (F.lit(-180.0) + (F.col("id") * 91 % 3599) * 0.1).alias("lon"),
        F.when(F.col("id") % 2 == 0, "wheat").otherwise("maize").alias("crop"),
        ((F.col("id") * 7919) % 10007).cast("double").alias("y"),
    )
    out = op.spatial_folds(df, 20.0, 5)
    assert out.count() == 3000 and out.select("row_id").distinct().count() == 3000
    assert out.groupBy("block_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    biggest = out.groupBy("block_id").count().agg(F.max("count")).first()[0]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= biggest

    oof = op.mean_baseline_cv(out, "y")
    scores = op.metrics_by_fold(oof).collect()
    assert len(scores) == 5 and all(r["r2"] <= 1e-12 for r in scores)
    means = {r["fold"]: r for r in op.fold_means(out, "y").collect()}
    for k in range(1, 6):
        want = out.where(F.col("fold") != k).agg(F.avg("y")).first()[0]
        assert means[k]["train_mean_prediction"] == pytest.approx(want)
        assert means[k]["n_train"] + means[k]["n_test"] == 3000


def test_block_ids_count_from_the_south_west_corner(spark):
    df = spark.createDataFrame([(-90.0, -180.0), (89.9, 179.9), (0.0, 0.0)], "lat double, lon double")
    got = [r[0] for r in df.select(spatial_block(0.5)).collect()]
    assert got == ["0_0", "359_719", "180_360"]


def test_rows_without_a_block_raise_or_keep_no_fold(spark):
    rows = [(i, float(i * 7 % 80), float(i * 11 % 160)) for i in range(60)] + [(100, None, 1.0), (101, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "row_id long, lat double, lon double")
    with pytest.raises(ValueError, match="2 rows have no block_id"):
        op.spatial_folds(df, 10.0, 3)
    out = op.spatial_folds(df, 10.0, 3, null_blocks="keep").collect()
    assert len(out) == 62 and {r["row_id"] for r in out if r["fold"] is None} == {100, 101}
