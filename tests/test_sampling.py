import hashlib

import pytest
from pyspark.sql import functions as F

from terrafold import operators as op


def order(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_sample_is_the_n_smallest_hashes_on_any_partitioning(spark, n):
    df = spark.range(500).withColumnRenamed("id", "k")
    want = sorted(sorted(range(500), key=order)[:n])
    for parts in (1, 7):
        got = op.sample_exact_n(df.repartition(parts), "k", n).collect()
        assert sorted(r["k"] for r in got) == want


def test_per_group_sizes_and_whole_small_groups(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 990, "big").otherwise("small").alias("g"))
    counts = {r["g"]: r["count"] for r in op.sample_per_group(df, "g", "k", 25).groupBy("g").count().collect()}
    assert counts == {"big": 25, "small": 10}


@pytest.mark.parametrize("n,want", [(10, 2), (11, 3), (1, 1), (1000, 200)])
def test_split_marks_exactly_the_rounded_up_share(spark, n, want):
    df = op.random_split(spark.range(n).withColumnRenamed("id", "k"), "k")
    assert df.count() == n and df.where("is_test").count() == want


def test_copies_of_a_key_are_refused(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"))
    with pytest.raises(ValueError, match="does not identify rows"):
        op.sample_exact_n(df, "k", 10)


def cells(spark, zeros=50, nonzeros=400, crop="wheat"):
    z = spark.range(zeros).select(F.concat(F.lit(crop + "_z"), F.col("id")).alias("cell_id"), F.lit(0).alias("s"))
    p = spark.range(nonzeros).select(
        F.concat(F.lit(crop + "_p"), F.col("id")).alias("cell_id"), (F.col("id") % 97 + 1).cast("int").alias("s")
    )
    return z.unionByName(p).withColumn("crop", F.lit(crop))


def test_strata_are_filled_evenly_and_remainder_goes_first(spark):
    df = cells(spark).unionByName(cells(spark, 60, 500, "maize"))
    out = op.stratified_sample(df, "crop", "s", "cell_id", 20, 43, q=4)
    assert out.columns == df.columns
    got = {(r["crop"], r["z"]): r["count"] for r in
           out.groupBy("crop", (F.col("s") == 0).alias("z")).count().collect()}
    assert got == {("wheat", True): 20, ("wheat", False): 43, ("maize", True): 20, ("maize", False): 43}
    binned = op.quantile_bins(df.where("s > 0"), "s", 4, ["crop"])
    sizes = (out.where("s > 0").join(binned.select("cell_id", "bin"), "cell_id")
             .groupBy("crop", "bin").count().orderBy("crop", "bin").collect())
    assert [r["count"] for r in sizes] == [11, 11, 11, 10] * 2


@pytest.mark.parametrize("zeros,nonzeros,q", [(5, 400, 4), (50, 30, 4)])
def test_shortage_raises(spark, zeros, nonzeros, q):
    with pytest.raises(ValueError, match="cannot draw"):
        op.stratified_sample(cells(spark, zeros, nonzeros), "crop", "s", "cell_id", 20, 43, q=q)


def test_too_few_bins_raises(spark):
    flat = cells(spark).withColumn("s", F.when(F.col("s") > 0, 7).otherwise(0))
    with pytest.raises(ValueError, match="cannot draw"):
        op.stratified_sample(flat, "crop", "s", "cell_id", 5, 10, q=4)


def test_param_sampler_draws_distinct_numbered_configs(spark):
    grid = {"depth": [None, 20, 30], "leaf": [1, 2, 3, 5], "features": ["sqrt", "log2"]}
    a = [r.asDict() for r in op.param_sampler(spark, grid, 6).orderBy("config_id").collect()]
    assert a == [r.asDict() for r in op.param_sampler(spark, grid, 6).orderBy("config_id").collect()]
    assert [r["config_id"] for r in a] == ["rs01", "rs02", "rs03", "rs04", "rs05", "rs06"]
    assert len({(r["depth"], r["leaf"], r["features"]) for r in a}) == 6
    assert op.param_sampler(spark, grid, 24).count() == 24
    with pytest.raises(ValueError):
        op.param_sampler(spark, grid, 25)
