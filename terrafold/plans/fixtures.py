"""Point, grid, response and prediction tables derived from the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.joins import union_all
from terrafold.operators.metrics import cv_summary, metrics_by_fold
from terrafold.sources.grids import GridMeta

GRID = GridMeta(x0=-180.0, y0=75.0, dx=2.0, dy=-2.0, nodata=300)
DEPTHS = ["0-5cm", "5-15cm", "15-30cm"]
PARAMS = ["T2M", "PRECTOTCORR"]
PERIODS = ["JAN", "OCT", "ANN"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """One point per order, with a target, two soil columns and a few failures.

    Amounts have two decimals, so they are summed exactly as whole cents.
    """

    def total(c: str) -> Column:
        return F.sum(F.rint(F.col(c) * 100).cast("long")) / F.lit(100.0)

    lines = (
        _read(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            total("l_quantity").alias("qty"),
            total("l_extendedprice").alias("ext"),
            F.max("l_discount").alias("dmax"),
            F.max("l_tax").alias("tmax"),
        )
    )
    key = F.col("o_orderkey")
    orders = _read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    crop = F.when(key % 2 == 0, F.lit("wheat")).otherwise(F.lit("maize"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        key.alias("row_id"),
        F.concat_ws("_", crop, key.cast("string")).alias("cell_id"),
        crop.alias("crop"),
        (F.lit(74.875) - ((F.col("o_custkey") * 7 + key * 13) % 540) * F.lit(0.25)).alias("lat"),
        (F.lit(-179.875) + ((key * 31) % 1440) * F.lit(0.25)).alias("lon"),
        F.least(F.lit(10000), F.floor(F.coalesce("ext", F.lit(0.0)) / 50)).cast("int").alias("suitability"),
        "n_lines",
        "qty",
        "ext",
        F.when(key % 17 != 0, F.col("dmax")).alias("sg_clay_0_30"),
        F.col("tmax").alias("sg_sand_0_30"),
        F.when(key % 101 == 0, F.lit("HTTP 503")).alias("power_error"),
    )


def climate_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One or two service attempts per point, some of them failed."""
    k, row = F.col("attempt"), F.col("row_id")
    always_fails = row % 101 == 0
    flaky = row % 7 == 0
    tries = points(spark, sf).select("cell_id", "row_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    tries = tries.where((k == 1) | flaky | always_fails)
    failed = always_fails | ((k == 1) & flaky)

    def num(c) -> Column:
        return c.cast("string")

    body = F.concat(
        F.lit('{"geometry":{"coordinates":['), num(row % 360 - 180), F.lit(","), num(row % 120 - 60),
        F.lit(']},"properties":{"elevation":'), num(row % 900),
        F.lit(',"parameter":{"T2M":{"JAN":'), num(row % 40 - 10), F.lit(',"OCT":'), num(row % 30),
        F.lit(',"ANN":'), num(row % 25), F.lit('},"PRECTOTCORR":{"JAN":'), num(row % 9),
        F.lit(',"OCT":'), num(row % 8), F.lit(',"ANN":'), num(row % 7), F.lit("}}}}"),
    )
    return tries.select(
        "cell_id",
        "attempt",
        F.when(failed, F.lit(503)).otherwise(F.lit(200)).alias("status"),
        F.when(~failed, body).alias("body"),
    )


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Three gridded layers in long form."""
    n = F.col("l_linenumber")
    return (
        _read(spark, sf, "lineitem")
        .groupBy(
            F.when(n % 3 == 0, F.lit(DEPTHS[0])).when(n % 3 == 1, F.lit(DEPTHS[1])).otherwise(F.lit(DEPTHS[2])).alias("grid_id"),
            ((F.col("l_partkey") * 7 + n) % 68).cast("int").alias("r"),
            ((F.col("l_suppkey") * 11 + F.col("l_orderkey")) % 180).cast("int").alias("c"),
        )
        .agg(
            F.floor(F.sum(F.col("l_quantity").cast("int")).cast("double") * 10 / F.count(F.lit(1)))
            .cast("int")
            .alias("value")
        )
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """One point per supplier, all within four degrees; some without a latitude."""
    key = F.col("s_suppkey")
    return _read(spark, sf, "supplier").select(
        key.alias("station"),
        F.when(key % 13 != 0, F.lit(12.25) + (key * 7 % 16) * F.lit(0.25)).alias("lat"),
        (F.lit(20.125) + (key * 11 % 16) * F.lit(0.25)).alias("lon"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two deterministic models, both rows from one pass over the points."""
    a = F.lit(1000.0) + F.coalesce("qty", F.lit(0.0)) * 30
    b = F.lit(500.0) + F.floor(F.coalesce("ext", F.lit(0.0)) / 60)
    each = F.array(
        F.struct(F.lit("A").alias("model"), a.alias("predicted")),
        F.struct(F.lit("B").alias("model"), b.cast("double").alias("predicted")),
    )
    rows = points(spark, sf).select(
        "row_id", "crop", "lat", "lon", F.col("suitability").cast("double").alias("observed"),
        F.explode(each).alias("m"),
    )
    error = F.col("observed") - F.col("m.predicted")
    return rows.select(
        "m.model",
        (F.col("row_id") % 5 + 1).cast("int").alias("fold"),
        F.col("row_id").alias("row_index"),
        "crop", "lat", "lon", "observed", "m.predicted",
        error.alias("residual"),
        F.abs(error).alias("abs_error"),
        (error * error).alias("squared_error"),
    )


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Long feature contributions: five features for every point."""
    row = F.col("row_id")
    wheat = (F.col("crop") == "wheat").cast("double")
    clay = F.coalesce("sg_clay_0_30", F.lit(0.0))

    def entry(name: str, value, contribution) -> Column:
        return F.struct(
            F.lit(name).alias("feature"),
            value.cast("double").alias("value"),
            contribution.cast("double").alias("contribution"),
        )

    each = F.array(
        entry("is_wheat", wheat, wheat * 100 - 40 + row % 7),
        entry("T2M_OCT", row % 30, (row % 30) * 3 - 40),
        entry("WS2M_ANN", row % 11, (row % 11) * 2 - 9),
        entry("sg_clay_0_30", clay, clay * 1000 - 50),
        entry("power_elevation_m", row % 900, (row % 900) / 10.0 - 45),
    )
    return points(spark, sf).select("row_id", "crop", F.explode(each).alias("e")).select("row_id", "crop", "e.*")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Fold summaries of both models under two block sizes, as a table of runs."""
    base = predictions(spark, sf)

    def folded(deg: float) -> DataFrame:
        bins = F.floor((F.col("lat") + 90.0) / deg) + F.floor((F.col("lon") + 180.0) / deg)
        return base.withColumn("fold", (bins % 5 + 1).cast("int"))

    def summary(deg: float) -> DataFrame:
        out = cv_summary(metrics_by_fold(folded(deg)))
        spatial = {c: f"spatial_{c}" for c in out.columns if c != "model"}
        return out.withColumnsRenamed(spatial).select(
            F.concat(F.col("model"), F.lit(f"_block{str(deg).replace('.', 'p')}")).alias("run_name"),
            F.col("model").alias("model_name"),
            F.lit(deg).alias("spatial_block_deg"),
            *spatial.values(),
        )

    return reduce(union_all, [summary(5.0), summary(10.0)])
