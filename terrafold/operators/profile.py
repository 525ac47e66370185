"""Describing a target and its features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.scalars import count_label
from terrafold.operators.quantiles import exact_quantiles
from terrafold.session import materialize


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows per value; NULL is a value. Most frequent first."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(c))


def describe_target(
    df: DataFrame, c: str, probs: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()
) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, exact percentiles, maximum."""
    by = list(by)
    rows = df.dropna(subset=by) if by else df
    basics = rows.groupBy(*by).agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    quantiles = materialize(exact_quantiles(rows, c, probs, by), "quantiles")
    names = [f"p{100 * p:g}".replace(".", "_") for p in probs]
    if by:
        both = basics.join(quantiles.drop("n"), by, "left")
    else:
        both = basics.withColumn("quantiles", quantiles.select("quantiles").scalar())
    return both.select(
        *by,
        "count",
        "mean",
        "std",
        "min",
        *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)],
        "max",
    )


def zero_rate(df: DataFrame, c: str, by: Sequence[str] = (), expected: float | None = None) -> DataFrame:
    """Share of rows equal to 0, next to the expected share if one is given."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col(c) == 0, F.lit(False)).cast("double")).alias("zero_rate"),
    )
    return out if expected is None else out.withColumn("expected_rate", F.lit(float(expected)))


def corr_with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pairwise-complete Pearson correlation with the target, strongest positive first.

    The target is in the list with 1; a column without spread has none. All
    correlations come from one aggregation with a fixed-size state per column.
    """
    columns = [*[c for c in columns if c != target], target]

    def pearson(c: str) -> Column:
        # Built from parts, because corr() fails on a constant column in ANSI mode.
        x, y = F.col(f"`{c}`").cast("double"), F.col(target).cast("double")
        spread_x = F.stddev_pop(F.when(y.isNotNull(), x))
        spread_y = F.stddev_pop(F.when(x.isNotNull(), y))
        both = (spread_x > 0) & (spread_y > 0)
        return F.when(both, F.covar_pop(x, y) / spread_x / spread_y)

    wide = df.agg(*[pearson(c).alias(c) for c in columns])
    return wide.unpivot(
        [], [F.col(f"`{c}`") for c in columns], "feature", "corr_with_target"
    ).orderBy(F.desc_nulls_last("corr_with_target"), "feature")


def boxplot_stats(df: DataFrame, c: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends, row count and axis label per category.

    Whiskers end at the outermost values within ``whisker`` times the
    inter-quartile range; values beyond are left out.
    """
    v = F.col(c).cast("double")
    rows = df.select(by, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v) & F.col(by).isNotNull())
    # One pass over the data; quartiles and whiskers come from the value counts.
    values = materialize(rows.groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_n")), "box-values")
    quartiles = exact_quantiles(values, "_v", [0.25, 0.5, 0.75], [by], "_n")
    box = materialize(
        quartiles.select(
            by,
            "n",
            F.get("quantiles", F.lit(0)).alias("q1"),
            F.get("quantiles", F.lit(1)).alias("median"),
            F.get("quantiles", F.lit(2)).alias("q3"),
        ),
        "quartiles",
    )
    reach = (F.col("q3") - F.col("q1")) * F.lit(whisker)
    above = F.col("_v") >= F.col("q1") - reach
    below = F.col("_v") <= F.col("q3") + reach
    ends = values.join(box, by).groupBy(by, "n", "q1", "median", "q3").agg(
        F.min(F.when(above, F.col("_v"))).alias("_low"), F.max(F.when(below, F.col("_v"))).alias("_high")
    )
    return ends.select(
        by,
        "n",
        F.least("_low", "q1").alias("whisker_low"),
        "q1",
        "median",
        "q3",
        F.greatest("_high", "q3").alias("whisker_high"),
        count_label(by, F.col("n")).alias("label"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], at_least: int = 0) -> DataFrame:
    """Distinct non-NULL values per column; with ``at_least``, raise if any has fewer."""
    out = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(
        [], [F.col(f"`{c}`") for c in columns], "column", "n_distinct"
    )
    if at_least:
        short = out.where(F.col("n_distinct") < at_least).collect()
        if short:
            raise ValueError(f"fewer than {at_least} distinct values: {[tuple(r) for r in short]}")
    return out
