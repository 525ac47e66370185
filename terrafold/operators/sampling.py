"""Samples of exact size, reproducible on any partitioning.

Rows are ordered by ``md5(seed|key)``. ``key`` must identify a row. A sample
of n rows is then "every row whose hash is at most the n-th smallest hash", so
each operator stores the hashes once, finds that one hash per group by counting
hash prefixes, and finishes with a filter: the input is read twice, and no group
is sorted or gathered.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.columns import require_columns
from terrafold.operators.binning import bin_by_edges, quantile_edges
from terrafold.session import materialize

_ABOVE_ALL = "g"  # sorts after every hex digit


def row_hash(key: str | Column, seed: int) -> Column:
    """``md5(seed|key)`` in hex; the sampling order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_cutoffs(
    df: DataFrame, key: str, seed: int, quotas: DataFrame | Column | int, by: Sequence[str] = ()
) -> DataFrame:
    """Largest sampled hash per group: ``by..., _cut``.

    ``quotas`` is a row count, a Column over the group size ``_total``, or a
    table ``(by..., _quota)``. A quota of the whole group or more keeps all.
    Raises when copies of one key would make a sample larger than asked.
    """
    hashed = materialize(df.select(*by, row_hash(key, seed).alias("_h")), "hashes")
    return _cutoffs(hashed, key, quotas, by)


def _cutoffs(stored: DataFrame, key: str, quotas: DataFrame | Column | int, by: Sequence[str] = ()) -> DataFrame:
    """:func:`hash_cutoffs` of a stored table ``(by..., _h)``.

    The prefixes are so long that there are about as many as rows have one prefix:
    both windows hold in the order of the square root of the rows.
    """
    keys = [*by, "_all"]
    digits = max(1, math.ceil(math.log(max(stored.count(), 1), 16) / 2))
    hashed = stored.select(*by, F.lit(0).alias("_all"), "_h", F.substring("_h", 1, digits).alias("_p"))
    counts = hashed.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys)
    ordered = within.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(ordered), F.lit(0)),
            "_total": F.sum("_n").over(within),
        }
    )
    if isinstance(quotas, DataFrame):
        counts = counts.join(quotas, list(by))
    else:
        counts = counts.withColumn("_quota", F.lit(quotas) if isinstance(quotas, int) else quotas)
    last = F.col("_before") + F.col("_n") >= F.col("_total")
    edge = (F.col("_before") < F.col("_quota")) & (
        (F.col("_quota") <= F.col("_before") + F.col("_n")) | last
    )
    nothing = (F.col("_quota") <= 0) & (F.col("_before") == 0)
    edges = materialize(
        counts.where(edge | nothing).select(
            *keys,
            "_p",
            (F.col("_quota") - F.col("_before")).alias("_take"),
            (F.col("_quota") >= F.col("_total")).alias("_whole"),
        ),
        "edges",
    )
    whole = edges.where(F.col("_whole") | (F.col("_take") <= 0)).select(
        *by,
        F.when(F.col("_take") <= 0, F.lit("")).otherwise(F.lit(_ABOVE_ALL)).alias("_cut"),
        F.lit(False).alias("_tied"),
    )
    partial = edges.where(~F.col("_whole") & (F.col("_take") > 0)).drop("_whole")
    inside = Window.partitionBy(*keys, "_p").orderBy("_h")
    cut = (
        hashed.join(partial, [*keys, "_p"])
        .withColumns(
            {"_rank": F.row_number().over(inside), "_upto": F.count(F.lit(1)).over(inside)}
        )
        .where(F.col("_rank") == F.col("_take"))
        .select(*by, F.col("_h").alias("_cut"), (F.col("_upto") > F.col("_take")).alias("_tied"))
    )
    cutoffs = materialize(whole.unionByName(cut), "cutoffs")
    if not cutoffs.where("_tied").isEmpty():
        raise ValueError(f"{key!r} does not identify rows: copies straddle the end of a sample")
    return cutoffs.drop("_tied")


def _sampled(df: DataFrame, key: str, seed: int, cutoffs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with a boolean ``_in``; the cut-off table has one row per group."""
    if by:
        joined = df.join(cutoffs, list(by))
        return joined.select(*df.columns, (row_hash(key, seed) <= F.col("_cut")).alias("_in"))
    return df.withColumn("_in", row_hash(key, seed) <= cutoffs.select("_cut").scalar())


def sample_exact_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement; all rows if there are fewer."""
    cutoffs = hash_cutoffs(df, key, seed, n)
    return _sampled(df, key, seed, cutoffs, ()).where("_in").drop("_in")


def sample_per_group(
    df: DataFrame, by: str | Sequence[str], key: str, n: int, seed: int = 42
) -> DataFrame:
    """At most ``n`` rows of each group, without replacement."""
    by = [by] if isinstance(by, str) else list(by)
    cutoffs = hash_cutoffs(df, key, seed, n, by)
    return _sampled(df, key, seed, cutoffs, by).where("_in").drop("_in")


def random_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, out: str = "is_test"
) -> DataFrame:
    """Mark exactly ``ceil(test_size * n)`` rows as test rows."""
    quota = F.ceil(F.lit(float(test_size)) * F.col("_total"))
    cutoffs = hash_cutoffs(df, key, seed, quota)
    return _sampled(df, key, seed, cutoffs, ()).withColumnRenamed("_in", out)


def stratified_sample(
    df: DataFrame,
    category: str,
    target: str,
    key: str,
    n_zero: int,
    n_nonzero: int,
    q: int = 8,
    seed: int = 42,
    required: Sequence[str] = (),
) -> DataFrame:
    """Per category: ``n_zero`` rows with target 0 and ``n_nonzero`` above 0.

    The nonzero rows are spread evenly over quantile bins of the target; the
    first bins take the remainder, and a bin never gives more than it has.
    Raises when a category has too few rows of either kind, fewer than two
    bins, or cannot fill its total.
    """
    require_columns(df, [category, target, key, *required])
    rows = df.dropna(subset=[target, category, *required]).where(F.col(target) >= 0)
    narrow = materialize(rows.select(category, target, key, row_hash(key, seed).alias("_h")), "narrow")
    # One pass counts the target values; edges and stratum sizes come from the counts.
    counted = materialize(
        narrow.groupBy(category, target).agg(F.count(F.lit(1)).alias("_n")), "target-values"
    )
    edges = quantile_edges(counted.where(F.col(target) > 0), target, q, [category], "_n")

    def with_stratum(table: DataFrame) -> DataFrame:
        binned = bin_by_edges(table, target, edges, q + 1, [category], "_bin")
        stratum = F.when(F.col(target) == 0, F.lit(0)).otherwise(F.col("_bin") + 1)
        return binned.withColumn("_stratum", stratum).drop("_bin", "_bin_lo", "_bin_hi")

    sizes = materialize(
        with_stratum(counted).groupBy(category, "_stratum").agg(F.sum("_n").alias("_size")), "strata"
    )
    by_category = Window.partitionBy(category, F.col("_stratum") > 0)
    earlier = by_category.orderBy("_stratum")
    n_bins = F.count(F.lit(1)).over(by_category)
    share = F.floor(F.lit(n_nonzero) / n_bins)
    extra = (F.row_number().over(earlier) <= F.lit(n_nonzero) - share * n_bins).cast("long")
    quotas = sizes.withColumns(
        {
            "_n_bins": n_bins,
            "_quota": F.when(F.col("_stratum") == 0, F.lit(n_zero).cast("long")).otherwise(
                F.least(share + extra, F.col("_size"))
            ),
        }
    )
    problems = (
        quotas.groupBy(category)
        .agg(
            F.sum(F.when(F.col("_stratum") == 0, F.col("_size")).otherwise(0)).alias("zeros"),
            F.sum(F.when(F.col("_stratum") > 0, F.col("_size")).otherwise(0)).alias("nonzeros"),
            F.max(F.when(F.col("_stratum") > 0, F.col("_n_bins")).otherwise(0)).alias("bins"),
            F.sum("_quota").alias("total"),
        )
        .where(
            (F.col("zeros") < n_zero)
            | (F.col("nonzeros") < n_nonzero)
            | ((F.col("bins") < 2) & F.lit(n_nonzero > 0))
            | (F.col("total") != n_zero + n_nonzero)
        )
    )
    bad = problems.limit(5).collect()
    if bad:
        raise ValueError(
            f"cannot draw {n_zero} zero and {n_nonzero} nonzero rows: {[r.asDict() for r in bad]}"
        )
    strata_keys = [category, "_stratum"]
    strata = with_stratum(narrow).select(category, target, key, "_stratum", "_h")
    cutoffs = _cutoffs(strata, key, quotas.select(*strata_keys, "_quota"), strata_keys)
    drawn = strata.join(cutoffs, strata_keys).where(F.col("_h") <= F.col("_cut")).select(category, target, key)
    # Few rows next to the input; their stored size decides how they are joined back.
    return rows.join(materialize(drawn, "drawn"), [category, target, key], "left_semi").select(*df.columns)


def param_sampler(
    spark: SparkSession, grid: Mapping[str, Sequence], n: int, seed: int = 42
) -> DataFrame:
    """``n`` distinct configurations of a finite grid, with ids ``rs01``, ``rs02``, ...

    The grid is the product of a few short value lists (tens to hundreds of
    rows); it never depends on data. None values are kept as NULL.
    """
    size = math.prod(len(v) for v in grid.values())
    if n > size:
        raise ValueError(f"grid has {size} configurations, {n} were asked for")
    table = spark.range(1).select(F.lit(0).alias("_one"))
    for name, values in grid.items():
        table = table.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    names = list(grid)
    text = F.concat_ws(
        "|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names]
    )
    ordered = Window.partitionBy("_one").orderBy(row_hash(text, seed))
    return (
        table.withColumn("_rank", F.row_number().over(ordered))
        .where(F.col("_rank") <= n)
        .select(F.format_string("rs%02d", F.col("_rank").cast(T.IntegerType())).alias("config_id"), *names)
    )
