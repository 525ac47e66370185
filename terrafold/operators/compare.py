"""Paired comparison of two models over folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.quantiles import counts_below
from terrafold.session import materialize

AUTO_EXACT = 50  # most differences for which the "auto" Wilcoxon test is exact
_FRACTION_STEPS = 400


def paired_deltas(paired: DataFrame, keys: Sequence[str] = ("fold",), suffixes=("_a", "_b")) -> DataFrame:
    """Long table ``keys..., metric, difference``; positive means model b is better."""
    a, b = suffixes
    return paired.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.lit("RMSE_A_minus_B").alias("metric"),
                    (F.col(f"rmse{a}") - F.col(f"rmse{b}")).alias("difference"),
                ),
                F.struct(
                    F.lit("MAE_A_minus_B").alias("metric"),
                    (F.col(f"mae{a}") - F.col(f"mae{b}")).alias("difference"),
                ),
                F.struct(
                    F.lit("R2_B_minus_A").alias("metric"),
                    (F.col(f"r2{b}") - F.col(f"r2{a}")).alias("difference"),
                ),
            )
        ).alias("_d"),
    ).select(*keys, "_d.metric", "_d.difference")


def _fraction(steps: int, first: Column, step) -> Column:
    """A continued fraction from its innermost term outwards."""
    return F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), first, step)


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: recurrence up to a + 30, then the asymptotic series."""
    shift, ratio = 30, F.lit(1.0)
    for k in range(shift):
        ratio = ratio * (a + k) / (a + k + 0.5)
    x = F.lit(1.0) / (a + shift)
    series = 1 - x / 8 + x**2 / 128 + 5 * x**3 / 1024 - 21 * x**4 / 32768 - 399 * x**5 / 262144 + 869 * x**6 / 4194304
    return ratio * F.sqrt(a + shift) * series


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function."""

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + F.when(k % 2 == 1, odd).otherwise(even) / acc

    return 1 / _fraction(_FRACTION_STEPS, F.lit(1.0), step)


def student_t_beyond(t: Column, df: Column) -> Column:
    """P(|T| >= t) for t >= 0 and any positive degrees of freedom.

    The tail itself is computed, by the continued fraction of the incomplete
    beta function, so small probabilities keep their relative accuracy.
    """
    nu, square = df.cast("double"), t * t
    a, x, y = nu / 2, nu / (nu + square), square / (nu + square)
    front = F.exp(-a * F.log1p(square / nu)) * F.sqrt(y) * _gamma_ratio(a) / math.sqrt(math.pi)
    far = front / a * _beta_fraction(a, F.lit(0.5), x)
    near = 1 - 2 * front * _beta_fraction(F.lit(0.5), a, y)
    return F.when(t == float("inf"), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(square > 3, far).otherwise(near)))
    )


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for the standard normal: a series near the centre, a continued fraction beyond."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * x * x / (2.0 * i + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda acc: acc["total"])
    far = density / _fraction(150, x, lambda acc, k: x + k / acc)
    upper = F.when(x < 2.5, 0.5 - series * density).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def signed_rank_null(sizes: DataFrame) -> DataFrame:
    """``n_used, chances``: how likely each rank sum of ranks 1..n is, for every size in ``n_used``.

    Built by adding one rank at a time: each new rank is either absent or
    shifts every sum by its value, with equal chances.
    """

    def add_rank(chances: Column, rank: Column) -> Column:
        pad = F.array_repeat(F.lit(0.0), rank.cast("int"))
        return F.zip_with(F.concat(chances, pad), F.concat(pad, chances), lambda a, b: (a + b) / 2)

    return sizes.where("n_used > 0").select(
        "n_used",
        F.aggregate(
            F.sequence(F.lit(1), F.col("n_used").cast("int")), F.array(F.lit(1.0)), add_rank
        ).alias("chances"),
    )


def signed_rank_tail(n: int, k: int) -> tuple[float, float]:
    """P(W <= k) and P(W = k) for the rank sum W of n ranks with random signs, by counting.

    Ways to reach each sum up to ``k`` are counted rank by rank; sums beyond are never
    built. Counts are scaled down by powers of two as they grow, so any
    ``n`` keeps its relative accuracy, down to the smallest number there is.
    """
    ways, scale = np.zeros(k + 1), 0
    ways[0] = 1.0
    for rank in range(1, min(n, k) + 1):
        top = min(k, rank * (rank + 1) // 2)
        ways[rank : top + 1] += ways[: top + 1 - rank]
        if rank % 512 == 0:  # each rank doubles the largest count at most
            power = int(np.frexp(ways.max())[1])
            ways, scale = np.ldexp(ways, -power), scale + power
    return math.ldexp(float(ways.sum()), scale - n), math.ldexp(float(ways[k]), scale - n)


def _tails(wanted: DataFrame) -> DataFrame:
    """:func:`signed_rank_tail` for every pair ``n_used``, ``_k``; one pair at a time in a task."""

    def run(batches):
        for batch in batches:
            found = [signed_rank_tail(n, k) for n, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            sides = [pa.array([f[x] for f in found], pa.float64()) for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], names=["n_used", "_k", "_at_most", "_just"])

    return wanted.mapInArrow(run, "n_used long, _k long, _at_most double, _just double")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Append ``_rank``, the mid-rank of |_d| among the nonzero differences of the group."""
    nonzero = F.col("_d") != 0
    sized = rows.withColumn("_size", F.abs("_d"))
    counted = sized.where(nonzero).groupBy(*by, "_size").agg(F.count(F.lit(1)).alias("_ties"))
    ranks = materialize(counts_below(counted, by, "_size", "_ties", "_below"), "ranks")
    mid = F.col("_below") + 1 + (F.col("_ties") - 1) / 2.0
    return sized.join(ranks, [*by, "_size"], "left").withColumn("_rank", F.when(nonzero, mid))


def paired_tests(
    deltas: DataFrame,
    by: Sequence[str] = ("metric",),
    value: str = "difference",
    method: str = "auto",
) -> DataFrame:
    """Effect size, t-test and Wilcoxon signed-rank test of the differences, per group.

    One-sided tests ask whether the differences lie above zero. The Wilcoxon
    ``method`` is ``"exact"`` (for groups without zeros), ``"approx"`` (the
    normal approximation with tie correction on the nonzero differences, which
    groups with zeros always take) or ``"auto"``: exact up to 50 differences.
    ``"exact"`` takes any number of differences, with work of the order of their cube.
    All-zero groups have no Wilcoxon result.
    """
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method {method!r}: use 'auto', 'exact' or 'approx'")
    by = list(by)
    d = F.col("_d")
    nonzero = d != 0
    rows = deltas.select(*by, F.col(value).cast("double").alias("_d")).dropna(subset=[*by, "_d"])
    ranked = _ranked(rows, by)
    stats = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(d).alias("mean_difference"),
        F.stddev_samp(d).alias("sd_difference"),
        F.count_if(nonzero).alias("n_used"),
        F.coalesce(F.sum(F.when(d > 0, F.col("_rank"))), F.lit(0.0)).alias("_plus"),
        F.coalesce(F.sum(F.when(d < 0, F.col("_rank"))), F.lit(0.0)).alias("_minus"),
        # Sum over tie groups of t^3 - t equals the sum over members of t^2 - 1.
        F.sum(F.when(nonzero, F.col("_ties") * F.col("_ties") - 1).otherwise(0)).alias("_tied"),
        F.bool_and(d > 0).alias("all_differences_positive"),
    )
    n, mean, sd = F.col("n_folds"), F.col("mean_difference"), F.col("sd_difference")
    t = F.when(sd > 0, mean / (sd / F.sqrt(n.cast("double")))).when(
        (sd == 0) & (mean != 0), F.signum(mean) * F.lit(float("inf"))
    )
    tested = stats.withColumn("_t", t)
    t_two = F.when(F.col("_t").isNotNull(), student_t_beyond(F.abs("_t"), n - 1))
    tested = tested.withColumn("_t_two", t_two)
    t_one = F.when(F.col("_t") >= 0, F.col("_t_two") / 2).when(F.col("_t") < 0, 1 - F.col("_t_two") / 2)

    m, plus = F.col("n_used"), F.col("_plus")
    most = {"auto": F.lit(AUTO_EXACT), "exact": n, "approx": F.lit(0)}[method]
    exact = (n == m) & (m > 0) & (n <= most)
    most_sum = (m * (m + 1) / 2).cast("long")
    place = F.floor(plus).cast("long")
    tested = materialize(tested.withColumn("_exact", exact).withColumn("_k", F.least(place, most_sum - place)), "tested")
    tails = materialize(_tails(tested.where("_exact").select("n_used", "_k").distinct()), "tails")
    tested = tested.join(tails, ["n_used", "_k"], "left")
    exact = F.col("_exact")
    # The smaller tail is counted; the other one and it share the sum itself.
    rest = 1 - F.col("_at_most") + F.col("_just")
    at_most = F.when(place == F.col("_k"), F.col("_at_most")).otherwise(rest)
    at_least = F.when(place == F.col("_k"), rest).otherwise(F.col("_at_most"))
    at_least = F.when(2 * place == most_sum, at_most).otherwise(at_least)
    centre = place == F.floor(most_sum / 2)
    exact_two = F.when(centre, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), 2 * F.least(at_least, at_most))
    )
    smaller = F.least("_plus", "_minus")
    middle = m * (m + 1) / 4.0
    deviation = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("_tied") / 2.0) / 24.0)
    some = m > 0
    approx_two = 2 * normal_upper_tail(F.abs((smaller - middle) / deviation))
    approx_one = normal_upper_tail((plus - middle) / deviation)
    return tested.select(
        *by,
        "n_folds",
        "mean_difference",
        "sd_difference",
        F.when(sd > 0, mean / sd).alias("cohen_dz"),
        F.col("_t").alias("t_stat"),
        F.col("_t_two").alias("t_p_two_sided"),
        t_one.alias("t_p_one_sided"),
        F.when(some, smaller).alias("wilcoxon_stat_two_sided"),
        F.when(exact, exact_two).when(some, approx_two).alias("wilcoxon_p_two_sided"),
        F.when(some, plus).alias("wilcoxon_stat_one_sided"),
        F.when(exact, F.least(F.lit(1.0), at_least)).when(some, approx_one).alias("wilcoxon_p_one_sided"),
        "all_differences_positive",
    )
