import itertools
import math
from fractions import Fraction

import numpy as np

import pytest
from pyspark.sql import functions as F

from terrafold import operators as op
from terrafold.operators.compare import normal_upper_tail, signed_rank_null, signed_rank_tail, student_t_beyond


def score(spark, pairs):
    return op.regression_metrics(spark.createDataFrame(pairs, "observed double, predicted double")).first()


def test_r2_edge_cases(spark):
    assert score(spark, [(5.0, 4.0), (5.0, 6.0)])["r2"] == 0.0
    assert score(spark, [(5.0, 5.0), (5.0, 5.0)])["r2"] == 1.0
    assert score(spark, [(5.0, 4.0)])["r2"] is None
    s = score(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)])
    assert s["r2"] == pytest.approx(0.5) and s["rmse"] == pytest.approx(math.sqrt(1 / 3)) and s["mae"] == pytest.approx(1 / 3)


def run(spark, diffs):
    df = spark.createDataFrame([("m", float(d)) for d in diffs], "metric string, difference double")
    return op.paired_tests(df).first()


def test_known_values_for_one_to_five(spark):
    r = run(spark, [1, 2, 3, 4, 5])
    assert r["n_folds"] == 5 and r["mean_difference"] == 3 and r["sd_difference"] == pytest.approx(math.sqrt(2.5))
    assert r["t_stat"] == pytest.approx(4.242641, abs=1e-6)
    assert r["t_p_two_sided"] == pytest.approx(0.013236, abs=1e-6)
    assert r["t_p_one_sided"] == pytest.approx(0.006618, abs=1e-6)
    assert (r["wilcoxon_stat_two_sided"], r["wilcoxon_p_two_sided"]) == (0.0, 0.0625)
    assert (r["wilcoxon_stat_one_sided"], r["wilcoxon_p_one_sided"]) == (15.0, 0.03125)
    assert r["all_differences_positive"] is True


def test_a_zero_switches_to_the_normal_approximation(spark):
    r = run(spark, [0, 1, 2, 3, 4])
    assert r["wilcoxon_stat_two_sided"] == 0.0 and r["wilcoxon_stat_one_sided"] == 10.0
    assert r["wilcoxon_p_two_sided"] == pytest.approx(0.0678892, abs=1e-6)
    assert r["wilcoxon_p_one_sided"] == pytest.approx(0.0339446, abs=1e-6)
    assert r["all_differences_positive"] is False


def test_all_zero_and_single(spark):
    z = run(spark, [0, 0, 0])
    assert z["wilcoxon_p_two_sided"] is None and z["t_stat"] is None and z["cohen_dz"] is None
    one = run(spark, [2])
    assert one["sd_difference"] is None and one["t_p_two_sided"] is None and one["wilcoxon_p_one_sided"] == 0.5
    same = run(spark, [2, 2, 2])
    assert same["t_stat"] == math.inf and same["t_p_two_sided"] == 0.0 and same["cohen_dz"] is None


@pytest.mark.parametrize("diffs", [
    [0.3, -1.2, 2.2, 0.9, -0.4, 3.1], [-1, -2, -3.5, 4.25], [5, -4, 3, -2, 1, 0.5, -0.25, 8],
])
def test_exact_null_equals_enumeration(spark, diffs):
    r = run(spark, diffs)
    ranks = {d: i + 1 for i, d in enumerate(sorted(diffs, key=abs))}
    plus = sum(ranks[d] for d in diffs if d > 0)
    sums = [sum(c) for c in itertools.product(*[(0, ranks[d]) for d in diffs])]
    hi, lo = sum(s >= plus for s in sums) / len(sums), sum(s <= plus for s in sums) / len(sums)
    centre = plus == len(diffs) * (len(diffs) + 1) // 4
    assert r["wilcoxon_p_one_sided"] == pytest.approx(hi)
    assert r["wilcoxon_p_two_sided"] == pytest.approx(1.0 if centre else min(1, 2 * min(hi, lo)))


def test_tied_magnitudes_share_their_rank(spark):
    r = run(spark, [1, -1, 2, 2, 3])
    assert r["wilcoxon_stat_one_sided"] == 1.5 + 3.5 + 3.5 + 5 and r["wilcoxon_stat_two_sided"] == 1.5


def test_many_differences_use_the_approximation(spark):
    diffs = [(-1) ** (i % 3 == 0) * (i + 1) for i in range(60)]
    r = run(spark, diffs)
    plus = sum(abs(d) for d in diffs if d > 0)
    z = (plus - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert r["wilcoxon_p_one_sided"] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-12)


def test_ranks_of_large_and_tied_groups(spark):
    rows = [("a", float((i * 7919) % 83 - 40)) for i in range(400)] + [("b", 0.5), ("b", -1.5), ("b", 1e30)]
    rows += [("z", 0.0), ("z", 0.0), ("c", 2.0), ("c", 2.0), ("c", -2.0)]
    got = {r["metric"]: r for r in op.paired_tests(spark.createDataFrame(rows, "metric string, difference double")).collect()}
    for g in got:
        d = [x for k, x in rows if k == g and x]
        size = sorted(map(abs, d))
        rank = {x: sum(i + 1 for i, y in enumerate(size) if y == x) / size.count(x) for x in set(size)}
        want = sum(rank[abs(x)] for x in d if x > 0) if d else None
        assert got[g]["wilcoxon_stat_one_sided"] == want


def test_wilcoxon_methods(spark):
    rows = [("a", float(i + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "metric string, difference double")
    exact = op.paired_tests(df, method="exact").first()
    assert exact["wilcoxon_p_one_sided"] == pytest.approx(2.0**-60, rel=1e-12)
    assert op.paired_tests(df).first()["wilcoxon_p_one_sided"] == pytest.approx(op.paired_tests(df, method="approx").first()["wilcoxon_p_one_sided"])
    small = op.paired_tests(df.where("difference <= 5")).first()
    assert small["wilcoxon_p_one_sided"] == 1 / 32
    with pytest.raises(ValueError, match="unknown method"):
        op.paired_tests(df, method="other")


def test_null_distribution_sums_to_one(spark):
    for r in signed_rank_null(spark.createDataFrame([(1,), (5,), (50,)], "n_used long")).collect():
        n = r["n_used"]
        assert len(r["chances"]) == n * (n + 1) // 2 + 1 and sum(r["chances"]) == pytest.approx(1.0)


def test_student_tail_against_integration(spark):
    rows = [(t, df) for t in (0.0, 0.3, 1.0, 1.7, 1.8, 2.5, 7.0, 40.0, 200.0) for df in (1, 2, 3, 4, 9, 31, 59, 399)]
    table = spark.createDataFrame(rows, "t double, df long")
    points, weights = np.polynomial.legendre.leggauss(2000)
    for r in table.select("t", "df", student_t_beyond(F.col("t"), F.col("df")).alias("p")).collect():
        nu, t = r["df"], r["t"]
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
        # With s = t + (exp(u) - 1) the tail decays evenly in u.
        u = (points + 1) / 2 * min(800 / nu + 3, 300)
        s = t + np.expm1(u)
        log_f = c - (nu + 1) / 2 * np.log1p(s * s / nu) + u
        want = 2 * float((weights * np.exp(log_f)).sum()) * min(800 / nu + 3, 300) / 2
        assert 0 <= r["p"] <= 1 and r["p"] == pytest.approx(want, rel=1e-6, abs=1e-300)


def test_student_tail_in_closed_form(spark):
    table = spark.createDataFrame([(t,) for t in (0.1, 1.0, 1.74, 5.0, 1e3, 1e9)], "t double")
    one, two = student_t_beyond(F.col("t"), F.lit(1)), student_t_beyond(F.col("t"), F.lit(2))
    for r in table.select("t", one.alias("one"), two.alias("two")).collect():
        t = r["t"]
        assert r["one"] == pytest.approx(2 * math.atan2(1, t) / math.pi, rel=1e-12)
        root = math.sqrt(2 + t * t)
        assert r["two"] == pytest.approx(2 / (root * (root + t)), rel=1e-12)


def test_normal_tail_keeps_relative_accuracy(spark):
    table = spark.createDataFrame([(z / 4,) for z in range(-36, 140)], "z double")
    for r in table.select("z", normal_upper_tail(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)) / 2, rel=1e-11)


def test_pairing_needs_common_folds(spark):
    a = spark.createDataFrame([(1, 1.0)], "fold int, r2 double")
    b = spark.createDataFrame([(2, 1.0)], "fold int, r2 double")
    with pytest.raises(ValueError, match="no matching"):
        op.pair_models(a, b)


def test_deltas_are_positive_when_b_is_better(spark):
    a = spark.createDataFrame([(1, 0.5, 10.0, 8.0)], "fold int, r2 double, rmse double, mae double")
    b = spark.createDataFrame([(1, 0.6, 9.0, 7.5)], "fold int, r2 double, rmse double, mae double")
    got = {r["metric"]: r["difference"] for r in op.paired_deltas(op.pair_models(a, b)).collect()}
    assert got["RMSE_A_minus_B"] == 1.0 and got["MAE_A_minus_B"] == 0.5 and got["R2_B_minus_A"] == pytest.approx(0.1)


def test_best_run_breaks_ties_by_name(spark):
    runs = spark.createDataFrame(
        [("b", 2.0, 0.5), ("a", 2.0, 0.5), ("c", 0.5, 0.1), ("d", 0.5, None)],
        "run_name string, spatial_block_deg double, spatial_r2_mean double",
    )
    got = {r["spatial_block_deg"]: r["run_name"] for r in op.best_run_per_block(runs).collect()}
    assert got == {2.0: "a", 0.5: "c"}
    assert op.best_run(runs, 2.0)["run_name"] == "a"
    with pytest.raises(ValueError):
        op.best_run(runs, 9.0)


@pytest.mark.parametrize("n", [1, 2, 7, 60, 400, 2000])
def test_exact_tail_against_whole_numbers(n):
    """Counts of rank sums in Python's whole numbers, up to the tail that is asked for."""
    k = n * (n + 1) // 4 if n <= 60 else 3 * n
    ways = [1] + [0] * k
    for rank in range(1, min(n, k) + 1):
        for total in range(k, rank - 1, -1):
            ways[total] += ways[total - rank]
    at_most, just = signed_rank_tail(n, k)
    scale = 2**n
    if n < 1000:
        assert at_most == pytest.approx(sum(ways) / scale, rel=1e-12)
        assert just == pytest.approx(ways[k] / scale, rel=1e-12)
    else:  # below the smallest number
        assert at_most == pytest.approx(float(Fraction(sum(ways), scale)), abs=1e-300)


def test_exact_test_of_many_differences(spark):
    """The exact test of 2,000 differences is near its approximation, and far tails do not vanish."""
    rows = [("mixed", (-1) ** (i % 5 == 0) * (i + 1.0)) for i in range(700)] + [("even", (-1) ** i * (i + 1.0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "metric string, difference double")
    exact = {r["metric"]: r for r in op.paired_tests(df, method="exact").collect()}
    near = {r["metric"]: r for r in op.paired_tests(df, method="approx").collect()}
    assert exact["even"]["wilcoxon_p_two_sided"] == pytest.approx(near["even"]["wilcoxon_p_two_sided"], rel=1e-2)
    assert 0 < exact["mixed"]["wilcoxon_p_one_sided"] < 1e-40
    assert exact["mixed"]["wilcoxon_stat_one_sided"] == near["mixed"]["wilcoxon_stat_one_sided"]
