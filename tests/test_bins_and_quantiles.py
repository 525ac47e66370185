import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrafold import operators as op
from terrafold.functions.scalars import with_residuals as op_with_residuals


def column(spark, values, name="v"):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, f"{name} double")


def bins_of(df):
    return {r["v"]: (r["bin"], r["bin_lo"], r["bin_hi"]) for r in df.collect()}


def test_ties_drop_edges_and_bins_are_right_closed(spark):
    # Two of the quintile edges are 1, so one bin is lost.
    values = [1.0, 1, 1, 1, 2, 3, 4, 5]
    edges = np.unique(np.quantile(values, [0, 0.2, 0.4, 0.6, 0.8, 1]))
    out = bins_of(op.quantile_bins(column(spark, values), "v", 5))
    for v, (b, lo, hi) in out.items():
        want = max(np.searchsorted(edges, v, side="left") - 1, 0)
        assert b == want and lo == pytest.approx(edges[want]) and hi == pytest.approx(edges[want + 1])


def test_value_on_inner_edge_belongs_to_the_lower_bin(spark):
    out = bins_of(op.quantile_bins(column(spark, [0.0, 1, 2, 3, 4]), "v", 2))
    assert out[2.0][0] == 0 and out[3.0][0] == 1 and out[0.0][0] == 0


def test_null_has_no_bin(spark):
    out = op.quantile_bins(column(spark, [0.0, 1, 2, None]), "v", 2).where("v is null").first()
    assert out["bin"] is None


def test_cut_outside_is_null_and_labels_must_fit(spark):
    df = column(spark, [-0.1, 0.0, 5, 5.1, 10, 10.5, None])
    got = {r["v"]: r["bin"] for r in op.cut_by_edges(df, "v", [0, 5, 10], ["low", "high"]).collect()}
    assert got == {-0.1: None, 0.0: "low", 5.0: "low", 5.1: "high", 10.0: "high", 10.5: None, None: None}
    with pytest.raises(ValueError):
        op.cut_by_edges(df, "v", [0, 5, 10], ["one"])
    with pytest.raises(ValueError):
        op.cut_by_edges(df, "v", [0, 0, 10])


@pytest.mark.parametrize("values", [
    list(range(1000)),
    [0.0] * 500 + [1.0] * 3 + [7.5],
    [1e30] + [i / 7 for i in range(300)],
    [s * 10.0 ** e for e in range(-300, 300, 7) for s in (-1, 1, 1.5)],
    [-0.0, 0.0, 0.0, 5e-324, 1.0 + 2e-16, 1.0],
    [-5.0, -5.0, 2.0],
    [3.0],
])
def test_quantiles_agree_with_numpy_at_any_cell_size(spark, values):
    df = column(spark, [float(v) for v in values] + [None, float("nan")])
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.quantile(np.array(values, dtype=float), probs)
    for limit in (0, 10**6):
        row = op.exact_quantiles(df, "v", probs, rows_per_task=limit).first()
        assert row["n"] == len(values)
        assert np.allclose(row["quantiles"], want, rtol=1e-12, atol=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_grouped_counting_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["quantiles"] for r in
           op.exact_quantiles(df, "v", [0.3, 0.5], ["g"], rows_per_task=0).collect()}
    for g in {r[0] for r in rows}:
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.3, 0.5]), rtol=1e-9, atol=1e-6)


def test_weighted_quantiles_count_copies(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1)], "v double, n long")
    assert op.exact_quantiles(df, "v", [0.5], weight="n").first()["quantiles"] == [1.0]


def test_fixed_histogram_keeps_both_ends(spark):
    df = column(spark, [-6000.0, 0, 6000, 6000.1, -6000.1, None])
    out = {r["bin"]: r["n"] for r in op.histogram(df, "v", 40, -6000, 6000).collect()}
    assert len(out) == 40
    assert out[0] == 1 and out[20] == 1 and out[39] == 1 and sum(out.values()) == 3


def test_minmax_histogram_counts_every_value(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=500)
    want, edges = np.histogram(values, bins=60)
    out = op.histogram_minmax(column(spark, values.tolist()), "v", 60).orderBy("bin").collect()
    assert [r["n"] for r in out] == want.tolist()
    assert np.allclose([r["bin_lo"] for r in out], edges[:-1])
    flat = op.histogram_minmax(column(spark, [2.0, 2.0]), "v", 4).collect()
    assert sum(r["n"] for r in flat) == 2


def test_boxplot_leaves_outliers_out(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("a", None)], "g string, v double")
    r = op.boxplot_stats(df, "v", "g").first()
    assert (r["whisker_low"], r["q1"], r["median"], r["q3"], r["whisker_high"]) == (1, 2, 3, 4, 4)
    assert r["label"] == "A (n = 5)"


def test_labelled_bins_need_distinct_edges(spark):
    rows = [("A", 0.0, 1.0)] * 9 + [("A", 5.0, 1.0), ("B", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, observed double, abs_error double")
    with pytest.raises(ValueError, match="labels"):
        op.mae_by_reference_bin(df, "A")


def test_reference_edges_leave_outside_values_out(spark):
    rows = [("A", float(i), 1.0) for i in range(11)] + [("B", 100.0, 9.0), ("B", 0.0, 3.0)]
    df = spark.createDataFrame(rows, "model string, observed double, abs_error double")
    out = {r["bin_label"]: r["mae"] for r in op.mae_by_reference_bin(df, "A").where("model = 'B'").collect()}
    assert out == {"Lowest": 3.0}
    wide = {r["bin_label"]: r["mae_B"] for r in op.mae_by_reference_bin(df, "A", models=["A", "B"]).collect()}
    assert wide["Lowest"] == 3.0 and wide["Highest"] is None and len(wide) == 5


def test_long_bins_without_rows_stay_on_request(spark):
    rows = [("A", float(i), 1.0) for i in range(11)] + [("B", 100.0, 9.0), ("B", 0.0, 3.0), (None, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, observed double, abs_error double")
    out = op.mae_by_reference_bin(df, "A", empty_bins=True).collect()
    assert [(r["bin"], r["bin_label"], r["mae"]) for r in out if r["model"] == "B"] == [
        (0, "Lowest", 3.0), (1, "Low-mid", None), (2, "Middle", None), (3, "High-mid", None), (4, "Highest", None)]
    assert len(out) == 10 and all(r["mae"] == 1.0 for r in out if r["model"] == "A")


def test_describe_and_zero_rate(spark):
    df = column(spark, [0.0, 0, 10, 20, None])
    d = op.describe_target(df, "v", [0.5, 0.125]).first()
    assert (d["count"], d["min"], d["max"], d["p50"]) == (4, 0.0, 20.0, 5.0) and d["p12_5"] == 0.0
    z = op.zero_rate(df, "v").first()
    assert z["zero_rate"] == pytest.approx(0.4)


def test_correlation_skips_pairs_and_lists_target(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 2.0), (3.0, 6.0, 3.0)], "a double, b double, t double")
    out = {r["feature"]: r["corr_with_target"] for r in op.corr_with_target(df, ["a", "b"], "t").collect()}
    assert all(v == pytest.approx(1.0) for v in out.values()) and set(out) == {"a", "b", "t"}
    flat = op.corr_with_target(df.withColumn("c", F.lit(1.0)), ["c"], "t").where("feature = 'c'").first()
    assert flat["corr_with_target"] is None


@pytest.mark.parametrize("edges_from", ["own", "union"])
def test_bins_without_rows_keep_their_label(spark, edges_from):
    rows = [("A", float(v), float(v)) for v in range(12)] + [("B", 0.0, 1.0), ("B", 11.0, 1.0)]
    df = op_with_residuals(spark.createDataFrame(rows, "model string, observed double, predicted double"))
    out = op.error_by_observed_bin(df, 3, edges_from).collect()
    assert all(r["bin_label"] for r in out)
    b = [r["n"] for r in sorted((r for r in out if r["model"] == "B"), key=lambda r: r["bin"])]
    assert sum(b) == 2 and 0 in b
