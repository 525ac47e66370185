"""Quantiles of many columns, against numpy."""

import numpy as np
import pandas as pd
import pytest

from terrafold import operators as op
from terrafold.operators.quantiles import column_quantiles

PROBS = [0.0, 0.1, 0.5, 0.977, 1.0]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    n = 20_001
    hot = rng.normal(size=n)
    hot[: n // 3] = 0.25  # a third of all rows hold one value
    data = {
        "plain": rng.normal(size=n), "hot": hot, "few": rng.integers(0, 3, n).astype(float),
        "constant": np.full(n, 4.0), "wide": np.exp(rng.normal(size=n) * 50), "gaps": np.where(rng.random(n) < 0.9, np.nan, rng.random(n)),
        "ends": np.where(rng.random(n) < 0.2, np.inf, np.where(rng.random(n) < 0.2, -np.inf, rng.random(n))),
        "zeros": np.where(rng.random(n) < 0.5, -0.0, 0.0), "empty": np.full(n, np.nan),
    }
    return pd.DataFrame(data)


@pytest.mark.parametrize("rows_per_task", [1, 300, 100_000])
def test_equals_numpy(spark, table, rows_per_task):
    found = column_quantiles(spark.createDataFrame(table).repartition(5), table.columns, PROBS, rows_per_task)
    for c in table.columns:
        values = np.sort(table[c].dropna().to_numpy())
        n, quantiles = found[c]
        assert n == len(values)
        for p, got in zip(PROBS, quantiles):
            if not n:
                assert got is None
                continue
            place = (n - 1) * p
            low, high = int(np.floor(place)), int(np.ceil(place))
            a, b = values[low], values[high]
            assert got == (a if a == b else (high - place) * a + (place - low) * b), (c, p)


def test_poor_sketch_changes_nothing(spark, table, monkeypatch):
    from terrafold.operators import quantiles

    df = spark.createDataFrame(table[["plain", "hot", "gaps"]])
    expected = column_quantiles(df, df.columns, PROBS)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 200)
    assert column_quantiles(df, df.columns, PROBS, 2000) == expected


def test_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None)], "`a.b` int, `c d` double")
    assert op.median_values(df, ["a.b", "c d"]) == {"a.b": 2.0, "c d": 2.0}
    assert op.median_values(df.limit(0), ["a.b"]) == {"a.b": None} and op.median_values(df, []) == {}
