"""Sets of tables that become visible together."""

import pytest
from pyspark.sql import functions as F

from terrafold import sources as src

ROWS = [(1, "a,\"b\"\n c ", 0.1, None), (2, "", None, True), (3, None, 2.5, False)]
SCHEMA = "k int, s string, v double, b boolean"


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA)
    src.publish_tables(spark, {"t": df, "none": df.limit(0)}, f"{tmp_path}/out", kind)
    found = src.read_published(spark, f"{tmp_path}/out/")
    expected = [tuple(None if kind == "csv" and v == "" else v for v in r) for r in ROWS]
    assert sorted(map(tuple, found["t"].collect())) == expected
    assert found["none"].dtypes == df.dtypes and found["none"].count() == 0


def test_failed_set_is_never_read(spark, tmp_path):
    where = f"{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        src.read_published(spark, where)
    df = spark.createDataFrame(ROWS, SCHEMA)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        src.publish_tables(spark, {"a": df, "b": broken}, where)
    with pytest.raises(FileNotFoundError):
        src.read_published(spark, where)
    assert src.publish_tables(spark, {"a": df}, where) == 1
    with pytest.raises(Exception, match="no"):
        src.publish_tables(spark, {"a": df.limit(1), "b": broken}, where)
    assert src.read_published(spark, where).keys() == {"a"} and src.read_published(spark, where)["a"].count() == 3
    assert src.publish_tables(spark, {"a": df.limit(1)}, where) == 2
    assert src.read_published(spark, where)["a"].count() == 1


def test_manifest_cut_short_is_ignored(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    src.publish_tables(spark, {"a": df}, str(tmp_path))
    left = tmp_path / "manifests" / "00000002-left" / "_temporary"
    left.mkdir(parents=True)
    (left / "part-0").write_text('{"version": 2')
    assert src.read_published(spark, str(tmp_path))["a"].count() == 3
