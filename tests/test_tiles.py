"""Grid lookups from tiles read few of them and give the rows of the plain lookup."""

import pytest
from pyspark.sql import functions as F

from terrafold import sources as src
from terrafold.session import materialize, scratch_path
from terrafold.sources.grids import cells_under

GRID = src.GridMeta(x0=0.0, y0=0.0, dx=1.0, dy=1.0, nodata=-1)
TILE = 8


@pytest.fixture(scope="module")
def cells(spark):
    """Two layers of 160 x 160 cells: 400 tiles."""
    place = spark.range(160 * 160).select((F.col("id") % 160).cast("int").alias("r"), F.expr("int(id div 160)").alias("c"))
    value = lambda k: F.when((F.col("r") + F.col("c")) % 7 == 0, -1).otherwise(F.col("r") * 1000 + F.col("c") + k).cast("int")
    layers = [place.select(F.lit(f"g{k}").alias("grid_id"), "r", "c", value(k).alias("value")) for k in (0, 1)]
    return layers[0].unionByName(layers[1])


@pytest.fixture(scope="module")
def tiled(spark, cells):
    return src.write_tiles(cells, scratch_path(spark, "tiles"), TILE)


def spots(spark, rows):
    return spark.createDataFrame(rows, "name string, lat double, lon double")


ROWS = [("a", 9.5, 9.5), ("b", 10.5, 9.5), ("twice", 9.5, 9.5), ("null", None, 9.5), ("far", 999.0, 9.5), ("below", -0.5, 3.0), ("edge", 15.0, 16.0), ("none", 7.5, 0.5)]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_same_rows_as_the_plain_lookup(spark, cells, tiled, rows):
    points, grids = spots(spark, rows), {"g0": GRID, "g1": GRID}
    plain = src.sample_grid_at_points(points, cells, grids)
    found = src.sample_grid_at_points(points, tiled, grids, tile=TILE)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_grids_of_two_geometries(spark, cells, tiled):
    other = src.GridMeta(x0=-10.0, y0=5.0, dx=0.5, dy=0.25, nodata=-1)
    points, grids = spots(spark, ROWS), {"g0": GRID, "g1": other}
    plain = src.sample_grid_at_points(points, cells, grids)
    found = src.sample_grid_at_points(points, tiled, grids, tile=TILE)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def scans(plan):
    """Scan nodes of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from scans(plan.executedPlan())
    elif "QueryStage" in name:
        yield from scans(plan.plan())
    elif name == "FileSourceScanExec":
        yield plan
    for k in range(plan.children().size()):
        yield from scans(plan.children().apply(k))


def test_few_tiles_are_read(spark, tiled):
    """Points in two of 400 tiles: the scan reads these two folders, and the plan says why."""
    places = materialize(spark.createDataFrame([(9, 9), (10, 9), (17, 20)], "_r long, _c long"), "places")
    rows = cells_under(tiled, places, TILE)
    assert len(rows.collect()) == 6
    plan = rows._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    read = [s.metrics().apply("numPartitions").value() for s in scans(plan) if s.metrics().contains("numPartitions")]
    assert read == [2] and tiled.select("tile").distinct().count() == 400
