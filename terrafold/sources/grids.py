"""Gridded layers held as long tables ``(grid_id, r, c, value)``."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.session import materialize

# Soil properties, depth layers with their share of 0-30 cm, and
# the divisor that turns stored integers into conventional units.
SOIL_PROPERTIES = ["clay", "sand", "silt", "soc", "phh2o", "bdod", "cfvo"]
DEPTH_WEIGHTS = {"0-5cm": 5 / 30, "5-15cm": 10 / 30, "15-30cm": 15 / 30}
UNIT_DIVISORS = {
    "clay": 10, "sand": 10, "silt": 10, "soc": 10, "phh2o": 10, "bdod": 100,
    "cfvo": 100,  # percent by volume would need 10; kept for equal results
}


@dataclass(frozen=True)
class GridMeta:
    """Position of a grid: corner of cell (0, 0), cell size, and the no-data value."""

    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None = None

    @property
    def geometry(self) -> tuple[float, float, float, float]:
        return (self.x0, self.y0, self.dx, self.dy)


def _has_data(value: str, nodata: float | None) -> Column:
    c = F.col(value)
    if nodata is None:
        return c.isNotNull() & ~F.isnan(c.cast("double"))
    return c.isNotNull() & (c != F.lit(nodata))


def grid_to_points(
    cells: DataFrame,
    grid: GridMeta,
    row: str = "r",
    col: str = "c",
    value: str = "value",
    out: str = "suitability",
) -> DataFrame:
    """Cells with data, placed at their cell centre. No shuffle."""
    return cells.where(_has_data(value, grid.nodata)).select(
        *[c for c in cells.columns if c not in (row, col, value)],
        F.col(row).cast("int").alias("row"),
        F.col(col).cast("int").alias("col"),
        (F.lit(grid.y0) + (F.col(row) + 0.5) * F.lit(grid.dy)).alias("lat"),
        (F.lit(grid.x0) + (F.col(col) + 0.5) * F.lit(grid.dx)).alias("lon"),
        F.col(value).cast("int").alias(out),
    )


def write_tiles(cells: DataFrame, path: str, tile: int, row: str = "r", col: str = "c") -> DataFrame:
    """Store cells by square tiles of ``tile`` rows and columns, one folder per tile, and return them read back.

    A lookup that needs few tiles reads only their folders. A tile is written by
    one task and holds at most ``tile * tile`` cells of each grid.
    """
    cells.withColumn("tile", _tile(row, col, tile)).repartition("tile").write.partitionBy("tile").parquet(path)
    return read_tiles(cells.sparkSession, path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Cells stored by :func:`write_tiles`, with their ``tile``."""
    return spark.read.parquet(path)


def _tile(row: str, col: str, tile: int) -> Column:
    """Number of the tile of a cell."""
    return F.floor(F.col(row) / F.lit(tile)) * F.lit(1 << 24) + F.floor(F.col(col) / F.lit(tile))


def cells_under(cells: DataFrame, places: DataFrame, tile: int, row: str = "r", col: str = "c") -> DataFrame:
    """Tiled cells at the given distinct places (``_r``, ``_c``).

    The tiles of the places are counted first. Their stored table is small, so
    Spark broadcasts it and reads only the folders of these tiles (dynamic
    partition pruning; it looks for a filter on the smaller side, which the count
    gives). Of these, only cells at a place go on.
    """
    number = _tile("_r", "_c", tile).try_cast(cells.schema["tile"].dataType)  # folders are read back as int if they fit
    tiles = materialize(places.groupBy(number.alias("tile")).agg(F.count("*").alias("n")), "tiles").where("n > 0")
    near = cells.join(tiles, "tile", "left_semi")
    place = [F.col(row).cast("long") == places["_r"], F.col(col).cast("long") == places["_c"]]
    return near.join(places, place, "left_semi")


def sample_grid_at_points(
    points: DataFrame,
    cells: DataFrame,
    grids: Mapping[str, GridMeta],
    lat: str = "lat",
    lon: str = "lon",
    grid_id: str = "grid_id",
    row: str = "r",
    col: str = "c",
    value: str = "value",
    tile: int | None = None,
) -> DataFrame:
    """Append one column per grid with the value of the cell under each point.

    Grids that share a geometry are first turned into one wide cell table, so
    the points are joined (and shuffled) once per geometry and not once per
    grid. Points off the grid, missing cells and no-data cells give NULL.
    The wide table is stored first: a small one is then broadcast, and in a
    shuffle join the points of a hot cell are split over tasks.

    With ``tile``, the cells are those of :func:`write_tiles`: only tiles with
    points are read, and only cells under points are shuffled and widened. That reads
    the points twice, so give a stored table where they are expensive to compute.
    """
    by_geometry: dict[tuple, list[str]] = defaultdict(list)
    for name, meta in grids.items():
        by_geometry[meta.geometry].append(name)
    out = points
    for (x0, y0, dx, dy), names in by_geometry.items():
        keep = F.lit(False)
        for name in names:
            keep = keep | ((F.col(grid_id) == name) & _has_data(value, grids[name].nodata))
        place = {
            "_r": F.floor((F.col(lat) - F.lit(y0)) / F.lit(dy)),
            "_c": F.floor((F.col(lon) - F.lit(x0)) / F.lit(dx)),
        }
        wanted = cells.where(keep)
        if tile is not None:
            places = points.select(*[c.alias(n) for n, c in place.items()]).dropna().distinct()
            wanted = cells_under(wanted, materialize(places, "places"), tile, row, col)
        wide = (
            wanted.groupBy(F.col(row).cast("long").alias("_r"), F.col(col).cast("long").alias("_c"))
            .agg(
                *[
                    F.max(F.when(F.col(grid_id) == name, F.col(value).cast("double"))).alias(name)
                    for name in names
                ]
            )
        )
        out = out.withColumns(place).join(materialize(wide, "cells"), ["_r", "_c"], "left").drop("_r", "_c")
    return out


def rescale(df: DataFrame, divisors: Mapping[str, float]) -> DataFrame:
    """Divide each named column by its divisor."""
    return df.withColumns({c: F.col(f"`{c}`") / F.lit(float(d)) for c, d in divisors.items()})


def depth_weighted_mean(df: DataFrame, weights: Mapping[str, float], out: str) -> DataFrame:
    """Append the weighted sum of layer columns; NULL if any layer is missing."""
    total: Column | None = None
    for name, weight in weights.items():
        term = F.col(f"`{name}`") * F.lit(float(weight))
        total = term if total is None else total + term
    return df.withColumn(out, total)
