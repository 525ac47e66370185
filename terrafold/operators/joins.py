"""Joins and unions between stage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import require_columns
from terrafold.session import materialize


def enrich_left(
    points: DataFrame, features: DataFrame, key: str = "cell_id", stored: bool = False, suffix: str | None = None
) -> DataFrame:
    """Left equi-join that keeps unmatched points.

    A feature column that ``points`` has too raises, or gets the ``suffix`` if one is given.
    ``features`` holds one row per key. Unless it is ``stored`` already it is
    written once, so that a small one is broadcast by its true size and points
    that share a hot key are split over tasks.
    """
    require_columns(points, [key], "points")
    require_columns(features, [key], "features")
    shared = [c for c in features.columns if c != key and c in points.columns]
    if shared and suffix is None:
        raise ValueError(f"both tables have {shared}: drop them from one, or give a suffix")
    narrow = features.withColumnsRenamed({c: c + suffix for c in shared}) if shared else features
    return points.join(narrow if stored else materialize(narrow, "features"), key, "left")


def align_tables(left: DataFrame, *others: DataFrame, on: str = "row_id") -> DataFrame:
    """Bring tables with the same row ids side by side; raise if any id is unmatched.

    Inputs must have unique ids. The check is one full-outer count over the
    id columns alone.
    """
    tables = [left, *others]
    marked = [t.select(on).withColumn("_t", F.lit(i)) for i, t in enumerate(tables)]
    ids = marked[0]
    for t in marked[1:]:
        ids = ids.unionByName(t)
    uneven = (
        ids.groupBy(on)
        .agg(*[F.count_if(F.col("_t") == i).alias(f"_{i}") for i in range(len(tables))])
        .agg(*[F.count_if(F.col(f"_{i}") != 1).alias(f"_{i}") for i in range(len(tables))])
        .first()
    )
    if any(uneven):
        raise ValueError(f"tables do not hold the same {on} values once each: {list(uneven)}")
    out = left
    for t in others:
        out = out.join(t, on)
    return out


def union_all(*tables: DataFrame) -> DataFrame:
    """Concatenate by column name; columns absent from one table are NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def pair_models(
    a: DataFrame, b: DataFrame, on: str | Sequence[str] = "fold", suffixes: tuple[str, str] = ("_a", "_b")
) -> DataFrame:
    """Inner-join two metric tables, suffixing columns they share; raise if nothing pairs.

    Metric tables hold a row per fold; the result is stored so that the check
    and later steps do not score the predictions again.
    """
    on = [on] if isinstance(on, str) else list(on)
    shared = [c for c in a.columns if c in b.columns and c not in on]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    paired = materialize(left.join(right, on), "paired")
    if paired.isEmpty():
        raise ValueError(f"no matching {on} between the two tables")
    return paired


def category_bin_grid(report: DataFrame, by: Sequence[str], bin_col: str, bins: int) -> DataFrame:
    """Add the missing (group, bin) combinations to a per-bin report, with NULL measures.

    Each group's bins (at most ``bins`` rows) are gathered and spread again over
    all bin numbers, so nothing is crossed and the report is computed once.
    """
    by = list(by)
    measures = [c for c in report.columns if c not in by and c != bin_col]
    entry = F.when(F.col(bin_col).isNotNull(), F.struct(bin_col, F.struct(*measures)))
    gathered = report.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_bins"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    spread = gathered.select(*by, "_bins", numbers.alias(bin_col))
    found = spread.select(*by, bin_col, F.try_element_at("_bins", bin_col).alias("_m"))
    return found.select(*by, bin_col, *[F.col(f"_m.{c}").alias(c) for c in measures])
