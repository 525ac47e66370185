"""From a merged table to a model-ready one."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import (
    SOIL_KEYWORDS,
    drop_columns,
    dropped_columns,
    resolve_columns,
    select_by_keyword,
)
from terrafold.functions.scalars import clip_target, encode_category
from terrafold.operators.quantiles import column_quantiles

# Service coordinates that are never predictors.
SERVICE_COLUMNS = ["power_lat", "power_lon"]


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast to double; text that is no number, and NaN, become NULL."""

    def number(c: str) -> Column:
        parsed = F.col(c).try_cast("double")
        return F.when(~F.isnan(parsed), parsed)

    return df.withColumns({c: number(c) for c in columns})


def drop_failed_rows(df: DataFrame, error_col: str = "power_error") -> DataFrame:
    """Drop rows that carry an error, then the error column; no-op without it."""
    if error_col not in df.columns:
        return df
    return df.where(F.col(error_col).isNull()).drop(error_col)


def all_missing(columns: Sequence[str]) -> Column:
    """True where every column is NULL; its negation is pushed down to a Parquet scan."""
    return reduce(and_, [F.col(c).isNull() for c in columns])


def drop_all_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows in which every one of ``columns`` is NULL."""
    if not columns:
        raise ValueError("no columns given")
    return df.where(~all_missing(columns))


def dropna_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL or NaN in any of ``columns``."""
    return df.dropna(subset=list(columns))


def drop_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Rows each step drops, in order, and their share of the rows left by the steps before: ``step, dropped, rate``."""
    left, counts = F.lit(True), []
    for name, condition in conditions.items():
        hit = F.coalesce(condition, F.lit(False))
        counts.append(F.struct(F.lit(name).alias("step"), F.count_if(left & hit).alias("dropped"), F.count_if(left).alias("_n")))
        left = left & ~hit
    wide = df.agg(F.array(*counts).alias("_steps"))
    return wide.select(F.explode("_steps").alias("_s")).select(
        "_s.step", "_s.dropped", F.try_divide("_s.dropped", "_s._n").alias("rate")
    )


def finite_filter(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows in which all of ``columns`` are finite numbers."""
    keep = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        keep = keep & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return df.where(keep)


def category_filter(df: DataFrame, category: str, value: str) -> DataFrame:
    """Rows of one category, ignoring case; an unknown category gives an empty table."""
    return df.where(F.lower(F.col(category)) == value.lower())


def missing_profile(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6
) -> DataFrame:
    """NULL or NaN share of each column in percent: ``column, missing_pct``. One scan."""
    columns = list(df.columns if columns is None else columns)
    fractional = {c for c, t in df.dtypes if t in ("double", "float")}

    def missing(c: str) -> Column:
        v = F.col(f"`{c}`")
        return v.isNull() | F.isnan(v) if c in fractional else v.isNull()

    wide = df.agg(*[(F.avg(missing(c).cast("double")) * 100).alias(c) for c in columns])
    return wide.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "missing_pct").withColumn(
        "missing_pct", F.round("missing_pct", digits)
    )


def median_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column, all columns together; NULL and NaN are ignored."""
    # One number per column reaches the driver.
    return {c: quantiles[0] for c, (_, quantiles) in column_quantiles(df, columns, [0.5]).items()}


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULLs with the column median; a column that is all NULL stays NULL."""
    medians = median_values(df, columns)
    return df.withColumns(
        {
            c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m))
            for c, m in medians.items()
            if m is not None
        }
    )


def assert_no_missing(df: DataFrame, columns: Sequence[str] | None = None, top: int = 15) -> DataFrame:
    """Return ``df``, or raise naming the columns with most NULL and NaN values (one scan)."""
    profile = missing_profile(df, columns, digits=6)
    worst = (
        profile.where(F.col("missing_pct") > 0)
        .orderBy(F.desc("missing_pct"), "column")
        .limit(top)
        .collect()
    )
    if worst:
        shown = ", ".join(f"{r['column']}={r['missing_pct']}%" for r in worst)
        raise ValueError(f"missing values remain: {shown}")
    return df


@dataclass
class Prepared:
    """A prepared table, the columns it is made of, and its one-row report."""

    table: DataFrame
    report: DataFrame
    features: list[str]
    columns: dict[str, str]
    soil: list[str] = field(default_factory=list)


def prep_report(
    merged: DataFrame,
    target: str,
    soil: Sequence[str],
    error_col: str = "power_error",
    clip: tuple[float, float] | None = (0, 10000),
    medians: Mapping[str, float | None] | None = None,
    constants: Mapping[str, object] | None = None,
) -> DataFrame:
    """What preparation does to ``merged``, as one row from one scan.

    Rates are over the rows left by the step before. ``medians`` tells which
    soil columns get filled; without it every column is taken to have one.
    """
    failed = F.col(error_col).isNotNull() if error_col in merged.columns else F.lit(False)
    bare = all_missing(soil)
    kept = ~failed & ~bare
    value = F.col(target) if clip is None else clip_target(target, *clip)
    n, ok = F.count(F.lit(1)), F.count_if(~failed)

    def pct(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(100 * part / whole, 6))

    before = [pct(F.count_if(~failed & F.col(c).isNull()), ok).alias(c) for c in soil]
    after = [
        pct(
            F.count_if(kept & F.col(c).isNull())
            if medians is not None and medians.get(c) is None
            else F.count_if(F.lit(False)),
            F.count_if(kept),
        ).alias(c)
        for c in soil
    ]
    fixed = [
        F.lit(v if not isinstance(v, (list, dict)) else json.dumps(v)).alias(k)
        for k, v in (constants or {}).items()
    ]
    return merged.agg(
        n.alias("n_rows_in"),
        F.lit(len(merged.columns)).alias("n_cols_in"),
        F.count_if(kept).alias("n_rows_out"),
        F.count_if(failed).alias("dropped_failed_rows"),
        F.when(n > 0, F.count_if(failed) / n).alias("dropped_failed_rate"),
        F.count_if(~failed & bare).alias("dropped_all_missing_rows"),
        F.when(ok > 0, F.count_if(~failed & bare) / ok).alias("dropped_all_missing_rate"),
        F.struct(*before).alias("soil_missing_before_pct"),
        F.struct(*after).alias("soil_missing_after_pct"),
        F.min(F.when(kept, value)).cast("double").alias("target_min"),
        F.max(F.when(kept, value)).cast("double").alias("target_max"),
        *fixed,
    )


def prepare(
    merged: DataFrame,
    row_id: str,
    clip: tuple[float, float] | None = (0, 10000),
    drop_location: bool = True,
    error_col: str = "power_error",
    exclude: Sequence[str] = ("cell_id", "row", "col"),
    check: bool = True,
) -> Prepared:
    """Drop failed rows, drop bare rows, impute, encode and clip, in this order.

    Medians are taken over all remaining rows, before any fold is drawn. The
    result is one table keyed by ``row_id`` that holds meta columns, target
    and features together. ``features`` leaves out the identifiers in
    ``exclude``; the report counts them as X columns.
    """
    names = resolve_columns(merged)
    auxiliary = dropped_columns(merged, SERVICE_COLUMNS)
    rows = drop_columns(drop_failed_rows(merged, error_col), auxiliary)
    soil = select_by_keyword(rows, SOIL_KEYWORDS)
    if not soil:
        raise ValueError(f"no soil column found; expected one of {SOIL_KEYWORDS} in a name")
    rows = drop_all_missing(rows, soil)
    medians = median_values(rows, soil)
    filled = rows.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items() if m is not None}
    ).withColumn("is_wheat", encode_category(names["crop"]))
    if clip is not None:
        filled = filled.withColumn(names["target"], clip_target(names["target"], *clip))
    left_out = {names["target"], names["crop"]}
    if drop_location:
        left_out |= {names["lat"], names["lon"]}
    x_cols = [c for c in filled.columns if c not in left_out]
    if check:
        assert_no_missing(filled, x_cols)
    features = [c for c in x_cols if c not in (row_id, *exclude)]
    dropped = dropped_columns(merged, [error_col]) + auxiliary
    report = prep_report(
        merged, names["target"], soil, error_col, clip, medians,
        {"target_col": names["target"], "crop_col": names["crop"], "lat_col": names["lat"],
         "lon_col": names["lon"], "dropped_cols": dropped, "soil_cols": soil,
         "x_num_features": len(x_cols)},
    )
    return Prepared(filled, report, features, names, soil)
