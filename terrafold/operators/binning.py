"""Quantile bins, fixed cuts and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.scalars import interval_label
from terrafold.operators.quantiles import exact_quantiles
from terrafold.session import materialize


def quantile_edges(
    df: DataFrame, c: str, q: int, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Distinct quantile edges per group: ``by..., edges``; at most ``q + 1`` values."""
    probs = [i / q for i in range(q + 1)]
    found = exact_quantiles(df, c, probs, by, weight)
    return materialize(
        found.select(*by, F.array_sort(F.array_distinct("quantiles")).alias("edges")), "edges"
    )


def right_closed_bin(c: Column, edges: Column, max_edges: int) -> Column:
    """0-based bin of ``c`` among ``edges``: right-closed, the first bin holds its minimum.

    The comparison is unrolled over ``max_edges`` so it stays in generated
    code. Values outside the edges and NULL give NULL.
    """
    low, high = F.get(edges, F.lit(0)), F.element_at(edges, -1)
    passed = reduce(
        add,
        [F.coalesce((c > F.get(edges, F.lit(i))).cast("int"), F.lit(0)) for i in range(max_edges)],
    )
    return F.when((c >= low) & (c <= high), F.greatest(passed - 1, F.lit(0)))


def attach_edges(df: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Put the edges of each group on its rows.

    Without groups the edges are one scalar sub-query. With groups the edge
    table is joined; its stored size decides whether Spark broadcasts it.
    """
    if by:
        return df.join(edges, list(by), "left")
    return df.withColumn("edges", edges.select("edges").scalar())


def quantile_bins(
    df: DataFrame, c: str, q: int, by: Sequence[str] = (), out: str = "bin"
) -> DataFrame:
    """Append the quantile bin of ``c``: index ``out`` and bounds ``{out}_lo/_hi``.

    Edges are linearly interpolated quantiles with duplicates dropped, so
    ties give fewer than ``q`` bins.
    """
    return bin_by_edges(df, c, quantile_edges(df, c, q, by), q + 1, by, out)


def bin_by_edges(
    df: DataFrame, c: str, edges: DataFrame, max_edges: int, by: Sequence[str] = (), out: str = "bin"
) -> DataFrame:
    """Like :func:`quantile_bins` with edges that were computed before."""
    placed = attach_edges(df, edges, by).withColumn(
        out, right_closed_bin(F.col(c).cast("double"), F.col("edges"), max_edges)
    )
    return placed.withColumns(
        {
            f"{out}_lo": F.get("edges", F.col(out)),
            f"{out}_hi": F.get("edges", F.col(out) + 1),
        }
    ).drop("edges")


def with_interval_label(df: DataFrame, bin_col: str = "bin", out: str = "bin_label") -> DataFrame:
    """Append the printed interval of a bin."""
    return df.withColumn(
        out, interval_label(F.col(f"{bin_col}_lo"), F.col(f"{bin_col}_hi"), F.col(bin_col) == 0)
    )


def cut_by_edges(
    df: DataFrame,
    c: str,
    edges: Sequence[float],
    labels: Sequence[str] | None = None,
    out: str = "bin",
) -> DataFrame:
    """Append the bin of ``c`` for given edges (right-closed, minimum included)."""
    edges = [float(e) for e in edges]
    if sorted(set(edges)) != edges:
        raise ValueError("edges must increase strictly")
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError(f"{len(labels)} labels do not match {len(edges) - 1} bins")
    found = right_closed_bin(
        F.col(c).cast("double"), F.array(*[F.lit(e) for e in edges]), len(edges)
    )
    if labels is None:
        return df.withColumn(out, found)
    return df.withColumn(out, F.get(F.array(*[F.lit(x) for x in labels]), found))


def _bin_of(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; the last one is closed on the right, others are half-open."""
    scaled = F.floor((c - low) / ((high - low) / F.lit(float(bins))))
    inside = F.when(c == high, F.lit(bins - 1)).otherwise(F.least(scaled, F.lit(bins - 1)))
    return F.when((c >= low) & (c <= high), inside.cast("int"))


def histogram(
    df: DataFrame, c: str, bins: int, low: float, high: float, by: Sequence[str] = ()
) -> DataFrame:
    """Counts in ``bins`` equal bins over the closed range [low, high], empty bins kept.

    Values outside the range are left out. One aggregation; the bin grid is
    exploded from the groups that exist.
    """
    by = list(by)
    lo, hi = F.lit(float(low)), F.lit(float(high))
    counts = (
        df.withColumn("bin", _bin_of(F.col(c).cast("double"), lo, hi, bins))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _with_empty_bins(counts, bins, by).select(
        *by,
        "bin",
        (lo + F.col("bin") * ((hi - lo) / bins)).alias("bin_lo"),
        (lo + (F.col("bin") + 1) * ((hi - lo) / bins)).alias("bin_hi"),
        "n",
    )


def histogram_minmax(df: DataFrame, c: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal bins over each group's own minimum to maximum.

    A constant group is centred in a range of width one.
    """
    by = list(by)
    v = F.col(c).cast("double")
    rows = df.select(*by, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    limits = rows.groupBy(*by).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max")).select(
        *by,
        F.when(F.col("_min") < F.col("_max"), F.col("_min")).otherwise(F.col("_min") - 0.5).alias("_lo"),
        F.when(F.col("_min") < F.col("_max"), F.col("_max")).otherwise(F.col("_max") + 0.5).alias("_hi"),
    )
    limits = materialize(limits, "limits")
    if by:
        placed = rows.join(limits, by)
    else:
        pair = F.struct("_lo", "_hi")
        placed = rows.withColumn("_lim", limits.select(pair.alias("p")).scalar()).select(
            "_v", "_lim._lo", "_lim._hi"
        )
    counts = (
        placed.withColumn("bin", _bin_of(F.col("_v"), F.col("_lo"), F.col("_hi"), bins))
        .groupBy(*by, "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return _with_empty_bins(counts, bins, [*by, "_lo", "_hi"]).select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        "n",
    )


def _with_empty_bins(counts: DataFrame, bins: int, by: list[str]) -> DataFrame:
    """Add zero rows for absent bins: gather each group's counts (at most ``bins``), then spread them."""
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))
    gathered = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_counts"))
    spread = gathered.select(*by, "_counts", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spread.select(*by, "bin", F.coalesce(F.try_element_at("_counts", "bin"), F.lit(0)).alias("n"))
