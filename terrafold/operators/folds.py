"""Spatial-block folds and the mean baseline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.columns import require_columns
from terrafold.functions.scalars import spatial_block, with_residuals
from terrafold.operators.metrics import regression_metrics
from terrafold.session import materialize

_CELL_DIGITS = 3  # 4,096 hash prefixes per block size


def fold_map(df: DataFrame, block: str, k: int = 5, null_blocks: str = "raise") -> DataFrame:
    """Fold of each block: ``block, n_rows, fold`` with folds numbered from 1.

    Blocks are taken largest first and each goes to the fold with fewest rows
    so far (lowest number on ties). Blocks of equal size are taken in the
    order of ``md5(block), block``.

    Greedy assignment is sequential, but only in the *distinct block sizes*:
    blocks of one size visit the folds in a cycle that follows from the loads
    at the start. So one small pass over the sizes (never more than
    ``sqrt(2 * rows)`` of them) yields, per size, the cycles and the ranks at
    which they begin, and every block finds its fold from its own rank.
    Ranks are counted through hash prefixes, so no window holds all blocks.
    Rows without a block raise, or have no fold with ``null_blocks="keep"``.
    """
    if null_blocks not in ("raise", "keep"):
        raise ValueError("null_blocks must be 'raise' or 'keep'")
    if k < 2:
        raise ValueError("at least two folds are needed")
    every = materialize(
        df.groupBy(F.col(block).alias("block"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("_h", F.md5("block"))
        .withColumn("_p", F.substring("_h", 1, _CELL_DIGITS)),
        "blocks",
    )
    if null_blocks == "raise" and (lost := every.where("block is null").select("n_rows").first()):
        raise ValueError(f"{lost['n_rows']} rows have no {block}; drop them or keep them without a fold")
    blocks = every.where("block is not null")
    cells = blocks.groupBy("n_rows", "_p").agg(F.count(F.lit(1)).alias("_m"))
    sizes = cells.groupBy("n_rows").agg(F.sum("_m").alias("m"))
    n_blocks = blocks.count()
    if n_blocks < k:
        raise ValueError(f"{n_blocks} blocks are not enough for {k} folds")
    plan = materialize(
        sizes.groupBy().applyInPandas(
            lambda pdf: _cycles(pdf, k),
            "n_rows long, first long, last long, cycle array<int>",
        ),
        "cycles",
    )
    earlier_cells = (
        Window.partitionBy("n_rows").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = cells.select("n_rows", "_p", F.coalesce(F.sum("_m").over(earlier_cells), F.lit(0)).alias("_offset"))
    in_cell = Window.partitionBy("n_rows", "_p").orderBy("_h", "block")
    ranked = (
        blocks.withColumn("_i", F.row_number().over(in_cell) - 1)
        .join(offsets, ["n_rows", "_p"])
        .withColumn("_rank", F.col("_i") + F.col("_offset"))
    )
    chosen = ranked.join(plan, "n_rows").where(
        (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last"))
    )
    position = ((F.col("_rank") - F.col("first")) % F.size("cycle")).cast("int")
    return materialize(
        chosen.select("block", "n_rows", F.get("cycle", position).alias("fold")), "folds"
    )


def _cycles(sizes: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per block size: rank ranges [first, last) and the fold cycle used in each."""
    loads = [0] * k
    rows = []
    for size, count in sizes.sort_values("n_rows", ascending=False).itertuples(index=False):
        size, count = int(size), int(count)
        low = min(loads)
        # A fold joins the cycle in the round in which the others reach its load;
        # within a round the lighter fold goes first.
        entry = [((load - low) // size, (load - low) % size, f) for f, load in enumerate(loads)]
        rounds = sorted({r for r, _, _ in entry})
        first = 0
        for r, following in zip(rounds, [*rounds[1:], None]):
            active = [f for _, f in sorted((rest, f) for q, rest, f in entry if q <= r)]
            room = count - first
            span = room if following is None else min(room, (following - r) * len(active))
            if span <= 0:
                break
            rows.append((size, first, first + span, [f + 1 for f in active]))
            full, extra = divmod(span, len(active))
            for place, f in enumerate(active):
                loads[f] += size * (full + (place < extra))
            first += span
    return pd.DataFrame(rows, columns=["n_rows", "first", "last", "cycle"])


def group_kfold(
    df: DataFrame, block: str, k: int = 5, out: str = "fold", null_blocks: str = "raise"
) -> DataFrame:
    """Append the fold of each row's block; no block spans two folds.

    Rows without a block raise, or keep a NULL fold with ``null_blocks="keep"``.

    The stored block table is joined back. Spark broadcasts it when its size
    on disk allows, and otherwise shuffles and splits a hot block's rows.
    """
    folds = fold_map(df, block, k, null_blocks).select(F.col("block").alias(block), F.col("fold").alias(out))
    return df.join(folds, block, "left").select(*df.columns, out)


def spatial_folds(
    df: DataFrame, degrees: float, k: int = 5, lat: str = "lat", lon: str = "lon", out: str = "fold",
    null_blocks: str = "raise",
) -> DataFrame:
    """Folds over square blocks of ``degrees``; the block id is kept as ``block_id``.

    Points without finite coordinates have no block; see :func:`group_kfold`.
    """
    blocked = df.withColumn("block_id", spatial_block(degrees, lat, lon))
    return group_kfold(blocked, "block_id", k, out, null_blocks)


def fold_means(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """Per fold: train/test row counts and target means; one aggregation.

    The training mean is the total minus the fold's own share, so no fold is
    scanned twice.
    """
    every = Window.partitionBy()
    per_fold = df.groupBy(fold).agg(
        F.count(target).alias("_n"), F.sum(F.col(target).cast("double")).alias("_s")
    )
    n_train = F.sum("_n").over(every) - F.col("_n")
    return per_fold.select(
        fold,
        n_train.alias("n_train"),
        F.col("_n").alias("n_test"),
        F.try_divide(F.sum("_s").over(every) - F.col("_s"), n_train).alias("train_mean_prediction"),
        F.try_divide("_s", "_n").alias("test_mean_observed"),
    )


def mean_baseline_folds(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """Fold scores of the mean baseline with its training and test means."""
    means = materialize(fold_means(df, target, fold), "fold-means")
    observed = df.select(fold, F.col(target).cast("double").alias("observed"))
    scores = regression_metrics(
        observed.join(means.select(fold, "train_mean_prediction"), fold),
        "observed",
        "train_mean_prediction",
        [fold],
    )
    return scores.drop("n").join(means, fold)


def mean_baseline_cv(
    df: DataFrame,
    target: str,
    fold: str = "fold",
    keep: tuple[str, ...] = ("row_id", "crop", "lat", "lon"),
    model: str = "mean",
) -> DataFrame:
    """Out-of-fold predictions of the training-fold mean, in the predictions layout."""
    require_columns(df, [target, fold, *keep])
    means = materialize(
        fold_means(df, target, fold).select(fold, F.col("train_mean_prediction").alias("predicted")),
        "fold-means",
    )
    out = df.select(fold, *keep, F.col(target).cast("double").alias("observed")).join(means, fold)
    out = out.withColumnRenamed(fold, "fold") if fold != "fold" else out
    return with_residuals(out).withColumn("model", F.lit(model))
