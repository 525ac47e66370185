"""Feature importances and additive per-row contributions of tree ensembles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.columns import require_columns
from terrafold.functions.scalars import guarded_share
from terrafold.sources.models import model_kind
from terrafold.session import materialize, scratch_path

LEAVES_PER_BLOCK = 20_000  # at depth 30 some 17 MB of paths in a task at a time


def top_k_features(importances: DataFrame, k: int, value: str = "importance") -> DataFrame:
    """The ``k`` most important features, ties by name."""
    return importances.orderBy(F.desc(value), "feature").limit(k)


def with_share(
    df: DataFrame, value: str, out: str, scale: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Append the share of ``value`` in its total; the window holds one row per feature."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(out, guarded_share(F.col(value), total, scale))


def group_importance(
    importances: DataFrame, group: Column, value: str = "importance", out: str = "feature_group"
) -> DataFrame:
    """Total importance, feature count and share of each feature group."""
    grouped = (
        importances.withColumn(out, group)
        .groupBy(out)
        .agg(F.sum(value).alias("total_importance"), F.count("feature").alias("n_features"))
    )
    return with_share(grouped, "total_importance", "share").orderBy(F.desc("total_importance"), out)


def mean_abs_contribution(contribs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature and its percentage of the total."""
    means = contribs.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contrib"))
    return with_share(means, "mean_abs_contrib", "importance_pct", 100.0, by).orderBy(
        *by, F.desc("mean_abs_contrib"), "feature"
    )


def contribution_by_category(contribs: DataFrame, category: str = "crop") -> DataFrame:
    """The same within each lower-cased category."""
    named = contribs.where(F.col(category).isNotNull()).withColumn(category, F.lower(category))
    return mean_abs_contribution(named, [category])


def indicator_contribution_summary(contribs: DataFrame, feature: str = "is_wheat") -> DataFrame:
    """Mean contributions of a 0/1 feature: over all rows, where it is 1, where it is 0."""
    c, on, off = F.col("contribution"), F.col("value") == 1, F.col("value") == 0
    return contribs.where(F.col("feature") == feature).agg(
        (F.count(F.lit(1)) > 0).alias("feature_present"),
        F.avg(c).alias("overall_mean_contrib"),
        F.avg(F.abs(c)).alias("overall_mean_abs_contrib"),
        F.count_if(on).alias("rows_when_1"),
        F.count_if(off).alias("rows_when_0"),
        F.avg(F.when(on, c)).alias("mean_contrib_when_1"),
        F.avg(F.when(off, c)).alias("mean_contrib_when_0"),
        F.avg(F.when(on, F.abs(c))).alias("mean_abs_contrib_when_1"),
        F.avg(F.when(off, F.abs(c))).alias("mean_abs_contrib_when_0"),
    )


def bias_summary(rows: DataFrame, bias: str = "bias") -> DataFrame:
    """Mean and population standard deviation of the base value."""
    return rows.agg(F.avg(bias).alias("mean_bias"), F.stddev_pop(bias).alias("std_bias"))


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a saved ensemble: tree, node, children, split, gain, rows, value, tree weight."""
    base = path.rstrip("/")
    nodes = spark.read.parquet(f"{base}/data").select("treeID", "nodeData.*")
    # Stored without stable column names: tree id, metadata text, weight.
    weights = spark.read.parquet(f"{base}/treesMetadata").toDF("treeID", "meta", "weights")
    return nodes.join(weights.drop("meta"), "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature_index"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("split.numCategories").alias("categories"),
        "gain",
        F.col("rawCount").alias("rows"),
        F.col("prediction").alias("value"),
        F.col("weights").alias("weight"),
    )


def feature_importance(
    spark: SparkSession, path: str, features: Sequence[str], kind: str | None = None
) -> DataFrame:
    """Importance of every feature of a saved ensemble: ``feature, importance, share``.

    ``impurity`` (default for forests) weights each split's gain by its rows,
    normalises within each tree and averages the trees. ``gain`` (default for
    boosted trees) is the mean over splits of the loss reduction, which is the
    stored gain per row times the rows of the split. Both are scaled to sum to 1.
    Features that no split uses have importance 0.
    """
    kind = kind or ("impurity" if model_kind(spark, path).startswith("RandomForest") else "gain")
    splits = node_table(spark, path).where(F.col("left") >= 0)
    if kind == "impurity":
        per_tree = splits.groupBy("tree", "feature_index").agg(
            F.sum(F.col("gain") * F.col("rows")).alias("_g")
        )
        per_tree = with_share(per_tree, "_g", "_raw", by=["tree"])
        raw = per_tree.groupBy("feature_index").agg(F.sum("_raw").alias("_raw"))
    elif kind == "gain":
        raw = splits.groupBy("feature_index").agg(F.avg(F.col("gain") * F.col("rows")).alias("_raw"))
    else:
        raise ValueError(f"unknown importance {kind!r}: use 'impurity' or 'gain'")
    highest = raw.agg(F.max("feature_index")).first()[0]
    if highest is not None and highest >= len(features):
        raise ValueError(f"model uses feature {highest}, only {len(features)} names were given")
    names = F.array(*[F.lit(f) for f in features])
    listed = spark.range(1).select(F.posexplode(names).alias("feature_index", "feature"))
    full = listed.join(raw, "feature_index", "left").withColumn("_raw", F.coalesce("_raw", F.lit(0.0)))
    scaled = with_share(full, "_raw", "importance")
    return with_share(scaled, "importance", "share").select("feature", "importance", "share").orderBy(
        F.desc("importance"), "feature"
    )


def _hops(nodes: DataFrame) -> DataFrame:
    """For every node but the roots its parent and the step that leads to it: feature, interval and share of the parent's rows."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    sides = F.array(
        F.struct(F.col("left").alias("node"), low.alias("above"), F.col("threshold").alias("upto")),
        F.struct(F.col("right").alias("node"), F.col("threshold").alias("above"), high.alias("upto")),
    )
    sides = nodes.where("left >= 0").select(
        "tree", F.col("node").alias("up"), "feature_index", F.col("rows").alias("_all"), F.explode(sides).alias("_s")
    ).select("tree", "up", "feature_index", "_all", "_s.*")
    step = F.struct("feature_index", "above", "upto", (F.col("rows") / F.col("_all")).alias("cover"))
    return sides.join(nodes.select("tree", "node", "rows"), ["tree", "node"]).select("tree", "node", "up", F.array(step).alias("steps"))


def _steps_from_root(nodes: DataFrame) -> DataFrame:
    """All steps from the root to each node, by pointer jumping.

    A join replaces every node's ancestor by that ancestor's and puts the
    ancestor's steps before the node's, so the distance doubles each round: log2(depth)
    joins, whatever the number of nodes. Rows hold as many steps as a tree is deep.
    """
    now = materialize(_hops(nodes), "steps")
    while now.where("up is not null").take(1):
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("_further"), F.col("steps").alias("_before"))
        steps = F.coalesce(F.concat("_before", "steps"), F.col("steps"))
        now = materialize(now.join(above, ["tree", "up"], "left").select("tree", "node", F.col("_further").alias("up"), steps.alias("steps")), "steps")
    return now.drop("up")


def leaf_paths(spark: SparkSession, path: str) -> DataFrame:
    """One row per leaf of a saved ensemble: its weighted value and, per feature on its path, interval and share of the rows.

    Features are in order of their first split. Forest trees count with weight
    1/trees, boosted trees with their own. No task holds a whole tree.
    """
    nodes = node_table(spark, path)
    if nodes.where(F.col("categories") > 0).limit(1).count():
        raise ValueError("categorical splits are not supported")
    if model_kind(spark, path).startswith("RandomForest"):
        trees = nodes.agg(F.count_distinct("tree").alias("n")).scalar()
        nodes = nodes.withColumn("weight", 1.0 / trees)
    return paths_of_nodes(nodes)


def paths_of_nodes(nodes: DataFrame) -> DataFrame:
    """:func:`leaf_paths` of a node table with its tree weights."""
    needed = ["tree", "node", "left", "right", "feature_index", "threshold", "rows", "value", "weight"]
    nodes = materialize(nodes.select(*needed), "nodes")
    leaves = nodes.where("left < 0").select("tree", "node", (F.col("value") * F.col("weight")).alias("value"))
    steps = leaves.join(_steps_from_root(nodes), ["tree", "node"], "left")
    index = F.array_distinct(F.transform("steps", lambda s: s["feature_index"]))

    def of_feature(what: str, merge) -> Column:
        return F.transform("index", lambda f: merge(F.transform(F.filter("steps", lambda s: s["feature_index"] == f), lambda s: s[what])))

    product = lambda x: F.aggregate(x, F.lit(1.0), lambda a, y: a * y)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    rows = steps.withColumn("index", index)
    return rows.select(
        "tree", "node", "value", F.coalesce("index", empty("int")).alias("feature_index"),
        F.coalesce(of_feature("above", F.array_max), empty("double")).alias("above"),
        F.coalesce(of_feature("upto", F.array_min), empty("double")).alias("upto"),
        F.coalesce(of_feature("cover", product), empty("double")).alias("cover"),
    )


def stored_paths(paths: DataFrame, leaves_per_block: int) -> tuple[list[str], float]:
    """Write leaf paths to the shared folder in files of bounded size; returns the files and the base value."""
    spark = paths.sparkSession
    folder = scratch_path(spark, "paths")
    paths.select("value", "feature_index", "above", "upto", "cover").write.option("maxRecordsPerFile", leaves_per_block).parquet(folder)
    stored = spark.read.parquet(folder)
    base = stored.agg(F.sum(F.col("value") * F.aggregate("cover", F.lit(1.0), lambda a, y: a * y)))
    return sorted(stored.inputFiles()), float(base.first()[0] or 0.0)


def path_block(file: str) -> list[tuple]:
    """Leaves of one file, stacked into arrays by path length."""
    place, inside = pafs.FileSystem.from_uri(file)
    table = pq.read_table(inside, filesystem=place, partitioning=None).combine_chunks()
    lengths = pc.list_value_length(table["feature_index"]).to_numpy()
    blocks = []
    for length in np.unique(lengths[lengths > 0]).tolist():
        part = table.filter(pa.array(lengths == length))
        columns = [part[c].combine_chunks().flatten().to_numpy().reshape(-1, length) for c in ("feature_index", "above", "upto", "cover")]
        blocks.append((part["value"].to_numpy(), *columns))
    return blocks


def _contributions(x: np.ndarray, blocks: list[tuple]) -> np.ndarray:
    """Path-dependent Shapley values of each row of ``x``.

    For one leaf the weighted sum over feature subsets equals the integral over
    t in [0, 1] of the product of (1 - t) * cover + t * [row takes the branch]
    over the other features: a polynomial, so Gauss-Legendre with half as many
    points as features is exact.
    """
    phi = np.zeros(x.shape)
    for value, index, above, upto, cover in blocks:
        length = index.shape[1]
        points, weights = np.polynomial.legendre.leggauss((length + 1) // 2)
        leaves = 512
        # About a million numbers per array, whatever the batch and model sizes.
        height = max(16, 1_000_000 // (min(leaves, len(value)) * length))
        for start in range(0, len(value), leaves):
            part = slice(start, start + leaves)
            spread = np.zeros((index[part].size, x.shape[1]))
            spread[np.arange(index[part].size), index[part].ravel()] = 1.0
            for top in range(0, len(x), height):
                seen = x[top : top + height][:, index[part]]
                taken = ((seen > above[part]) & (seen <= upto[part])).astype(float)
                share = np.zeros(taken.shape)
                for t, w in zip((points + 1) / 2, weights / 2):
                    factor = (1 - t) * cover[part] + t * taken
                    share += w * factor.prod(axis=2, keepdims=True) / factor
                gain = value[part][:, None] * (taken - cover[part]) * share
                phi[top : top + height] += gain.reshape(len(gain), -1) @ spread
    return phi


def tree_contributions(
    df: DataFrame,
    model_path: str,
    features: Sequence[str],
    key: str = "row_id",
    keep: Sequence[str] = (),
    partitions: int | None = None,
    leaves_per_block: int = LEAVES_PER_BLOCK,
) -> DataFrame:
    """Additive contributions: ``key, keep..., feature, value, contribution, bias``.

    For every row the contributions and the bias add up to the prediction.
    The work per row is large next to its bytes, so a small table gains from
    being spread over ``partitions`` tasks first.
    Contributions add over leaves: the paths lie in the shared folder in files of at most
    ``leaves_per_block`` leaves, and a task reads them one after the other for each of its batches, so any
    model takes one pass over the rows, and neither the driver nor a task holds it
    whole. The folder must be one that Arrow can open (a mounted path, HDFS, S3 or GCS).
    A NULL feature raises, as the model has no prediction there.
    """
    require_columns(df, [key, *keep, *features])
    files, bias = stored_paths(leaf_paths(df.sparkSession, model_path), leaves_per_block)
    names = list(features)
    carried = [key, *[c for c in keep if c != key]]
    numbers = F.array(*[F.col(c).cast("double") for c in names])
    rows = df.select(*carried, numbers.alias("_x"))
    if partitions:
        rows = rows.repartition(partitions, key)
    schema = T.StructType([*rows.schema, T.StructField("_phi", T.ArrayType(T.DoubleType()))])
    rows = rows.mapInArrow(_explain(files), schema)
    entry = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda i: F.struct(
            F.get(F.array(*[F.lit(n) for n in names]), i).alias("feature"),
            F.get("_x", i).alias("value"),
            F.get("_phi", i).alias("contribution"),
        ),
    )
    return rows.select(*carried, F.explode(entry).alias("_e")).select(
        *carried, "_e.feature", "_e.value", "_e.contribution", F.lit(bias).alias("bias")
    )


def _explain(files: list[str]):
    """A function for mapInArrow that appends the contributions of all leaves, read file by file, as ``_phi``."""

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple]] = {}  # the last file's leaves, so a model of one file is read once
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            if np.isnan(x).any():
                raise ValueError("a feature is NULL or NaN: the model has no prediction to explain there")
            phi = np.zeros(x.shape)
            for file in files:
                if file not in kept:
                    kept.clear()
                    kept[file] = path_block(file)
                phi += _contributions(x, kept[file])
            ends = pa.array(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], names=[*batch.schema.names, "_phi"]
            )

    return explain
