"""Table readers and writers (Parquet, CSV, JSON)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.columns import PREDICTION_ROLES, require_columns, resolve_columns
from terrafold.functions.scalars import nan_to_null

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("fold", T.IntegerType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("crop", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("observed", T.DoubleType()),
        T.StructField("predicted", T.DoubleType()),
        T.StructField("residual", T.DoubleType()),
        T.StructField("abs_error", T.DoubleType()),
        T.StructField("squared_error", T.DoubleType()),
    ]
)

# Leading columns of the run table, in this order when present.
RUN_COLUMN_ORDER = [
    "run_name", "model_name", "spatial_block_deg",
    "spatial_r2_mean", "spatial_r2_std",
    "spatial_rmse_mean", "spatial_rmse_std",
    "spatial_mae_mean", "spatial_mae_std",
    "n_estimators", "max_depth", "min_samples_leaf", "max_features",
    "random_state", "n_splits", "drop_index_cols", "n_features_used", "n_rows", "file",
]
# Types of the columns whose values may all be null.
RUN_TYPES = {
    "n_estimators": "long", "max_depth": "long", "min_samples_leaf": "long", "max_features": "string",
    "random_state": "long", "learning_rate": "double", "subsample": "double", "colsample_bytree": "double",
}


def _suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    clean_nan: bool = False,
) -> DataFrame:
    """Read ``.parquet``, ``.csv`` or ``.txt`` by suffix.

    NaN in text files becomes NULL. Parquet written by Spark or Arrow holds
    NULLs already; ask for ``clean_nan`` only where a file holds NaN, because
    filters on a replaced column no longer reach the scan. Pass ``schema`` for
    text files of any size: without it Spark reads them once more to infer it.
    """
    kind = _suffix(path)
    if kind == ".parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        table = reader.parquet(path)
        return nan_to_null(table) if clean_nan else table
    if kind in (".csv", ".txt"):
        reader = spark.read.option("header", True)
        reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
        return nan_to_null(reader.csv(path))
    raise ValueError(f"unsupported file type {kind!r}: use .parquet, .csv or .txt")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``.parquet`` or ``.csv`` by suffix."""
    kind = _suffix(path)
    if kind == ".parquet":
        df.write.mode(mode).parquet(path)
    elif kind == ".csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported output type {kind!r}: use .parquet or .csv")


def write_reports(
    tables: Mapping[str, DataFrame], directory: str, kind: str = "csv", mode: str = "errorifexists"
) -> None:
    """Write each table as CSV or JSON under its name; adaptive execution keeps small ones in one file."""
    for name, table in tables.items():
        writer = table.write.mode(mode)
        path = f"{directory.rstrip('/')}/{name}.{kind}"
        if kind == "csv":
            writer.option("header", True).csv(path)
        elif kind == "json":
            writer.json(path)
        else:
            raise ValueError(f"unsupported report type {kind!r}: use csv or json")


def split_by_category_sink(
    df: DataFrame, category: str, path: str, mode: str = "errorifexists"
) -> None:
    """Write one Parquet folder per lower-cased category under ``path``.

    The folder column is ``category_key``, so a reader that asks for one
    category touches only that folder; the original column is kept.
    """
    (
        df.withColumn("category_key", F.lower(F.col(category)))
        .write.mode(mode)
        .partitionBy("category_key")
        .parquet(path)
    )


def write_model_ready(
    df: DataFrame,
    directory: str,
    tag: str,
    row_id: str,
    target: str,
    meta: Sequence[str],
    report: DataFrame | None = None,
    exclude: Sequence[str] = (),
    soil_cols: Sequence[str] = (),
    views: bool = True,
) -> str:
    """Write the prepared table and its X / y / meta views under ``directory/tag``.

    ``prepared`` is the table later stages read. The views each carry
    ``row_id``, because Spark rows have no stable position; leave them out
    with ``views=False`` where nobody outside reads them.
    """
    spark = df.sparkSession
    base = f"{directory.rstrip('/')}/{tag}"
    require_columns(df, [row_id, target, *meta], "prepared table")
    left_out = {target, *meta, *exclude, row_id}
    x_cols = [c for c in df.columns if c not in left_out]
    df.write.parquet(f"{base}/prepared.parquet")
    stored = spark.read.schema(df.schema).parquet(f"{base}/prepared.parquet")
    if views:
        stored.select(row_id, *x_cols).write.parquet(f"{base}/X.parquet")
        stored.select(row_id, target).write.parquet(f"{base}/y.parquet")
        stored.select(row_id, *[c for c in meta if c != row_id]).write.parquet(f"{base}/meta.parquet")
    features = {"target": target, "row_id": row_id, "meta": list(meta),
                "soil_cols": list(soil_cols), "X_cols": x_cols}
    spark.createDataFrame([(json.dumps(features),)], "value string").coalesce(1).write.text(
        f"{base}/feature_list.json"
    )
    if report is not None:
        report.coalesce(1).write.json(f"{base}/data_report.json")
    return base


def read_model_ready(spark: SparkSession, base: str, views: bool = False) -> tuple[DataFrame, dict]:
    """Read what :func:`write_model_ready` wrote: the table and the feature list.

    With ``views`` the table is put together from X, y and meta, which must
    hold the same row ids.
    """
    listed = json.loads(spark.read.text(f"{base}/feature_list.json").first()[0])
    if not views:
        return spark.read.parquet(f"{base}/prepared.parquet"), listed
    from terrafold.operators.joins import align_tables  # operators import this module

    parts = [spark.read.parquet(f"{base}/{name}.parquet") for name in ("X", "y", "meta")]
    return align_tables(*parts, on=listed["row_id"]), listed


def read_predictions(
    spark: SparkSession, path: str, model: str, schema: T.StructType = PREDICTION_SCHEMA
) -> DataFrame:
    """Read an out-of-fold predictions CSV with a fixed schema, tagged with ``model``."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, schema.fieldNames(), path)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    return nan_to_null(header.select(*typed)).withColumn("model", F.lit(model))


def read_predictions_lenient(source: DataFrame | str, model: str, spark: SparkSession | None = None) -> DataFrame:
    """Project any predictions table, or CSV file with a header, to ``model, fold, observed, predicted``.

    Columns are found by their usual names. A path needs the session.
    """
    if isinstance(source, str):
        if spark is None:
            raise ValueError("reading a path needs the Spark session")
        df = nan_to_null(spark.read.option("header", True).option("inferSchema", False).csv(source))
    else:
        df = source
    names = resolve_columns(df, PREDICTION_ROLES, substring_roles=())
    return df.select(
        F.lit(model).alias("model"),
        F.col(names["fold"]).cast("int").alias("fold"),
        F.col(names["observed"]).cast("double").alias("observed"),
        F.col(names["predicted"]).cast("double").alias("predicted"),
    )


def write_run_metrics(spark: SparkSession, path: str, record: Mapping) -> None:
    """Write one run record (nested ``params`` / ``spatial_cv`` allowed) as JSON."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(path)


def read_run_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """Read nested run records and flatten them to one row per run.

    A record may span lines. ``params.*`` keeps its names and ``spatial_cv.*``
    gets a ``spatial_`` prefix. Columns that a run does not have are NULL, and
    known columns have a fixed type, also where every run has null. ``file`` is
    the record's file, or its folder if Spark wrote it. A file that is no JSON
    record raises.
    """
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(glob)
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    plain = ["run_name", "model_name", "n_rows", "n_features_used", "drop_index_cols"]
    cols = [F.col(c) for c in plain if c in kinds]
    if isinstance(kinds.get("params"), T.StructType):
        cols += [F.col(f"params.{n}").alias(n) for n in kinds["params"].fieldNames() if n not in plain]
    if isinstance(kinds.get("spatial_cv"), T.StructType):
        cols += [F.col(f"spatial_cv.{n}").alias(f"spatial_{n}") for n in kinds["spatial_cv"].fieldNames()]
    steps = F.split(F.col("_metadata.file_path"), "/")
    own, folder = F.element_at(steps, -1), F.element_at(steps, -2)
    flat = raw.select(*cols, F.when(own.startswith("part-"), folder).otherwise(own).alias("file"))
    typed = {c: F.col(c).cast(kind) for c, kind in RUN_TYPES.items() if c in flat.columns}
    flat = flat.withColumns(typed)
    order = [c for c in RUN_COLUMN_ORDER if c in flat.columns]
    return flat.select(*order, *[c for c in flat.columns if c not in order])
