"""Sets of tables that become visible together.

The tables of a set go to a folder of their own, and a manifest that lists them
is written last. Readers take only what the newest manifest lists, so a set that
failed half-way is never read and the one before stays readable. A manifest is a
single file that Spark's commit puts in place by renaming.

Defined cases: a folder without a manifest raises; a set may be empty; a table
without rows keeps its columns and types; an empty text in CSV comes back as NULL. Two sets published at the same moment
get the same number, and the one whose folder sorts last is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Text comes back as it was: quotes are doubled, blanks at the ends stay, and line breaks may occur.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _manifest(spark: SparkSession, directory: str) -> dict | None:
    """The newest complete manifest, if there is one (one line per set reaches the driver)."""
    try:
        lines = spark.read.text(f"{directory}/manifests/*").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    records = [json.loads(r["value"]) for r in lines]
    return max(records, key=lambda r: (r["version"], r["folder"]), default=None)


def publish_tables(spark: SparkSession, tables: Mapping[str, DataFrame], directory: str, kind: str = "parquet") -> int:
    """Write the tables as Parquet, CSV or JSON and make them the set that readers see; returns its number."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported table type {kind!r}: use parquet, csv or json")
    directory = directory.rstrip("/")
    before = _manifest(spark, directory)
    folder = f"sets/{uuid.uuid4().hex}"
    for name, table in tables.items():
        writer = table.write.options(**_CSV) if kind == "csv" else table.write
        writer.format(kind).save(f"{directory}/{folder}/{name}.{kind}")
    record = {
        "version": before["version"] + 1 if before else 1, "folder": folder, "kind": kind,
        "tables": {name: table.schema.jsonValue() for name, table in tables.items()},
    }
    line = spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1)
    line.write.text(f"{directory}/manifests/{record['version']:08d}-{folder.rpartition('/')[2]}")
    return record["version"]


def read_published(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The tables of the newest set by name, with the types they were written with."""
    directory = directory.rstrip("/")
    record = _manifest(spark, directory)
    if record is None:
        raise FileNotFoundError(f"no published tables in {directory}")
    options = {**_CSV, "multiLine": True} if record["kind"] == "csv" else {}
    found = {}
    for name, kinds in record["tables"].items():
        reader = spark.read.options(**options).format(record["kind"]).schema(T.StructType.fromJson(kinds))
        found[name] = reader.load(f"{directory}/{record['folder']}/{name}.{record['kind']}")
    return found
