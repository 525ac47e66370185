"""Landed climate-service responses to one feature row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import materialize

# Requested parameters and the periods a climatology reports.
CLIMATE_PARAMS = [
    "PRECTOTCORR", "T2M", "T2M_MIN", "T2M_MAX", "RH2M", "ALLSKY_SFC_SW_DWN", "WS2M", "T2MDEW",
]
CLIMATE_PERIODS = [
    "JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC", "ANN",
]

# A parameter is normally an object of periods but may be one number, so its
# text is kept here and read a second time in flatten_climatology.
RESPONSE_SCHEMA = (
    "struct<geometry: struct<coordinates: array<double>>,"
    " properties: struct<elevation: string, parameter: map<string, string>>,"
    " _corrupt_record: string>"
)


def parse_climatology(responses: DataFrame, body: str = "body") -> DataFrame:
    """Append ``parsed``, the typed response; ``_corrupt_record`` holds text that is not valid JSON."""
    return responses.withColumn("parsed", F.from_json(F.col(body), RESPONSE_SCHEMA))


def flatten_climatology(
    parsed: DataFrame,
    params: Sequence[str] = CLIMATE_PARAMS,
    periods: Sequence[str] = CLIMATE_PERIODS,
    scalar_params: Sequence[str] = (),
) -> DataFrame:
    """Replace ``parsed`` by ``{PARAM}_{PERIOD}`` columns and the grid-point location.

    A pure projection: the parameter and period lists are given, so no
    explode, pivot or shuffle is needed. ``scalar_params`` are parameters the
    service reports as a single number; they become a column ``{PARAM}``.
    """
    keep = [c for c in parsed.columns if c != "parsed"]
    coords = F.col("parsed.geometry.coordinates")
    has_pair = F.size(coords) >= 2
    located = parsed.select(
        *keep,
        F.when(has_pair, F.get(coords, F.lit(0))).alias("power_lon"),
        F.when(has_pair, F.get(coords, F.lit(1))).alias("power_lat"),
        F.col("parsed.properties.elevation").try_cast("double").alias("power_elevation_m"),
        F.struct(
            *[
                F.from_json(F.col("parsed.properties.parameter")[p], "map<string, double>").alias(p)
                for p in params
            ]
        ).alias("_by_period"),
        *[
            F.col("parsed.properties.parameter")[p].try_cast("double").alias(p)
            for p in scalar_params
        ],
    )
    wide = [
        F.col(f"_by_period.{p}")[period].alias(f"{p}_{period}") for p in params for period in periods
    ]
    rest = [c for c in located.columns if c != "_by_period"]
    return located.select(*rest, *wide)


def ingest_climatology(
    responses: DataFrame,
    key: str = "cell_id",
    params: Sequence[str] = CLIMATE_PARAMS,
    periods: Sequence[str] = CLIMATE_PERIODS,
    scalar_params: Sequence[str] = (),
) -> DataFrame:
    """One feature row per key from a table ``(key, attempt, status, body)``.

    The first successful attempt wins. A key without any success keeps NULL
    features and the error of its last attempt in ``power_error``.

    Each body is parsed once and shrinks to its numbers before the shuffle.
    ``min_by`` / ``max_by`` then combine within each input partition, so a key
    with very many attempts sends one row per partition.
    """
    answered = F.col("status").between(200, 299)
    parsed = parse_climatology(responses.select(key, "attempt", "status", "body"))
    readable = F.col("parsed").isNotNull() & F.col("parsed._corrupt_record").isNull()
    flat = flatten_climatology(
        parsed.withColumn("_ok", answered & readable).drop("body"), params, periods, scalar_params
    )
    values = [c for c in flat.columns if c not in (key, "attempt", "status", "_ok")]
    # Numbers only, so that the aggregation hashes and does not sort. All share one order, so all come from one attempt.
    failure = F.when(answered, F.lit(0)).otherwise(F.col("status").cast("int"))
    first, last = F.when(F.col("_ok"), F.col("attempt")), F.when(~F.col("_ok"), F.col("attempt"))
    chosen = flat.groupBy(key).agg(
        *[F.min_by(c, first).alias(f"_first_{c}") for c in values],
        F.max_by(failure, last).alias("_failure"),
        F.bool_or("_ok").alias("_any"),
    )
    error = F.when(F.col("_failure") == 0, F.lit("invalid JSON")).otherwise(
        F.concat(F.lit("HTTP "), F.col("_failure").cast("string"))
    )
    return chosen.select(
        key,
        *[F.when(F.col("_any"), F.col(f"_first_{c}")).alias(c) for c in values],
        F.when(~F.col("_any"), error).alias("power_error"),
    )


def enrich_climatology(
    points: DataFrame, features: DataFrame, key: str = "cell_id", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Points with the features of their key.

    ``power_error`` is ``NaN lat/lon`` for points without coordinates and
    ``no response`` for points whose key has no row. A feature column that
    ``points`` has too raises.
    The features are stored first, so that a small table is broadcast and
    points sharing a key can be split over tasks.
    """
    shared = [c for c in features.columns if c != key and c in points.columns]
    if shared:
        raise ValueError(f"both tables have {shared}")
    values = [c for c in features.columns if c not in (key, "power_error")]
    marked = features.withColumn("_answered", F.lit(True))
    joined = points.join(materialize(marked, "climate"), key, "left")
    no_place = F.col(lat).isNull() | F.col(lon).isNull() | F.isnan(lat) | F.isnan(lon)
    return joined.select(
        *points.columns,
        *[F.when(~no_place, F.col(c)).alias(c) for c in values],
        F.when(no_place, F.lit("NaN lat/lon"))
        .when(F.col("_answered").isNull(), F.lit("no response"))
        .otherwise(F.col("power_error"))
        .alias("power_error"),
    )
