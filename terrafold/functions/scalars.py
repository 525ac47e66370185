"""Row-level expressions. All of them are built-in Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature-name prefixes, tested in this order (case-sensitive).
PREFIX_RULES = [
    ("Climate variables",
     ["PRECTOTCORR", "T2M", "T2M_MIN", "T2M_MAX", "RH2M", "ALLSKY_SFC_SW_DWN", "WS2M", "T2MDEW"]),
    ("Soil variables",
     ["sg_", "clay", "sand", "silt", "soc", "phh2o", "bdod", "cfvo"]),
]

# Feature-name fragments, tested in this order (lower-cased).
# "oc" also matches every October climate column; kept for equal results.
KEYWORD_RULES = [
    ("soil",
     ["soil", "sg_", "clay", "sand", "silt", "soc", "ocd", "oc", "bdod", "cfvo", "cec",
      "nitrogen", "phh2o", "wv", "texture"]),
    ("climate",
     ["t2m", "t2m_max", "t2m_min", "t2mdew", "rh2m", "prectotcorr", "prectot", "ws2m",
      "allsky", "clrsky", "temp", "temperature", "prec", "precip", "rain", "rad", "radiation",
      "solar", "wind", "humidity", "vpd", "evap", "pet", "dew", "frost"]),
]

# The same rules without the fragment that swallows October climate columns.
CORRECTED_KEYWORD_RULES = [
    (group, [w for w in words if w != "oc"]) for group, words in KEYWORD_RULES
]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def encode_category(c: str | Column, word: str = "wheat") -> Column:
    """1 where the lower-cased value contains ``word``, else 0; NULL gives 0."""
    return F.coalesce(F.lower(_col(c)).contains(word).cast("int"), F.lit(0))


def clip_target(c: str | Column, low: float = 0, high: float = 10000) -> Column:
    """Limit to [low, high]; NULL stays NULL although least/greatest skip NULLs."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def spatial_block(degrees: float, lat: str | Column = "lat", lon: str | Column = "lon") -> Column:
    """Identifier ``latbin_lonbin`` of the square block holding a point; NULL unless both are finite."""
    lat, lon = _col(lat).cast("double"), _col(lon).cast("double")
    lat_bin = F.floor((lat + F.lit(90.0)) / F.lit(float(degrees)))
    lon_bin = F.floor((lon + F.lit(180.0)) / F.lit(float(degrees)))
    placed = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    return F.when(placed, F.concat(lat_bin.cast("string"), F.lit("_"), lon_bin.cast("string")))


def block_label(degrees: float) -> str:
    """File-name-safe block size: 0.5 becomes ``0p5``."""
    return str(float(degrees)).replace(".", "p")


def cell_identifier(category: str | Column, row: str | Column, col: str | Column) -> Column:
    """Identifier ``category_row_col`` of a grid cell."""
    return F.concat_ws("_", _col(category), _col(row).cast("string"), _col(col).cast("string"))


def with_residuals(
    df: DataFrame, observed: str = "observed", predicted: str = "predicted"
) -> DataFrame:
    """Append residual (observed minus predicted), its absolute value and its square."""
    residual = F.col(observed) - F.col(predicted)
    return df.withColumns(
        {
            "residual": residual,
            "abs_error": F.abs(residual),
            "squared_error": residual * residual,
        }
    )


def guarded_share(part: Column, total: Column, scale: float = 1.0) -> Column:
    """``scale * part / total``, or 0 when the total is not positive."""
    return F.when(total > 0, F.lit(scale) * part / total).otherwise(F.lit(0.0))


def interval_label(low: Column, high: Column, first: Column) -> Column:
    """``(low, high]`` with three decimals; the first interval is closed on the left."""
    opening = F.when(first, F.lit("[")).otherwise(F.lit("("))
    return F.concat(opening, F.format_string("%.3f, %.3f]", low, high))


def count_label(category: str | Column, n: Column) -> Column:
    """Axis label such as ``Wheat (n = 1,234)``."""
    text = _col(category)
    capital = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    return F.concat(capital, F.lit(" (n = "), F.format_number(n, 0), F.lit(")"))


def _first_matching_group(rules: Sequence[tuple[str, Sequence[str]]], test, indicator, other) -> Column:
    expr = F.when(indicator[0], F.lit(indicator[1]))
    for group, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | test(word)
        expr = expr.when(hit, F.lit(group))
    return expr.otherwise(F.lit(other))


def feature_group_prefix(
    feature: str | Column,
    rules: Sequence[tuple[str, Sequence[str]]] = PREFIX_RULES,
    indicator: str = "is_wheat",
) -> Column:
    """Group of a feature by name prefix, rules tried in order."""
    f = _col(feature)
    return _first_matching_group(
        rules, f.startswith, (f == indicator, "Crop indicator"), "Other variables"
    )


def feature_group_keyword(
    feature: str | Column,
    rules: Sequence[tuple[str, Sequence[str]]] = KEYWORD_RULES,
    indicator: str = "is_wheat",
) -> Column:
    """Group of a feature by name fragment, rules tried in order, ignoring case."""
    f = F.lower(_col(feature))
    return _first_matching_group(rules, f.contains, (f == indicator, "crop_indicator"), "other")
