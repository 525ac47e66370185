"""Choosing columns by name. Everything here looks at the schema only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Accepted column names per role, in order of preference.
COLUMN_ROLES = {
    "lat": ["lat", "latitude", "y"],
    "lon": ["lon", "longitude", "lng", "x"],
    "target": ["suitability", "gaez_suitability", "suitability_index", "target", "y"],
    "crop": ["crop", "crop_name", "crop_type"],
}

# Accepted names in a foreign predictions table.
PREDICTION_ROLES = {
    "fold": ["fold", "cv_fold", "Fold"],
    "observed": ["observed", "y_true", "true", "actual", "suitability"],
    "predicted": ["predicted", "y_pred", "prediction", "pred"],
}

# Name fragments that mark a soil column.
SOIL_KEYWORDS = ["clay", "sand", "silt", "soc", "phh2o", "bdod", "cfvo"]


def resolve_columns(
    df: DataFrame,
    roles: Mapping[str, Sequence[str]] | None = None,
    substring_roles: Iterable[str] = ("crop",),
) -> dict[str, str]:
    """Map each role to the first candidate present, ignoring case.

    Roles in ``substring_roles`` fall back to the first column whose name
    contains the role name. A role without any match raises ``ValueError``.
    """
    roles = COLUMN_ROLES if roles is None else roles
    by_lower = {name.lower(): name for name in df.columns}
    found: dict[str, str] = {}
    for role, candidates in roles.items():
        match = next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)
        if match is None and role in substring_roles:
            match = next((name for name in df.columns if role in name.lower()), None)
        if match is None:
            raise ValueError(f"no column for role {role!r}; tried {list(candidates)} in {df.columns}")
        found[role] = match
    return found


def select_by_keyword(df: DataFrame, keywords: Sequence[str] = SOIL_KEYWORDS) -> list[str]:
    """Columns whose lower-cased name contains any keyword, in table order."""
    return [name for name in df.columns if any(k.lower() in name.lower() for k in keywords)]


def select_by_affix(
    df: DataFrame, prefix: str = "", suffix: str = "", ignore_case: bool = False
) -> list[str]:
    """Columns that start with ``prefix`` and end with ``suffix``."""
    fold = str.lower if ignore_case else str
    return [
        name
        for name in df.columns
        if fold(name).startswith(fold(prefix)) and fold(name).endswith(fold(suffix))
    ]


def require_columns(df: DataFrame, columns: Iterable[str], table: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or raise with the list of missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} is missing columns: {missing}")
    return df


def dropped_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Which of ``columns`` are present and would be dropped."""
    return [c for c in columns if c in df.columns]


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the given columns where present; see :func:`dropped_columns`."""
    return df.drop(*dropped_columns(df, columns))


def keep_numeric(df: DataFrame, keep: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop non-numeric columns except ``keep``; also return what was dropped."""
    keep = set(keep)
    gone = [
        f.name
        for f in df.schema.fields
        if f.name not in keep and not isinstance(f.dataType, T.NumericType)
    ]
    return df.drop(*gone), gone
