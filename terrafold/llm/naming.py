"""Keep a caller's columns apart from the columns an operator adds."""

from __future__ import annotations

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns called like one of ``names``; returns the way back."""
    taken, back = {c.lower() for c in df.columns}, {}
    wanted = {n.lower() for n in names}
    for column in df.columns:
        if column.lower() in wanted:
            other = f"own_{column}"
            while other.lower() in taken:
                other = f"own_{other}"
            taken.add(other.lower())
            back[other] = column
    return df.withColumnsRenamed({v: k for k, v in back.items()}), back
