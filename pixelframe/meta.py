"""What a wide pixel table doesn't say by itself: which columns are dimensions and which are bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

DIMENSIONS = ("x", "y", "t")


def dims(df: DataFrame) -> list[str]:
    return [c for c in DIMENSIONS if c in df.columns]


def bands(df: DataFrame) -> list[str]:
    """Band labels in column order; a column named like a dimension never is one."""
    return [c for c in df.columns if c not in DIMENSIONS]


def require(df: DataFrame, columns: Sequence[str]) -> None:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(lost)}")


def one_of(name: str, value: str, allowed: Sequence[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value
