"""Checks of inputs when a plan is built, and times as whole microseconds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def need(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: expected columns {missing}, got {df.columns}")


def need_numeric(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Numbers, or arrays of numbers."""
    need(df, columns, what)
    for c in columns:
        kind = df.schema[c].dataType
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.NumericType):
            raise ValueError(f"{what}: expected numbers in {c}, got {kind.simpleString()}")


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what}: expected one of {allowed}, got {value!r}")
    return value


def is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch from timestamps (those without a zone count as UTC) and dates; whole numbers as they are; seconds from fractions."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("bigint")
    if isinstance(kind, T.NumericType):
        return F.round(F.col(column) * 1_000_000).cast("bigint")
    raise ValueError(f"expected a time in {column}, got {kind.simpleString()}")
