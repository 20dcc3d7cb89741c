"""Target times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import linspace


def grid_linspace(series: DataFrame, start: float, stop: float, n: int, time: str = "t") -> DataFrame:
    """Each row of ``series`` at n evenly spaced times, both ends included."""
    return series.withColumn(time, F.explode(linspace(start, stop, n)))


def grid_rate(series: DataFrame, start: float, n: int, hz: float, time: str = "t") -> DataFrame:
    """Each row of ``series`` at n times, 1 / hz apart, from ``start``."""
    if hz <= 0:
        raise ValueError(f"grid_rate: expected hz > 0, got {hz}")
    return series.withColumn(time, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i / F.lit(float(hz)))))


def grid_steps(series: DataFrame, start: int, step: int, n: int, time: str = "t") -> DataFrame:
    """Each row of ``series`` at n whole times (as microseconds), ``step`` apart."""
    return series.withColumn(time, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start).cast("bigint") + i * F.lit(step).cast("bigint"))))
