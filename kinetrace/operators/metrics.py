"""Accuracy, latency and acceptance measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import need, need_numeric

ABSOLUTE, RELATIVE = 1e-5, 1e-4


def _pairs(got: DataFrame, want: DataFrame, keys: list[str], value: str) -> DataFrame:
    need_numeric(got, [value], "got")
    need_numeric(want, [value], "want")
    return got.select(*keys, F.col(value).cast("double").alias("a")).join(want.select(*keys, F.col(value).cast("double").alias("b")), keys)


def _off(a: Column, b: Column, absolute: float, relative: float) -> Column:
    gap = F.abs(a - b)
    return (gap > absolute) & (gap > relative * F.abs(b))


def accuracy(got: DataFrame, want: DataFrame, keys: list[str], value: str = "value", absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """One row: n, largest, mean and root mean square error, mismatches and their rate."""
    gap, off = F.abs(F.col("a") - F.col("b")), _off(F.col("a"), F.col("b"), absolute, relative)
    n = F.count(F.lit(1))
    return _pairs(got, want, keys, value).agg(n.alias("n"), F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error"), F.sqrt(F.avg(gap * gap)).alias("rms_error"), F.count_if(off).alias("mismatches"), F.try_divide(F.count_if(off), n).alias("mismatch_rate"))


def tolerance_compare(got: DataFrame, want: DataFrame, keys: list[str], value: str = "value", absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """Pairs that differ by more than both tolerances."""
    return _pairs(got, want, keys, value).where(_off(F.col("a"), F.col("b"), absolute, relative)).select(*keys, F.col("a").alias("got"), F.col("b").alias("want"))


def latency_stats(events: DataFrame, operation: str = "operation", duration: str = "duration_ms") -> DataFrame:
    need(events, [operation, duration], "latency_stats")
    return events.groupBy(operation).agg(F.count(duration).alias("n"), F.min(duration).alias("min"), F.max(duration).alias("max"), F.avg(duration).alias("mean"), F.sum(duration).alias("total"))




def latency_percentiles(events: DataFrame, operation: str = "operation", duration: str = "duration_ms", shares: dict[str, float] | None = None) -> DataFrame:
    """Samples at place int(share * n) of each operation's sorted ones, with mean, deviation, variation in per cent and the half width of a 95 % interval.

    Equal durations are counted first and counts summed up in order, so the window holds distinct values, not samples.
    """
    shares = shares or {"p50": 0.5, "p99": 0.99}
    from pyspark.sql import Window

    times = events.where(F.col(duration).isNotNull()).groupBy(operation, F.col(duration).alias("d")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(operation).orderBy("d"))
    n = F.sum("k").over(Window.partitionBy(operation))
    ranked = times.select(operation, "d", upto.alias("upto"), n.alias("all"))
    picks = ranked.groupBy(operation).agg(*[F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(s) * F.col("all")), F.col("all") - 1), F.col("d"))).alias(name) for name, s in shares.items()])
    std = F.stddev_samp(duration)
    moments = events.groupBy(operation).agg(F.count(duration).alias("n"), F.avg(duration).alias("mean"), std.alias("std"), (F.try_divide(std, F.avg(duration)) * 100).alias("cv_percent"), (F.lit(1.96) * std / F.sqrt(F.count(duration))).alias("ci95"))
    return picks.join(moments, operation)


def perf_gate(found: DataFrame, baseline: DataFrame, operation: str = "operation", p50: float = 1.05, p99: float = 1.10) -> DataFrame:
    """Each operation's percentiles against a baseline's: at most 5 and 10 per cent above, and below absolute caps (cap_p50, cap_p99), where given."""
    base = baseline.select(operation, F.col("p50").alias("base_p50"), F.col("p99").alias("base_p99"), *[(F.col(c) if c in baseline.columns else F.lit(None).cast("double")).alias(c) for c in ("cap_p50", "cap_p99")])
    near = (F.col("p50") <= F.col("base_p50") * p50) & (F.col("p99") <= F.col("base_p99") * p99)
    under = F.coalesce(F.col("p50") <= F.col("cap_p50"), F.lit(True)) & F.coalesce(F.col("p99") <= F.col("cap_p99"), F.lit(True))
    return found.select(operation, "p50", "p99").join(base, operation).withColumn("passed", near & under)


def spl(runs: DataFrame, success: str = "success", shortest: str = "shortest", path: str = "path") -> DataFrame:
    """One row: runs, rate of success, and success weighted by path length."""
    ok = F.col(success).cast("double")
    longest = F.greatest(F.col(path), F.col(shortest))
    return runs.agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("success_rate"), F.avg(F.coalesce(F.try_divide(ok * F.col(shortest), longest), F.lit(0.0))).alias("spl"))


def ab_compare(a: DataFrame, b: DataFrame, keys: list[str], value: str, hourly_cost: float = 0.0) -> DataFrame:
    """b against a: speed-up, and hours' cost saved."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    return both.withColumns({"speedup": F.try_divide("a", "b"), "cost_saved": (F.col("a") - F.col("b")) / 3.6e6 * hourly_cost})


def acceptance(measured: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """A predicate column per limit: column: ("max" or "min", bound); and whether all hold. A missing measure fails."""
    checks = {}
    for c, (kind, bound) in limits.items():
        if kind not in ("max", "min"):
            raise ValueError(f"acceptance: expected max or min, got {kind!r}")
        checks[f"ok_{c}"] = F.coalesce(F.col(c) <= bound if kind == "max" else F.col(c) >= bound, F.lit(False))
    out = measured.withColumns(checks)
    passed = F.lit(True)
    for c in checks:
        passed = passed & F.col(c)
    return out.withColumn("accepted", passed)


def slowest_rank(times: DataFrame, iteration: str = "iteration", duration: str = "duration_ms") -> DataFrame:
    """Each iteration's slowest rank, for percentiles over iterations."""
    return times.groupBy(iteration).agg(F.max(duration).alias(duration))
