"""Alignment of irregular series: two-sided as-of joins with interpolation, without a join.

Samples and targets are united, and two windows per series find, for every target and stream at once, the last sample before it
and the first at or after it. So N streams cost one shuffle by series and two sorts. The value is the right sample where the
left one is missing, the left where the right one is, else the line between them. Nulls among values are no samples. A series is
one window partition; with ``bucket`` (a span of time) each span of a series is, which gets the samples next to it from outside. So
a series that holds a third of all rows is spread over as many tasks as it has spans.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import lerp
from ..schema import is_array, need, need_numeric, one_of

UP = (Window.unboundedPreceding, 0)


def _carried(samples: DataFrame, targets: DataFrame, keys: list[str], time: str, name: str) -> DataFrame:
    """``samples`` and, for each bucket with targets, the last sample of buckets before it and the first of those after it.

    Buckets are summed up first, so the windows over a whole series see a row per bucket, not its samples.
    """
    sample, order = F.struct(F.col(time).alias("t"), F.col(f"s_{name}").alias("s"), "_tie"), F.struct(time, "_tie")
    ends = samples.groupBy(*keys, "_bucket").agg(F.min_by(sample, order).alias("first"), F.max_by(sample, order).alias("last")).withColumn("_spot", F.lit(False))
    spots = targets.select(*keys, "_bucket").distinct().withColumn("_spot", F.lit(True))
    both = ends.unionByName(spots, allowMissingColumns=True)
    up = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc(), F.col("_spot").desc()).rowsBetween(*UP)
    down = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc(), F.col("_spot").desc()).rowsBetween(*UP)
    near = both.select(*keys, "_bucket", "_spot", F.last("last", ignorenulls=True).over(up).alias("before"), F.last("first", ignorenulls=True).over(down).alias("after"))
    rows = near.where("_spot").select(*keys, "_bucket", F.explode(F.array("before", "after")).alias("x")).where("x is not null")
    return samples.unionByName(rows.select(*keys, F.col("x.t").alias(time), F.col("x.s").alias(f"s_{name}"), F.col("x._tie").alias("_tie"), F.lit(False).alias("_target"), "_bucket"))


def brackets(streams: dict[str, DataFrame], targets: DataFrame, keys: list[str], time: str = "t", value: str = "value", tie: str | None = None, extrapolate: str = "clamp", bucket: float | None = None) -> DataFrame:
    """``targets`` with structs l_<stream> and r_<stream> (t, v): the samples around each target, or null."""
    one_of(extrapolate, ("clamp", "linear"), "extrapolate")
    need(targets, [*keys, time], "targets")
    extra = [c for c in targets.columns if c not in (*keys, time)]
    frames = []
    for name, s in streams.items():
        need(s, [*keys, time, *([tie] if tie else [])], f"stream {name}")
        need_numeric(s, [value], f"stream {name}")
        s = s.where(F.col(value).isNotNull() & F.col(time).isNotNull())
        sample = [F.col(time).alias("t"), F.col(value).cast("array<double>" if is_array(s, value) else "double").alias("v")]
        if extrapolate == "linear":  # a sample carries its neighbours, for the lines beyond the ends
            w = Window.partitionBy(*keys).orderBy(time, *([tie] if tie else []))
            s = s.select(*keys, time, *([tie] if tie else []), F.struct(*sample).alias("own"))
            s = s.withColumns({"before": F.lag("own").over(w), "after": F.lead("own").over(w)})
            packed = F.struct(F.col("own.t").alias("t"), F.col("own.v").alias("v"), F.col("before"), F.col("after"))
        else:
            packed = F.struct(*sample)
        order = F.col(tie) if tie else F.lit(0)
        frames.append(s.select(*keys, F.col(time), packed.alias(f"s_{name}"), order.cast("bigint").alias("_tie"), F.lit(False).alias("_target")))
    frames.append(targets.select(*keys, time, F.struct(*extra).alias("_extra") if extra else F.lit(None).cast("int").alias("_extra"), F.lit(0).cast("bigint").alias("_tie"), F.lit(True).alias("_target")))
    parts = keys
    if bucket is not None:
        if bucket <= 0 or extrapolate != "clamp":
            raise ValueError(f"bucket: expected a positive span and extrapolate clamp, got {bucket} and {extrapolate!r}")
        frames = [f.withColumn("_bucket", F.floor(F.col(time) / F.lit(bucket)).cast("bigint")) for f in frames]
        frames = [*[_carried(f, frames[-1], keys, time, n) for n, f in zip(streams, frames[:-1], strict=True)], frames[-1]]
        parts = [*keys, "_bucket"]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    ahead = Window.partitionBy(*parts).orderBy(F.col(time).asc(), F.col("_target").desc(), F.col("_tie").asc()).rowsBetween(*UP)
    back = Window.partitionBy(*parts).orderBy(F.col(time).desc(), F.col("_target").asc(), F.col("_tie").desc()).rowsBetween(*UP)
    # All left sides in one select and all right sides in the next: one sort each.
    left = union.select("*", *[F.last(f"s_{n}", ignorenulls=True).over(ahead).alias(f"l_{n}") for n in streams])
    both = left.select("*", *[F.last(f"s_{n}", ignorenulls=True).over(back).alias(f"r_{n}") for n in streams])
    return both.where("_target").select(*keys, time, *([F.col(f"_extra.{c}").alias(c) for c in extra]), *[f"{side}_{n}" for n in streams for side in "lr"])


def _value(left: Column, right: Column, t: Column, array: bool, extrapolate: str) -> Column:
    def line(a: Column, b: Column) -> Column:
        weight = (t - a["t"]).cast("double") / (b["t"] - a["t"]).cast("double")
        return lerp(a["v"], b["v"], weight, array)

    between = F.when(right["t"] > left["t"], line(left, right)).otherwise(right["v"])
    first, last = right["v"], left["v"]
    if extrapolate == "linear":
        first = F.when((right["t"] > t) & right["after"].isNotNull() & (right["after"]["t"] > right["t"]), line(right, right["after"])).otherwise(right["v"])
        last = F.when(left["before"].isNotNull() & (left["t"] > left["before"]["t"]), line(left["before"], left)).otherwise(left["v"])
    return F.when(left.isNull(), first).when(right.isNull(), last).otherwise(between)


def fuse(streams: dict[str, DataFrame], targets: DataFrame, keys: list[str], time: str = "t", value: str = "value", tie: str | None = None, extrapolate: str = "clamp", concat: bool = False, bucket: float | None = None) -> DataFrame:
    """Each stream at each target, one column per stream in the order given; with ``concat`` as one array ``fused`` instead.

    Every target stays. A stream without samples in a series gives null there (and so does its concatenation).
    """
    if not streams:
        raise ValueError("fuse: expected one stream or more, got none")
    found = brackets(streams, targets, keys, time, value, tie, extrapolate, bucket)
    arrays = {n: is_array(s, value) for n, s in streams.items()}
    values = {n: _value(F.col(f"l_{n}"), F.col(f"r_{n}"), F.col(time), arrays[n], extrapolate) for n in streams}
    rest = [c for c in found.columns if c not in {f"{side}_{n}" for n in streams for side in "lr"}]
    if concat:
        return found.select(*rest, F.concat(*[v if arrays[n] else F.array(v) for n, v in values.items()]).alias("fused"))
    return found.select(*rest, *[v.alias(n) for n, v in values.items()])


def resample(source: DataFrame, targets: DataFrame, keys: list[str], time: str = "t", value: str = "value", tie: str | None = None, extrapolate: str = "clamp", strategy: str = "window", bucket: float | None = None) -> DataFrame:
    """One series at other times. Before the first and after the last sample the nearest holds, or with ``linear`` the last line goes on.

    ``strategy``: ``window`` (native), or ``arrow``, which brings a series and its targets to one NumPy call; the latter suits wide arrays,
    and a series must fit a worker's memory.
    """
    if one_of(strategy, ("window", "arrow"), "strategy") == "window":
        return fuse({value: source}, targets, keys, time, value, tie, extrapolate, bucket=bucket)
    one_of(extrapolate, ("clamp",), "extrapolate with strategy arrow")
    need(targets, [*keys, time], "targets")
    need(source, [*keys, time, *([tie] if tie else [])], "source")
    need_numeric(source, [value], "source")
    wide = is_array(source, value)
    out = targets.select(*targets.columns, F.lit(None).cast("array<double>" if wide else "double").alias(value))

    def run(s: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        g = g.copy()
        g[value] = None
        if len(g) and len(s):
            s = s.sort_values([time, *([tie] if tie else [])])
            t, tau = s[time].to_numpy(), g[time].to_numpy()
            x = np.stack([np.asarray(v, np.float64) for v in s[value]]) if wide else s[value].to_numpy(np.float64)[:, None]
            right = np.searchsorted(t, tau, side="left")
            left = np.clip(right - 1, 0, len(t) - 1)
            right = np.clip(right, 0, len(t) - 1)
            gap = (t[right] - t[left]).astype(np.float64)
            w = np.where(gap > 0, (tau - t[left]) / np.where(gap > 0, gap, 1), 1.0)
            got = x[left] + np.clip(w, 0, 1)[:, None] * (x[right] - x[left])
            g[value] = list(got) if wide else got[:, 0]
        return g

    own = source.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select(*keys, time, *([tie] if tie else []), F.col(value).cast(out.schema[value].dataType))
    return own.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(run, out.schema)


align_stream = resample


def fuse_primary(primary: DataFrame, secondary: DataFrame, keys: list[str], time: str = "t", value: str = "value", name: str = "secondary", tie: str | None = None) -> DataFrame:
    """The primary's own rows, untouched, with the secondary interpolated at their times."""
    return fuse({name: secondary}, primary, keys, time, value, tie)


def resample_by_index(source: DataFrame, keys: list[str], n: int, time: str = "t", value: str = "value") -> DataFrame:
    """Resizes each series to n samples by position, whatever their times: target k lies at k (S - 1) / (n - 1)."""
    need_numeric(source, [value], "resample_by_index")
    w = Window.partitionBy(*keys).orderBy(time)
    placed = source.select(*keys, F.col(value), (F.row_number().over(w) - 1).cast("double").alias("t"))
    sizes = placed.groupBy(*keys).agg(F.max("t").alias("_last"))
    grid = sizes.select(*keys, "_last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    targets = grid.select(*keys, "k", (F.col("k") * F.col("_last") / F.lit(max(1, n - 1))).alias("t"))
    return resample(placed, targets, keys, "t", value).select(*keys, "k", value)


def forward_fill(df: DataFrame, keys: list[str], time: str = "t", value: str = "value", valid: str = "valid", tie: str | None = None) -> DataFrame:
    """The last valid value at or before each row; null before the first."""
    need(df, [*keys, time, value, valid], "forward_fill")
    w = Window.partitionBy(*keys).orderBy(time, *([tie] if tie else [])).rowsBetween(*UP)
    return df.withColumn("filled", F.last(F.when(F.col(valid), F.col(value)), ignorenulls=True).over(w))


def nearest_asof(samples: DataFrame, targets: DataFrame, keys: list[str], time: str = "t", value: str = "value", tie: str | None = None) -> DataFrame:
    """The sample nearest in time to each target, with its time; of two at equal distance the earlier. Null if a series has none."""
    found = brackets({"s": samples}, targets, keys, time, value, tie)
    left, right = F.col("l_s"), F.col("r_s")
    pick = F.when(left.isNull(), right).when(right.isNull(), left).when(F.col(time) - left["t"] <= right["t"] - F.col(time), left).otherwise(right)
    return found.withColumn("_near", pick).drop("l_s", "r_s").select("*", F.col("_near.t").alias("sample_t"), F.col("_near.v").alias(value)).drop("_near")


def observed_with_latency(samples: DataFrame, ticks: DataFrame, keys: list[str], latency: int, jitter: int = 0, seed: int = 0, time: str = "t", value: str = "value") -> DataFrame:
    """What an observer sees at each tick through a delay: the sample nearest to tick - (latency + uniform(-jitter, jitter))."""
    from ..functions.arrays import uniform

    delay = F.lit(latency).cast("bigint")
    if jitter:
        delay = delay + F.round((uniform(*[F.col(k) for k in keys], F.col(time), seed) * 2 - 1) * jitter).cast("bigint")
    shifted = ticks.withColumn("tick", F.col(time)).withColumn(time, F.col(time) - delay)
    return nearest_asof(samples, shifted, keys, time, value)


def resample_gradient(source: DataFrame, grads: DataFrame, keys: list[str], time: str = "t", grad: str = "grad") -> DataFrame:
    """The gradient with respect to source samples, given that of the resampled values: each target's weights scattered back and summed."""
    marked = source.select(*keys, time, F.lit(0.0).alias("value"))
    found = brackets({"s": marked}, grads, keys, time, "value")
    left, right, t = F.col("l_s"), F.col("r_s"), F.col(time)
    w = F.when(left.isNull(), F.lit(1.0)).when(right.isNull(), F.lit(0.0)).otherwise((t - left["t"]).cast("double") / (right["t"] - left["t"]).cast("double"))
    shares = F.array(F.struct(left["t"].alias("t"), ((1 - F.col("w")) * F.col(grad)).alias("g")), F.struct(right["t"].alias("t"), (F.col("w") * F.col(grad)).alias("g")))
    parts = found.withColumn("w", w).select(*keys, F.explode(shares).alias("x")).where("x.t is not null")
    return parts.groupBy(*keys, F.col("x.t").alias(time)).agg(F.sum("x.g").alias("source_grad"))
