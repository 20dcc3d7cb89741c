"""Streaming forms: event-time watermarks, bounded buffers per key, and ticks.

Late rows are dropped by the watermark. Interpolating output for a tick waits for a sample at or after it (or is held at the last
one once the watermark has passed); hold-last output doesn't wait.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.voxel import VOXEL, binned
from ..schema import need

#: Samples that a sensor's buffer keeps, by stream; and those without an entry.
CAPACITY = {"vision": 150, "imu": 500, "proprio": 500}
DEFAULT_CAPACITY = 200


def hold_last(samples: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """The newest values of each key; use with output mode complete or update."""
    need(samples, [*keys, time, *values], "hold_last")
    return samples.groupBy(*keys).agg(F.max(time).alias(time), *[F.max_by(v, time).alias(v) for v in values])


def latest_per_window(samples: DataFrame, keys: list[str], time: str, values: list[str], width: str, late: str) -> DataFrame:
    """The newest values of each key in each window, once the watermark has passed it."""
    window = F.window(time, width)
    out = samples.withWatermark(time, late).groupBy(window, *keys).agg(*[F.max_by(v, time).alias(v) for v in values])
    return out.select(F.col("window.start").alias("start"), *keys, *values)


def voxelize(points: DataFrame, cloud: str, time: str, late: str, width: str, **grid) -> DataFrame:
    """Counts per cloud and voxel in windows of event time."""
    cells = binned(points.withWatermark(time, late), **grid)
    out = cells.groupBy(F.window(time, width), cloud, *VOXEL).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), cloud, *VOXEL, "n")


def _at(buffer: list[tuple[int, float]], t: int, first: int = 0) -> float | None:
    """The line between the samples around t, from the place ``first`` on; beyond the ends the nearest sample."""
    if len(buffer) <= first:
        return None
    i = bisect_left(buffer, (t,), first)
    if i == len(buffer):
        return buffer[-1][1]
    if i == first or buffer[i][0] == t:
        return buffer[i][1]
    (a, x), (b, y) = buffer[i - 1], buffer[i]
    return x + (t - a) / (b - a) * (y - x)


def _fuser(streams: tuple[str, ...], step: int, least: dict[str, int], capacity: dict[str, int], key: str, hold: bool) -> Callable[..., Iterator[pd.DataFrame]]:
    most = {s: capacity.get(s, DEFAULT_CAPACITY) for s in streams}

    def run(name: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffers, tick = pickle.loads(state.get[0]) if state.exists else ({s: [] for s in streams}, None)
        first, out, come = dict.fromkeys(streams, 0), [], set()  # samples before ``first`` have left a buffer

        def emit(end: int) -> None:
            nonlocal tick
            while tick <= end:
                if all(len(buffers[s]) - first[s] >= n for s, n in least.items()):
                    out.append((name[0], tick, *(_at(buffers[s], tick, first[s]) for s in streams)))
                tick += step

        for pdf in rows:
            come.update((int(t), s, float(v)) for s, t, v in zip(pdf["stream"], pdf["t"], pdf["value"], strict=True) if s in buffers and v == v)
        # In the order of time, so that samples leave a full buffer only after the ticks that were due before.
        for t, same in groupby(sorted(come), key=lambda x: x[0]):
            new = [(s, (t, v)) for _, s, v in same]
            for s, x in new:
                at = bisect_left(buffers[s], x, first[s])
                if at == len(buffers[s]) or buffers[s][at] != x:
                    insort(buffers[s], x, first[s])
            newest = [b[-1][0] for b in buffers.values() if b]
            tick = -(-t // step) * step if tick is None else tick
            if hold or len(newest) == len(streams):
                emit(max(newest) if hold else min(newest))
            for s, _ in new:
                first[s] = max(first[s], len(buffers[s]) - most[s])
                if first[s] > most[s]:
                    del buffers[s][: first[s]]
                    first[s] = 0
        newest = {s: b[-1][0] for s, b in buffers.items() if b}
        if state.hasTimedOut and newest:
            emit(max(newest.values()))
        buffers = {s: b[first[s] :] for s, b in buffers.items()}
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((pickle.dumps((buffers, tick)),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max(newest.values()) // 1000 if newest else 0) + 1))
        yield pd.DataFrame(out, columns=[key, "t", *streams])

    return run


def fuse(samples: DataFrame, key: str, time: str, streams: tuple[str, ...], step: int, late: str, least: dict[str, int] | None = None, capacity: dict[str, int] | None = None, hold: bool = False) -> DataFrame:
    """(key, t, one column per stream) at whole multiples of ``step`` microseconds, from rows (key, time, stream, value).

    A tick comes out once every stream has a sample at or after it; with ``hold`` as soon as any has, the others at their last.
    ``least``: samples that streams must have buffered. When a key falls silent, what its buffers still allow comes out.
    """
    need(samples, [key, time, "stream", "value"], "fuse")
    kind = samples.schema[key].dataType.simpleString()
    rows = samples.withWatermark(time, late).select(key, time, "stream", "value", F.unix_micros(F.col(time)).alias("t"))
    schema = f"{key} {kind}, t bigint, " + ", ".join(f"{s} double" for s in streams)
    run = _fuser(tuple(streams), step, least or {}, {**CAPACITY, **(capacity or {})}, key, hold)
    return rows.groupBy(key).applyInPandasWithState(run, schema, "buffers binary", "append", GroupStateTimeout.EventTimeTimeout)


def observe_late(samples: DataFrame, ticks: DataFrame, key: str, latency: str, within: str, late: str) -> DataFrame:
    """Each tick with the samples that are at least ``latency`` and at most ``latency`` plus ``within`` old, by a stream-stream interval join.

    Columns: key, tick_ts, sample_ts, value. The newest is what an observer sees; take it by max_by over the result.
    """
    s = samples.select(F.col(key).alias("_key"), F.col("ts").alias("sample_ts"), "value").withWatermark("sample_ts", late)
    t = ticks.select(key, F.col("ts").alias("tick_ts")).withWatermark("tick_ts", late)
    seen = F.expr(f"{key} = _key and sample_ts <= tick_ts - interval {latency} and sample_ts >= tick_ts - interval {latency} - interval {within}")
    return t.join(s, seen).select(key, "tick_ts", "sample_ts", "value")
