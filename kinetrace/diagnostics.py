"""Environment, configuration, timers and health."""

from __future__ import annotations

import json
import logging
import os
import sys
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("kinetrace")


@dataclass
class Config:
    """Settings, from KINETRACE_* variables or a JSON file."""

    strategy: str = "window"
    tolerance: float = 1e-5
    voxel_size: float = 0.1
    grid_size: int = 128

    @classmethod
    def from_env(cls) -> Config:
        out = cls()
        for f in fields(cls):
            if (v := os.environ.get(f"KINETRACE_{f.name.upper()}")) is not None:
                setattr(out, f.name, type(getattr(out, f.name))(v))
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)


def check_environment(spark: SparkSession | None = None) -> dict[str, str]:
    """Versions that this package runs on."""
    import numpy
    import pandas
    import pyarrow
    import pyspark

    out = {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "pandas": pandas.__version__, "numpy": numpy.__version__}
    return out | ({"spark": spark.version, "master": spark.sparkContext.master} if spark else {})


class Metrics:
    """Counters, gauges and durations of this process."""

    def __init__(self) -> None:
        self.lock, self.counters, self.gauges, self.times = threading.RLock(), {}, {}, []

    def count(self, name: str, by: int = 1) -> None:
        with self.lock:
            self.counters[name] = self.counters.get(name, 0) + by

    def gauge(self, name: str, value: float) -> None:
        with self.lock:
            self.gauges[name] = value

    @contextmanager
    def timed(self, operation: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            took = (time.perf_counter() - began) * 1000
            with self.lock:
                self.times.append((operation, took))
            log.info("%s took %.1f ms", operation, took)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Durations as rows for operators.metrics."""
        with self.lock:
            return spark.createDataFrame(list(self.times), "operation string, duration_ms double")


def health_check(spark: SparkSession, slow_ms: float = 5000) -> dict[str, str | float]:
    """healthy, degraded (a trivial job is slow) or critical (it fails)."""
    began = time.perf_counter()
    try:
        ok = spark.range(100).count() == 100
    except Exception as e:  # whatever is wrong with the session
        return {"status": "critical", "error": str(e)[:200]}
    took = (time.perf_counter() - began) * 1000
    return {"status": "healthy" if ok and took < slow_ms else "degraded", "ms": took}


def self_test(spark: SparkSession) -> dict[str, bool]:
    """A few known results, for a new installation."""
    from .operators import align, voxel

    source = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.5, 2.0), (1, 1.0, 3.0)], "series_id int, t double, value double")
    targets = spark.createDataFrame([(1, 0.25), (1, 0.75)], "series_id int, t double")
    got = [r["value"] for r in align.resample(source, targets, ["series_id"]).orderBy("t").collect()]
    points = spark.createDataFrame([(0.0, 0.0, 0.0), (0.01, 0.01, 0.01), (99.0, 0.0, 0.0)], "x double, y double, z double")
    cells = [tuple(r) for r in voxel.voxelize(points, "count", voxel_size=0.5, grid_size=64).collect()]
    try:
        align.resample(source, targets, ["series_id"], strategy="invalid")
        refused = False
    except ValueError:
        refused = True
    return {"resample": got == [1.5, 2.5], "voxelize": cells == [(20, 20, 20, 2)], "errors": refused}
