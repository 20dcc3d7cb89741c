"""Readers and writers of sensor data: episodes, record files, packed point clouds, synthetic sensors, metric exports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import normal

STEP_SCHEMA = "episode_id string, step_idx int, observation map<string,array<double>>, action array<double>, reward double, is_terminal boolean, language_instruction string, metadata map<string,string>, timestamp_ms double"
EPISODE_SCHEMA = "episode_id string, dataset_name string, success boolean, language_instruction string, scene_description string"


def read_steps(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Steps from Parquet or JSON lines. A line that can't be read is kept in ``_corrupt_record``, for quarantine."""
    if form == "parquet":
        return spark.read.schema(STEP_SCHEMA).parquet(path)
    if form == "json":
        return spark.read.schema(STEP_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    raise ValueError(f"read_steps: expected parquet or json, got {form!r}")


def read_episodes(spark: SparkSession, path: str, form: str = "parquet", most: int | None = None) -> DataFrame:
    """Episodes with their defaults; ``most``: only so many, in order of their ids."""
    raw = spark.read.schema(EPISODE_SCHEMA).format(form).load(path)
    out = raw.withColumns({"success": F.coalesce("success", F.lit(False)), "language_instruction": F.coalesce("language_instruction", F.lit(""))})
    return out.orderBy("episode_id").limit(most) if most else out


def records(data: bytes) -> Iterator[bytes]:
    """Payloads of a TFRecord file: length, its checksum, payload, its checksum (checksums aren't verified)."""
    at = 0
    while at + 12 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > len(data):
            raise ValueError(f"record at {at}: expected {n} bytes, got fewer")
        yield data[at + 12 : at + 12 + n]
        at += 16 + n


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        i += 1
        if b[i - 1] < 128:
            return out, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        else:
            raise ValueError(f"expected a known wire type, got {kind}")
        yield tag >> 3, value


def example(data: bytes) -> dict[str, list]:
    """Features of a serialised example: lists of bytes, fractions or whole numbers."""
    out: dict[str, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            values: list = []
            for number, packed in _fields(parts.get(2, b"")):
                for _, v in _fields(packed):
                    if number == 1:
                        values.append(v)
                    elif number == 2:
                        values += np.frombuffer(v, "<f4").astype(float).tolist()
                    elif isinstance(v, int):
                        values.append(v - (1 << 64) if v >> 63 else v)
                    else:
                        j = 0
                        while j < len(v):
                            x, j = _varint(v, j)
                            values.append(x - (1 << 64) if x >> 63 else x)
            out[parts[1].decode()] = values
    return out


def read_tfrecords(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, floats, ints, texts) of each example; a file that can't be read gives a row with ``error`` instead."""
    schema = "path string, record bigint, floats map<string,array<double>>, ints map<string,array<bigint>>, texts map<string,array<string>>, error string"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for k, r in enumerate(records(content)):
                        x = example(r)
                        of = lambda kind, x=x: {n: v for n, v in x.items() if v and isinstance(v[0], kind)}
                        rows.append((p, k, of(float), of(int), {n: [b.decode("utf-8", "replace") for b in v] for n, v in of(bytes).items()}, None))
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "record", "floats", "ints", "texts", "error"]).astype({"record": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def point_cloud2(clouds: DataFrame, id_col: str, data: str = "data", step: int = 12) -> DataFrame:
    """(id, point_id, x, y, z) from packed records of which the first three 32-bit fractions are coordinates."""
    if step < 12:
        raise ValueError(f"point_cloud2: expected step >= 12, got {step}")
    kind = clouds.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for cloud, raw in zip(pdf[id_col], pdf[data], strict=True):
                if raw is not None and len(raw) >= step:
                    n = len(raw) // step
                    xyz = np.frombuffer(raw, np.uint8, n * step).reshape(n, step)[:, :12].copy().view("<f4").astype(float)
                    yield pd.DataFrame({id_col: cloud, "point_id": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return clouds.select(id_col, data).mapInPandas(run, f"{id_col} {kind}, point_id bigint, x double, y double, z double")


def synthetic_stream(spark: SparkSession, series: int, n: int, hz: float, width: int, seed: int = 0, jitter: float = 0.0) -> DataFrame:
    """(series_id, t, values): a sensor of ``hz`` with optional jitter of times; values are smooth waves with a little noise."""
    rows = spark.range(series * n).select(F.expr(f"id div {n}").alias("series_id"), F.expr(f"id % {n}").alias("k"))
    t = F.col("k") / hz + normal("series_id", "k", F.lit(seed), F.lit("jitter")) * jitter
    value = lambda i: F.sin(F.col("t") * (i + 1)) + normal("series_id", "k", i, F.lit(seed)) * 0.01
    return rows.withColumn("t", t).select("series_id", "t", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value).alias("values"))


def prometheus(stats: DataFrame, operation: str = "operation", prefix: str = "kinetrace") -> DataFrame:
    """Lines of text for a metrics endpoint, one per operation and number."""
    numbers = [c for c, k in stats.dtypes if k in ("double", "bigint", "int", "float") and c != operation]
    name: Column = F.regexp_replace(F.col(operation).cast("string"), r"[^A-Za-z0-9_]", "_")
    lines = [F.concat(F.lit(f"{prefix}_{c}{{operation=\""), name, F.lit("\"} "), F.col(c).cast("string")) for c in numbers]
    return stats.select(F.explode(F.array(*lines)).alias("value")).where("value is not null")
