"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow batches as byte arrays, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 2 << 20
#: Rows that it handles at once at most, so that very short texts take no more memory than long ones.
SLICE_ROWS = 1 << 14
#: Edges for each task that writes labels of components.
LABELS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or for a single machine a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="kinetrace-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables of one operator call below :func:`shared_dir`. Writing a table cuts the lineage; its files outlive executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes a table, or all of them."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session may have ended before
            pass


class Folder(Scratch):
    """Tables at a path of the user's. They stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")


def unused(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def release() -> None:
    """Gives memory that is free back to the system; allocators keep it otherwise, also while a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and :func:`release` at the end of its task."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inside


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs.mapInArrow(run)`` with the same columns, whatever their names."""
    names, places = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*places)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=places)

    return plain.mapInArrow(released(inside), plain.schema).toDF(*names)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into slices of about ``most`` bytes in ``column`` and at most ``rows`` rows: the slice, its UTF-8 bytes, and n + 1 offsets. Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        col = (col.cast(pa.large_string()) if pa.types.is_string(col.type) else col.cast(pa.large_binary()) if pa.types.is_binary(col.type) else col).fill_null("" if not pa.types.is_large_binary(col.type) and not pa.types.is_binary(col.type) else b"")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            end = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of an array, each from one bound to the next, as a binary column."""
    data = np.ascontiguousarray(values)
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): (id, component), the smallest id that links reach, for ids with an edge.

    Each round takes the smallest label among neighbours and then follows labels once, so chains shrink geometrically. Labels
    and edges stay distributed and every round is written to the shared folder; only a count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.write(both, f"{name}-edges")
    # Labels are written by as many tasks as their number asks for, so that small graphs aren't dozens of tiny files each round.
    width = max(1, -(-both.count() // LABELS))
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")).coalesce(width), f"{name}-0")
    for k in count(1):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        low = scratch.write(low.coalesce(width), f"{name}-low")
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = scratch.write(low.join(jump, "low").select("id", F.col("next").alias("component"), (F.col("next") != F.col("was")).alias("changed")).coalesce(width), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("id", "component")
        if not new.where("changed").limit(1).count():
            return labels
