"""Runs a streaming query over files to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    import tempfile

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="kinetrace-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """A table's files as a stream, whether it is a single file or a folder of them."""
    # A pattern that fits this one name: a plain path has to be a folder here, and a filter by name would drop the files in a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def run(stream: DataFrame, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that the stream gives until its source is used up, through a sink of files; in mode complete the last result."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out")  # stays if there is no file at all, so no batch
    writer = stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{at}/out")
    return then(out) if then else out
