"""Replays of tables that are single files, folders of files, or empty."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from kinetrace.plans import queries as own
from kinetrace.streaming import replay


def copied(spark, tmp_path, n):
    """A table t of n rows as a folder of four files, next to another table."""
    spark.range(0, n, 1, 4).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(7).write.parquet(f"{tmp_path}/at.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_folder_of_files(spark, tmp_path, mode):
    d = copied(spark, tmp_path, 100)
    stream = replay.source(spark, d, "t", spark.range(1).schema)
    out = replay.run(stream.groupBy((F.col("id") % 3).alias("k")).count(), mode) if mode == "complete" else replay.run(stream)
    assert sorted(map(tuple, out.collect())) == ([(0, 34), (1, 33), (2, 33)] if mode == "complete" else [(i,) for i in range(100)])


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_folder_without_files(spark, tmp_path, mode):
    os.makedirs(f"{tmp_path}/t.parquet")
    stream = replay.source(spark, str(tmp_path), "t", spark.range(1).schema)
    assert replay.run(stream if mode == "append" else stream.groupBy("id").count(), mode).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_tsdf_over_a_folder_of_files(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = own.queries()["streaming_tsdf"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(own.oracle_sql()["streaming_tsdf"])
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
