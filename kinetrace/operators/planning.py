"""Sizes of chunks and splits."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_plan(items: int, bytes_per_item: int, budget: int, safety: float = 0.8) -> dict[str, int]:
    """Items per chunk under a share of a memory budget, number of chunks, and items in the last."""
    if items < 0 or bytes_per_item <= 0:
        raise ValueError(f"chunk_plan: expected items >= 0 and bytes_per_item > 0, got {items} and {bytes_per_item}")
    each = max(1, min(items, int(budget * safety) // bytes_per_item)) if items else 0
    chunks = ceil(items / each) if each else 0
    return {"per_chunk": each, "chunks": chunks, "last": items - each * (chunks - 1) if chunks else 0}


def voxel_memory(points: int, grid: tuple[int, int, int], features: int = 0, overhead: float = 1.2) -> int:
    """Bytes that a dense grid and its points would take."""
    return int((points * (3 + features) * 4 + grid[0] * grid[1] * grid[2] * max(1, features) * 4) * overhead)


def would_not_fit(required: int, free: int, share: float = 0.8) -> bool:
    return required > share * free


def split_batch(rows: DataFrame, index: str, n: int, parts: int) -> DataFrame:
    """``rows`` with part: contiguous runs of ceil(n / parts)."""
    size = max(1, ceil(n / parts))
    return rows.withColumn("part", F.expr(f"cast({index} div {size} as int)"))


def rank_slices(rows: DataFrame, index: str, n: int, ranks: int) -> DataFrame:
    """``rows`` with rank: slices from rank * n div ranks to (rank + 1) * n div ranks."""
    return rows.withColumn("rank", F.expr(f"cast((({index} + 1) * {ranks} - 1) div {max(1, n)} as int)"))


def gather(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_grids(parts: list[DataFrame], keys: list[str], value: str = "occupied") -> DataFrame:
    """Workers' grids as one: the largest value of each voxel."""
    return gather(parts).groupBy(*keys).agg(F.max(value).alias(value))
