"""Episodes of steps as training samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import need
from .align import fuse


def chunks(steps: DataFrame, episode: str, step: str, length: int) -> DataFrame:
    """``steps`` with place, n_steps, chunk and step_in_chunk: chunks of ``length`` steps without overlap.

    What is left over at the end goes, but an episode shorter than ``length`` is one short chunk.
    """
    if length < 1:
        raise ValueError(f"length: expected 1 or more, got {length}")
    need(steps, [episode, step], "steps")
    w = Window.partitionBy(episode)
    placed = steps.withColumns({"place": F.row_number().over(w.orderBy(step)) - 1, "n_steps": F.count(F.lit(1)).over(w)})
    kept = placed.where((F.col("n_steps") < length) | (F.col("place") < F.expr(f"n_steps div {length}") * length))
    return kept.withColumns({"chunk": F.expr(f"cast(place div {length} as int)"), "step_in_chunk": F.col("place") % length})


def padded(chunked: DataFrame, episode: str, length: int) -> DataFrame:
    """Short chunks (as of :func:`chunks`) filled up by repeats of their last step; ``padded`` marks these."""
    # The last step of a short episode repeats itself; all others are there once.
    last = F.col("place") == F.col("n_steps") - 1
    short = F.col("n_steps") < length
    copies = F.when(last & short, F.sequence(F.col("step_in_chunk"), F.lit(length - 1))).otherwise(F.array("step_in_chunk"))
    out = chunked.withColumn("to", F.explode(copies))
    return out.withColumn("padded", F.col("to") != F.col("step_in_chunk")).withColumn("step_in_chunk", F.col("to").cast("int")).drop("to")


def stacked(chunked: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """A row per chunk, each column an array in step order. A chunk's length bounds the arrays."""
    rows = chunked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order), *columns))).alias("rows"))
    return rows.select(*keys, F.size("rows").alias("length"), *[F.col(f"rows.{c}").alias(c) for c in columns])


def shuffled_batches(samples: DataFrame, id_cols: list[str], size: int, train: bool = True, seed: int = 0) -> DataFrame:
    """``samples`` with batch and place. In training the order is that of a hash, else that of the ids.

    Rows fall into buckets by the order's own bits (in training) or by bounds taken once (else). Buckets are numbered by their own
    and then shifted by the sizes of those before, so no task sees all rows, and a row's bucket doesn't depend on how often or where it
    is computed.
    """
    spark, n = samples.sparkSession, samples.count()
    if train:
        bits = min(20, max(1, (n // BUCKET).bit_length()))
        keyed = samples.withColumn("_o", F.xxhash64(*id_cols, F.lit(seed)))
        keyed = keyed.withColumn("_bucket", F.shiftright("_o", 64 - bits).cast("int"))  # of a hash: about equal shares, in the hash's order
    else:
        keyed = samples.withColumns({"_o": F.struct(*id_cols), "_bucket": F.lit(0)})
        if bounds := _bounds(samples.select(*id_cols), id_cols, n):
            kind = keyed.schema["_o"].dataType
            known = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.fields, strict=True)]) for b in bounds])
            keyed = keyed.withColumn("_bucket", F.size(F.filter(known, lambda b: b <= F.col("_o"))))
    sizes = sorted((r["_bucket"], r["n"]) for r in keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per bucket
    before, rows = 0, []
    for k, size_of in sizes:
        rows.append((k, before))
        before += size_of
    shifts = spark.createDataFrame(rows, "_bucket int, _before bigint")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_o", *id_cols)) - 1
    out = keyed.join(F.broadcast(shifts), "_bucket").withColumn("_place", place)
    return out.withColumns({"batch": F.expr(f"_place div {size}"), "place": F.col("_place") % size}).drop("_o", "_bucket", "_before", "_place")


#: Rows of an order that one task numbers, about.
BUCKET = 200_000


def _bounds(ids: DataFrame, columns: list[str], n: int) -> list[tuple]:
    """Rising bounds that cut n ids into about equal parts, 1024 at most, from a sample of some 16 ids for each."""
    most = min(1024, n // BUCKET)
    if not most:
        return []
    some = ids.where(F.pmod(F.xxhash64(*columns), F.lit(max(1, n // (16 * most)))) == 0)
    rows = sorted({tuple(r) for r in some.collect() if None not in r})
    return rows[:: max(1, len(rows) // (most + 1))][1 : most + 1]


def ragged_pad(rows: DataFrame, batch: list[str], values: str) -> DataFrame:
    """``values`` filled up by zeros to the longest of their batch; ``length`` keeps the true one."""
    longest = F.max(F.size(values)).over(Window.partitionBy(*batch))
    kind = rows.schema[values].dataType.elementType.simpleString()
    out = rows.withColumns({"length": F.size(values), "_longest": longest})
    return out.withColumn(values, F.concat(values, F.array_repeat(F.lit(0).cast(kind), F.col("_longest") - F.col("length")))).drop("_longest")


def multirate(samples: DataFrame, targets: DataFrame, episode: str, time: str = "t", value: str = "value", stream: str = "stream", streams: tuple[str, str, str] = ("vision", "actions", "proprio")) -> DataFrame:
    """Three streams of an episode at the targets' times: vision, actions, proprio, fused (vision and proprio; vision alone without proprio)."""
    vision, actions, proprio = streams
    out = fuse({n: samples.where(F.col(stream) == n).select(episode, time, value) for n in streams}, targets, [episode], time, value)
    array = out.schema[vision].dataType.simpleString().startswith("array")
    wrap = (lambda c: F.col(c)) if array else (lambda c: F.array(c))
    return out.withColumn("fused", F.when(F.col(proprio).isNull(), wrap(vision)).otherwise(F.concat(wrap(vision), wrap(proprio))))


def parsed_steps(raw: DataFrame) -> DataFrame:
    """Steps with defaults: reward 0, not terminal, empty instruction; images (``rgb``) scaled to 1, ``state`` named proprio; depth as it is."""
    have = set(raw.columns)
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c) if c in have else F.lit(default).alias(c)
    out = [F.col("episode_id").cast("string"), F.col("step_idx").cast("int"), col("reward", 0.0), col("is_terminal", False), col("language_instruction", "")]
    if "observation" in have:
        name = lambda k: F.when(k == "state", F.lit("proprio")).otherwise(k)
        scale = lambda k, v: F.when(k == "rgb", F.transform(v, lambda x: x / 255.0)).otherwise(v)
        out.append(F.transform_keys(F.transform_values("observation", scale), lambda k, v: name(k)).alias("observation"))
    out += [F.col(c) for c in raw.columns if c not in {"episode_id", "step_idx", "reward", "is_terminal", "language_instruction", "observation"}]
    return raw.select(*out)


def with_language(episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Episodes with the first instruction found: the episode's own, else that of its first step that has one, else an empty one."""
    first = steps.where("language_instruction is not null and language_instruction <> ''").groupBy("episode_id").agg(F.min_by("language_instruction", "step_idx").alias("_first"))
    return episodes.join(first, "episode_id", "left").withColumn("language_instruction", F.coalesce("language_instruction", "_first", F.lit(""))).drop("_first")


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resizes (h, w, channels) by bilinear weights between pixel centres."""
    h, w = image.shape[:2]

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    a, b, u = axis(h, height)
    c, d, v = axis(w, width)
    u, v = u[:, None, None], v[None, :, None]
    return (image[a][:, c] * (1 - v) + image[a][:, d] * v) * (1 - u) + (image[b][:, c] * (1 - v) + image[b][:, d] * v) * u


def resized(images: DataFrame, pixels: str, height: str, width: str, to: tuple[int, int] = (224, 224)) -> DataFrame:
    """Images as flat arrays, resized; height and width follow."""

    @F.pandas_udf("array<double>")
    def run(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bilinear(np.asarray(x, np.float64).reshape(int(a), int(b), -1), *to).ravel() for x, a, b in zip(p, h, w, strict=True)])

    return images.withColumns({pixels: run(F.col(pixels).cast("array<double>"), F.col(height), F.col(width)), height: F.lit(to[0]), width: F.lit(to[1])})


