"""Temporal attention, inference only: sequences through NumPy, weights given by the caller.

Positional codes are native expressions. A sequence is bounded by the model's longest length, so one fits a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import need

D_MODEL, LAYERS, HEADS, FORWARD, LONGEST = 512, 4, 8, 2048, 1000


def positional_code(place: Column, width: int) -> Column:
    """Sines at even places and cosines at odd ones, of falling frequency."""
    rate = lambda i: F.exp(F.lit(-math.log(10000.0) / width) * (i - i % 2))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i % 2 == 0, F.sin(place * rate(i))).otherwise(F.cos(place * rate(i))))


def positional_encoding(rows: DataFrame, place: str, values: str, width: int) -> DataFrame:
    """``values`` plus the code of the row's place in its sequence."""
    return rows.withColumn(values, F.zip_with(F.col(values).cast("array<double>"), positional_code(F.col(place), width), lambda a, b: a + b))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * scale + shift


_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + _erf(x / math.sqrt(2)))


Weights = dict[str, np.ndarray]


def attend(q_from: np.ndarray, kv_from: np.ndarray, w: Weights, prefix: str, heads: int, causal: bool, mask: np.ndarray | None = None) -> np.ndarray:
    """Multi-head attention; ``mask`` is 0 where a pair may not attend."""
    def split(x: np.ndarray, name: str) -> np.ndarray:
        y = x @ w[f"{prefix}.{name}.w"] + w[f"{prefix}.{name}.b"]
        return y.reshape(len(y), heads, -1).transpose(1, 0, 2)

    q, k, v = split(q_from, "q"), split(kv_from, "k"), split(kv_from, "v")
    scores = q @ k.transpose(0, 2, 1) / math.sqrt(q.shape[-1])
    if causal:
        scores = np.where(np.tri(*scores.shape[1:], dtype=bool), scores, -np.inf)
    if mask is not None:
        scores = np.where(mask == 0, -np.inf, scores)
    mixed = (softmax(scores) @ v).transpose(1, 0, 2).reshape(len(q_from), -1)
    return mixed @ w[f"{prefix}.o.w"] + w[f"{prefix}.o.b"]


def block(x: np.ndarray, w: Weights, prefix: str, heads: int, mask: np.ndarray | None = None) -> np.ndarray:
    """Attention and a feed-forward net, each added and normalised after."""
    x = layer_norm(x + attend(x, x, w, f"{prefix}.attn", heads, True, mask), w[f"{prefix}.n1.w"], w[f"{prefix}.n1.b"])
    inner = gelu(x @ w[f"{prefix}.f1.w"] + w[f"{prefix}.f1.b"]) @ w[f"{prefix}.f2.w"] + w[f"{prefix}.f2.b"]
    return layer_norm(x + inner, w[f"{prefix}.n2.w"], w[f"{prefix}.n2.b"])


@dataclass(frozen=True)
class Fusion:
    """Three modalities to one feature per step. Cross attention is not causal, so neither is the whole."""

    widths: dict[str, int]
    d_model: int = D_MODEL
    layers: int = LAYERS
    heads: int = HEADS
    forward: int = FORWARD
    weights: Weights = field(default_factory=dict)

    @classmethod
    def seeded(cls, widths: dict[str, int], seed: int = 0, **sizes: int) -> Fusion:
        """Weights drawn at random, for tests and as a start."""
        m = cls(widths, **sizes)
        rng, d = np.random.default_rng(seed), m.d_model
        def dense(name: str, a: int, b: int) -> None:
            m.weights[f"{name}.w"], m.weights[f"{name}.b"] = rng.normal(0, 1 / math.sqrt(a), (a, b)), np.zeros(b)
        def norm(name: str) -> None:
            m.weights[f"{name}.w"], m.weights[f"{name}.b"] = np.ones(d), np.zeros(d)
        for n, width in widths.items():
            dense(f"in.{n}", width, d)
            for k in range(m.layers):
                for part in "qkvo":
                    dense(f"{n}.{k}.attn.{part}", d, d)
                dense(f"{n}.{k}.f1", d, m.forward)
                dense(f"{n}.{k}.f2", m.forward, d)
                norm(f"{n}.{k}.n1")
                norm(f"{n}.{k}.n2")
            for part in "qkvo":
                dense(f"cross.{n}.{part}", d, d)
        dense("out", 3 * d, d)
        norm("out.n")
        return m

    def __call__(self, vision: np.ndarray, lidar: np.ndarray, proprio: np.ndarray) -> np.ndarray:
        w, d, x = self.weights, self.d_model, {}
        for n, raw in (("vision", vision), ("lidar", lidar), ("proprio", proprio)):
            y = raw @ w[f"in.{n}.w"] + w[f"in.{n}.b"]
            place, i = np.arange(len(y))[:, None], np.arange(d)[None]
            angle = place * np.exp(-math.log(10000.0) / d * (i - i % 2))
            y = y + np.where(i % 2 == 0, np.sin(angle), np.cos(angle))
            for k in range(self.layers):
                y = block(y, w, f"{n}.{k}", self.heads)
            x[n] = y
        cross = lambda n, context: attend(x[n], context, w, f"cross.{n}", self.heads, False)
        a, b = cross("vision", x["lidar"]), cross("lidar", x["vision"])
        c = cross("proprio", np.concatenate([x["vision"], x["lidar"]]))
        return gelu(layer_norm(np.hstack([a, b, c]) @ w["out.w"] + w["out.b"], w["out.n.w"], w["out.n.b"]))


def temporal_fusion(rows: DataFrame, model: Fusion, sequence: str, place: str) -> DataFrame:
    """(sequence, place, features) of rows with vision, lidar and proprio arrays; a sequence has LONGEST rows at most."""
    need(rows, [sequence, place, "vision", "lidar", "proprio"], "temporal_fusion")
    kind = rows.schema[sequence].dataType.simpleString()
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # its size is the model's

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > LONGEST:
            raise ValueError(f"temporal_fusion: expected {LONGEST} rows at most, got {len(pdf)}")
        pdf = pdf.sort_values(place)
        got = shipped.value(*(np.stack([np.asarray(v, np.float64) for v in pdf[c]]) for c in ("vision", "lidar", "proprio")))
        return pd.DataFrame({sequence: pdf[sequence], place: pdf[place].astype("int64"), "features": list(got)})

    return rows.select(sequence, place, "vision", "lidar", "proprio").groupBy(sequence).applyInPandas(run, f"{sequence} {kind}, {place} bigint, features array<double>")


def temporal_pool(rows: DataFrame, keys: list[str], values: str, width: int) -> DataFrame:
    """The mean of each feature over a sequence."""
    return rows.groupBy(*keys).agg(F.array(*[F.avg(F.get(F.col(values), F.lit(i)).cast("double")) for i in range(width)]).alias("pooled"))
