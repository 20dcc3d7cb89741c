"""Augmentation. Random numbers are hashes of a row's id, a place and a seed, so results don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import normal, uniform
from ..schema import need

# Ranges and rates of the augmentations.
LIGHT, CAMERA_NOISE, KERNELS, OCCLUDED = (0.7, 1.3), 0.05, (3, 5, 7), 0.3
LIDAR_NOISE, DROPPED, OUTLIERS, OUTLIER_RANGE = 0.02, 0.05, 0.05, 10.0
PROPRIO_NOISE = 0.01


def _noise(array: Column, scale: float, *parts: Column | int | str) -> Column:
    return F.transform(array, lambda v, i: v + normal(*parts, i) * scale)


def proprio(rows: DataFrame, id_col: str, values: str = "values", seed: int = 0, scale: float = PROPRIO_NOISE) -> DataFrame:
    need(rows, [id_col, values], "proprio")
    return rows.withColumn(values, _noise(F.col(values).cast("array<double>"), scale, F.col(id_col), seed, "proprio"))


def lidar(points: DataFrame, id_cols: list[str], seed: int = 0) -> DataFrame:
    """Noise on each coordinate; then some points go to the origin, and after that some, dropped ones among them, anywhere in the range."""
    need(points, [*id_cols, "x", "y", "z"], "lidar")
    ids = [F.col(c) for c in id_cols]
    drop, out = uniform(*ids, seed, "drop") < DROPPED, uniform(*ids, seed, "out") < OUTLIERS

    def axis(a: str) -> Column:
        noisy = F.col(a).cast("double") + normal(*ids, seed, a) * LIDAR_NOISE
        return F.when(out, (uniform(*ids, seed, "far", a) * 2 - 1) * OUTLIER_RANGE).when(drop, F.lit(0.0)).otherwise(noisy)

    return points.withColumns({a: axis(a) for a in "xyz"})


def _image(change: Callable[[np.ndarray, int, int, int], np.ndarray]) -> Callable[..., Column]:
    @F.pandas_udf("array<double>")
    def run(pixels: pd.Series, h: pd.Series, w: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else change(np.asarray(p, np.float64).reshape(int(a), int(b), -1), int(a), int(b), int(s)).ravel() for p, a, b, s in zip(pixels, h, w, seed, strict=True)])

    return run


def box_blur(x: np.ndarray, k: int) -> np.ndarray:
    """Means over k by k pixels; beyond the edge lie zeros, which count."""
    p = np.pad(x, ((k // 2, k // 2), (k // 2, k // 2), (0, 0)))
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def _blur_and_occlude(x: np.ndarray, h: int, w: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    x = box_blur(x, int(rng.choice(KERNELS)))
    if rng.random() < OCCLUDED:
        a, b = int(rng.integers(max(1, h // 10), max(2, h // 4 + 1))), int(rng.integers(max(1, w // 10), max(2, w // 4 + 1)))
        top, left = int(rng.integers(0, h - a + 1)), int(rng.integers(0, w - b + 1))
        x[top : top + a, left : left + b] = 0
    return x


def vision(images: DataFrame, id_col: str, pixels: str = "pixels", seed: int = 0, batch: str | None = None, height: str | None = None, width: str | None = None) -> DataFrame:
    """Light (one factor per ``batch``), noise on each pixel, and for images of known height and width blur and an occlusion."""
    need(images, [id_col, pixels], "vision")
    light = LIGHT[0] + uniform(F.col(batch) if batch else F.lit(0), seed, "light") * (LIGHT[1] - LIGHT[0])
    lit = F.transform(F.col(pixels).cast("array<double>"), lambda v, i: v * light + normal(F.col(id_col), seed, "camera", i) * CAMERA_NOISE)
    out = images.withColumn(pixels, lit)
    if height and width:
        out = out.withColumn(pixels, _image(_blur_and_occlude)(F.col(pixels), F.col(height), F.col(width), F.xxhash64(F.col(id_col), F.lit(seed))))
    return out


def randomize(frames: dict[str, DataFrame | None], ids: dict[str, list[str]], seed: int = 0) -> dict[str, DataFrame | None]:
    """Each of vision, lidar and proprio by its own rules; what is absent stays absent."""
    out: dict[str, DataFrame | None] = dict(frames)
    for name, frame in frames.items():
        if frame is None:
            continue
        if name == "vision":
            out[name] = vision(frame, ids[name][0], seed=seed)
        elif name == "lidar":
            out[name] = lidar(frame, ids[name], seed)
        elif name == "proprio":
            out[name] = proprio(frame, ids[name][0], seed=seed)
        else:
            raise ValueError(f"randomize: expected vision, lidar or proprio, got {name!r}")
    return out
