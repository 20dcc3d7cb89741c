"""Native expressions over scalars and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lerp(left: Column, right: Column, weight: Column, array: bool) -> Column:
    """left + weight * (right - left), elementwise for arrays."""
    if array:
        return F.zip_with(left, right, lambda a, b: a + weight * (b - a))
    return left + weight * (right - left)


def linspace(start: float, stop: float, n: int) -> Column:
    """n evenly spaced numbers, both ends included; one number if n is 1."""
    if n < 1:
        raise ValueError(f"linspace: expected n >= 1, got {n}")
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * F.lit(step))


def norm(array: Column) -> Column:
    return F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + x * x))


def linear_id(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    """Place of a voxel in row-major order, z innermost."""
    return ((x.cast("bigint") * ny + y) * nz + z).cast("bigint")


def uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) that depends on ``parts`` alone, whatever the partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*parts: Column | int | str) -> Column:
    """A standard normal number that depends on ``parts`` alone (Box and Muller)."""
    radius = F.sqrt(-2.0 * F.log(uniform(*parts, "radius")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(*parts, "angle"))


def human_bytes(n: float) -> str:
    """A byte count for people."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TB"
