"""Sparse voxel grids of point clouds: a row per occupied voxel.

v = floor((p - grid_min) / voxel_size) per axis; the lower face belongs to the voxel. Points outside the grid are dropped, or with
``oob="clamp"`` go to the nearest edge voxel. Points with a null, NaN or infinite coordinate are dropped. Aggregates run partially
before the shuffle by voxel, so a crowded voxel costs one row per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import linear_id
from ..schema import need, need_numeric, one_of

AXES = ("x", "y", "z")
VOXEL = ["vx", "vy", "vz"]
#: Voxels that densify() makes at most.
MOST_DENSE = 1 << 27


def _three(value: float | tuple[float, ...]) -> tuple[float, ...]:
    out = (value,) * 3 if isinstance(value, (int, float)) else tuple(value)
    if len(out) != 3:
        raise ValueError(f"expected three numbers, got {out}")
    return out


def _checked(points: DataFrame, voxel_size: float, grid_size: tuple[int, ...]) -> None:
    need_numeric(points, AXES, "points")
    if voxel_size <= 0:
        raise ValueError(f"voxel_size: expected a positive number, got {voxel_size}")
    if any(n <= 0 for n in grid_size):
        raise ValueError(f"grid_size: expected positive numbers, got {grid_size}")


def binned(points: DataFrame, grid_min: float | tuple[float, ...] = -10.0, voxel_size: float = 0.1, grid_size: int | tuple[int, ...] = 128, oob: str = "drop", rounding: str = "floor") -> DataFrame:
    """``points`` with vx, vy, vz."""
    low, size = _three(grid_min), tuple(int(n) for n in _three(grid_size))
    _checked(points, voxel_size, size)
    one_of(oob, ("drop", "clamp"), "oob")
    one_of(rounding, ("floor", "trunc"), "rounding")
    big = 1e15  # beyond, a cast could overflow; such points are outside of any grid
    finite = lambda a: F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < big)

    def place(a: str, m: float, n: int) -> Column:
        v = (F.col(a).cast("double") - F.lit(float(m))) / F.lit(float(voxel_size))
        v = F.floor(v) if rounding == "floor" else F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int") if oob == "clamp" else v.cast("bigint")

    out = points.where(finite("x") & finite("y") & finite("z")).withColumns({f"v{a}": place(a, m, n) for a, m, n in zip(AXES, low, size, strict=True)})
    if oob == "drop":
        out = out.where(" and ".join(f"v{a} >= 0 and v{a} < {n}" for a, n in zip(AXES, size, strict=True)))
    return out.withColumns({v: F.col(v).cast("int") for v in VOXEL})


def voxelize(points: DataFrame, mode: str = "occupancy", features: list[str] | None = None, grid_min: float | tuple[float, ...] = -10.0, voxel_size: float = 0.1, grid_size: int | tuple[int, ...] = 128, cloud: str | None = None, oob: str = "drop", rounding: str = "floor", zero_floor: bool = False) -> DataFrame:
    """count: n. occupancy: 1. density: n as a fraction type. mean, max: of each feature, with n. ``zero_floor``: max is 0 at least."""
    one_of(mode, ("count", "occupancy", "density", "mean", "max"), "mode")
    if mode in ("mean", "max"):
        if not features:
            raise ValueError(f"mode {mode}: expected features, got none")
        need_numeric(points, features, "features")
    keys = [*([cloud] if cloud else []), *VOXEL]
    cells = binned(points, grid_min, voxel_size, grid_size, oob, rounding)
    if mode == "occupancy":
        return cells.select(*keys).distinct().withColumn("occupied", F.lit(1))
    n = F.count(F.lit(1))
    if mode == "count":
        return cells.groupBy(*keys).agg(n.cast("int").alias("n"))
    if mode == "density":
        return cells.groupBy(*keys).agg(n.cast("double").alias("density"))
    # NaN is the largest number here, and no feature's value.
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    if mode == "mean":
        return cells.groupBy(*keys).agg(n.cast("int").alias("n"), *[F.avg(value(c)).alias(f"mean_{c}") for c in features])
    top = lambda c: F.greatest(F.lit(0.0), F.max(value(c))) if zero_floor else F.max(value(c))
    return cells.groupBy(*keys).agg(n.cast("int").alias("n"), *[top(c).alias(f"max_{c}") for c in features])


def voxelize_occupancy(points: DataFrame, grid_size: int | tuple[int, ...], voxel_size: float, origin: float | tuple[float, ...], cloud: str | None = None) -> DataFrame:
    return voxelize(points, "occupancy", None, origin, voxel_size, grid_size, cloud)


voxelize_point_cloud = voxelize_occupancy


def multi_feature(points: DataFrame, features: list[str], cloud: str | None = None, **grid) -> DataFrame:
    """Means of many features (colours, normals, class scores) and counts, in one pass."""
    return voxelize(points, "mean", features, cloud=cloud, **grid)


def bounds(points: DataFrame, cloud: str) -> DataFrame:
    """Smallest and largest coordinates of each cloud. A cloud without points has no row."""
    need(points, [cloud, *AXES], "bounds")
    return points.groupBy(cloud).agg(*[f(a).alias(f"{f.__name__}_{a}") for f in (F.min, F.max) for a in AXES])


def tsdf(points: DataFrame, truncation: float, origin: float | tuple[float, ...] = -10.0, voxel_size: float = 0.1, grid_size: int | tuple[int, ...] = 128, cloud: str = "cloud_id", point: str = "point_id", normals: tuple[str, str, str] | None = None, fusion: str = "nearest") -> DataFrame:
    """Truncated signed distances near points, sparse: tsdf, weight (points in reach).

    A point reaches voxels whose centres lie nearer than ``truncation``. The sign is negative behind the surface, if there are
    normals. ``nearest``: the value of the nearest point, ties by point id; ``mean``: their mean. Each axis is cut to the sphere
    before the next one is unfolded, so a point makes about the voxels of the sphere's box, not of the whole neighbourhood.
    """
    one_of(fusion, ("nearest", "mean"), "fusion")
    if truncation <= 0:
        raise ValueError(f"truncation: expected a positive number, got {truncation}")
    low, size = _three(origin), tuple(int(n) for n in _three(grid_size))
    _checked(points, voxel_size, size)
    reach = math.ceil(truncation / voxel_size) + 1
    rows = points.select(cloud, point, *[F.col(a).cast("double").alias(a) for a in AXES], *(normals or ())).where(" and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < 1e15" for a in AXES))
    left = F.lit(0.0)
    for a, m, n in zip(AXES, low, size, strict=True):
        own = F.floor((F.col(a) - F.lit(float(m))) / F.lit(float(voxel_size))).cast("bigint")
        first, last = F.greatest(F.lit(0).cast("bigint"), own - reach), F.least(F.lit(n - 1).cast("bigint"), own + reach)
        near = F.when(first <= last, F.sequence(first, last))
        rows = rows.withColumn(f"v{a}", F.explode(near)).withColumn(f"d{a}", F.lit(float(m)) + (F.col(f"v{a}") + 0.5) * F.lit(float(voxel_size)) - F.col(a))
        left = left + F.col(f"d{a}") * F.col(f"d{a}")
        rows = rows.where(F.sqrt(left) < truncation)
    sign = F.lit(1.0)
    if normals:
        sign = F.when(sum((F.col(n) * F.col(f"d{a}") for n, a in zip(normals, AXES, strict=True)), F.lit(0.0)) > 0, -1.0).otherwise(1.0)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sign * F.sqrt(left) / F.lit(float(truncation))))
    rows = rows.select(cloud, point, *[F.col(v).cast("int").alias(v) for v in VOXEL], value.alias("d"))
    best = F.min_by("d", F.struct(F.abs("d"), point)) if fusion == "nearest" else F.avg("d")
    return rows.groupBy(cloud, *VOXEL).agg(best.alias("tsdf"), F.count(F.lit(1)).alias("weight"))


def densify(grid: DataFrame, grid_size: int | tuple[int, ...], fill: dict[str, float], clouds: DataFrame | None = None) -> DataFrame:
    """Every voxel, with ``fill`` where the sparse grid has none, and voxel_id. ``clouds``: a frame of the clouds' ids (few)."""
    nx, ny, nz = (int(n) for n in _three(grid_size))
    if nx * ny * nz > MOST_DENSE:
        raise ValueError(f"densify: expected {MOST_DENSE} voxels at most, got {nx * ny * nz}")
    spark = grid.sparkSession
    cube = spark.range(nx * ny * nz).select(F.expr(f"cast(id div {ny * nz} as int)").alias("vx"), F.expr(f"cast(id div {nz} % {ny} as int)").alias("vy"), F.expr(f"cast(id % {nz} as int)").alias("vz"))
    keys = VOXEL
    if clouds is not None:
        cube, keys = clouds.withColumn("_", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumnRenamed("_", "vx"), [*clouds.columns, *VOXEL]
        cube = cube.withColumn("vy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("vz", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))))
    return cube.join(grid, keys, "left").fillna(fill).withColumn("voxel_id", linear_id(F.col("vx"), F.col("vy"), F.col("vz"), ny, nz))


def descriptor(occupancy: DataFrame, grid_size: int | tuple[int, ...], value: str = "occupied") -> DataFrame:
    """Seven numbers of a whole grid, empty voxels as zeros: its mean; the largest mean, then the deviation of means, of xy, xz and yz planes' columns.

    One pass with grouping sets; sums over the sparse grid divided by the dimensions, and zeros for columns without a voxel.
    """
    nx, ny, nz = (int(n) for n in _three(grid_size))
    sums = occupancy.groupingSets([[F.col("vx"), F.col("vy")], [F.col("vx"), F.col("vz")], [F.col("vy"), F.col("vz")], []], "vx", "vy", "vz").agg(F.sum(F.col(value).cast("double")).alias("s"), F.grouping_id().alias("g"))
    # grouping_id: bit 4 for vx, 2 for vy, 1 for vz, set if summed over.
    out = [(F.coalesce(F.max(F.when(F.col("g") == 7, F.col("s"))), F.lit(0.0)) / (nx * ny * nz)).alias("mean")]
    planes = (("xy", 1, nz, nx * ny), ("xz", 2, ny, nx * nz), ("yz", 4, nx, ny * nz))
    for name, g, depth, _ in planes:
        out.append(F.coalesce(F.max(F.when(F.col("g") == g, F.col("s") / depth)), F.lit(0.0)).alias(f"max_{name}"))
    for name, g, depth, cells in planes:
        m = F.when(F.col("g") == g, F.col("s") / depth)
        total, squares = F.coalesce(F.sum(m), F.lit(0.0)), F.coalesce(F.sum(m * m), F.lit(0.0))
        out.append(F.sqrt(F.greatest(F.lit(0.0), squares - total * total / cells) / max(1, cells - 1)).alias(f"std_{name}"))
    return sums.agg(*out)


def slice_z(grid: DataFrame, nz: int, value: str = "occupied") -> DataFrame:
    """The middle layer as whole per cents, for navigation."""
    return grid.where(F.col("vz") == nz // 2).select("vx", "vy", (F.col(value) * 100).cast("tinyint").alias("cost"))


def summary(rows: DataFrame, grid: DataFrame, grid_size: int | tuple[int, ...], value: str = "occupied") -> DataFrame:
    """``rows`` with the grid's mean value in each; the grid side of the join is one row."""
    nx, ny, nz = (int(n) for n in _three(grid_size))
    return rows.crossJoin(F.broadcast(grid.agg((F.coalesce(F.sum(value), F.lit(0)) / (nx * ny * nz)).alias("voxel_mean"))))


def unproject(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, near: float = 0.1, far: float = 10.0) -> DataFrame:
    """Pinhole camera: pixels (u, v, depth) with near < depth < far as points."""
    need_numeric(pixels, ["u", "v", "depth"], "unproject")
    d = F.col("depth")
    return pixels.where((d > near) & (d < far)).withColumns({"x": (F.col("u") - cx) * d / fx, "y": (F.col("v") - cy) * d / fy, "z": d})
