"""Robot kinematics from Denavit-Hartenberg tables. Batches of rows go through NumPy at once, as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import need, one_of
from .align import resample
from .grids import grid_rate

POSE = "struct<x:double,y:double,z:double,qx:double,qy:double,qz:double,qw:double>"
Table = list[tuple[float, float, float, float]]
#: Of inverse kinematics: most iterations, tolerance in metres, damping.
ITERATIONS, TOLERANCE, DAMPING = 100, 1e-4, 0.01
STEP = 1e-5


def table_of(dh: DataFrame) -> Table:
    """A robot's table (joint, a, alpha, d, theta_offset), a row per joint, in joint order."""
    need(dh, ["joint", "a", "alpha", "d", "theta_offset"], "dh")
    return [tuple(r)[1:] for r in dh.select("joint", "a", "alpha", "d", "theta_offset").orderBy("joint").collect()]  # a robot has a few joints


def frames(q: np.ndarray, dh: Table) -> np.ndarray:
    """Frames of the base and after each joint, for each row of q: (rows, joints + 1, 4, 4)."""
    if q.shape[1] != len(dh):
        raise ValueError(f"q: expected {len(dh)} joints, got {q.shape[1]}")
    now = np.broadcast_to(np.eye(4), (len(q), 4, 4))
    out = [now]
    for j, (a, alpha, d, offset) in enumerate(dh):
        c, s = np.cos(q[:, j] + offset), np.sin(q[:, j] + offset)
        ca, sa, zero, one = np.cos(alpha), np.sin(alpha), np.zeros(len(q)), np.ones(len(q))
        rows = [[c, -s * ca, s * sa, a * c], [s, c * ca, -c * sa, a * s], [zero, one * sa, one * ca, one * d], [zero, zero, zero, one]]
        now = now @ np.stack([np.stack(r, -1) for r in rows], 1)
        out.append(now)
    return np.stack(out, 1)


def quaternions(m: np.ndarray) -> np.ndarray:
    """(x, y, z, w) of rotation matrices, from the largest of the four components."""
    t = np.stack([1 + m[:, 0, 0] - m[:, 1, 1] - m[:, 2, 2], 1 - m[:, 0, 0] + m[:, 1, 1] - m[:, 2, 2], 1 - m[:, 0, 0] - m[:, 1, 1] + m[:, 2, 2], 1 + m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2]], 1)
    # w is taken where the trace is positive, else the largest of the others.
    k = np.where(t[:, 3] > 1, 3, t[:, :3].argmax(1))
    pick = np.sqrt(np.maximum(t[np.arange(len(t)), k], 0)) * 2  # four times the component
    s = {(0, 1): m[:, 0, 1] + m[:, 1, 0], (0, 2): m[:, 0, 2] + m[:, 2, 0], (1, 2): m[:, 1, 2] + m[:, 2, 1], (0, 3): m[:, 2, 1] - m[:, 1, 2], (1, 3): m[:, 0, 2] - m[:, 2, 0], (2, 3): m[:, 1, 0] - m[:, 0, 1]}
    out = np.zeros((len(m), 4))
    for i in range(4):
        for j in range(4):
            own = k == i
            out[own, j] = (pick / 4 if i == j else s[min(i, j), max(i, j)] / pick)[own]
    return out


def poses(q: np.ndarray, dh: Table) -> np.ndarray:
    last = frames(q, dh)[:, -1]
    return np.hstack([last[:, :3, 3], quaternions(last[:, :3, :3])])


def jacobians(q: np.ndarray, dh: Table, method: str = "analytic") -> np.ndarray:
    """(rows, 6, joints): three linear and three angular rows. numeric: forward differences, whose angular rows are zero."""
    if method == "numeric":
        out, at = np.zeros((len(q), 6, len(dh))), frames(q, dh)[:, -1, :3, 3]
        for j in range(len(dh)):
            moved = q.copy()
            moved[:, j] += STEP
            out[:, :3, j] = (frames(moved, dh)[:, -1, :3, 3] - at) / STEP
        return out
    f = frames(q, dh)
    axes, origins = f[:, :-1, :3, 2], f[:, :-1, :3, 3]
    return np.concatenate([np.cross(axes, f[:, -1:, :3, 3] - origins), axes], 2).transpose(0, 2, 1)


def solve(target: np.ndarray, start: np.ndarray, dh: Table) -> tuple[np.ndarray, np.ndarray]:
    """Joints whose position meets the target's, by damped least squares; and the distance left."""
    q = start.copy()
    for _ in range(ITERATIONS):
        gap = target[:, :3] - frames(q, dh)[:, -1, :3, 3]
        far = np.linalg.norm(gap, axis=1) >= TOLERANCE
        if not far.any():
            break
        j = jacobians(q[far], dh)[:, :3]
        inner = j @ j.transpose(0, 2, 1) + DAMPING**2 * np.eye(3)
        q[far] += (j.transpose(0, 2, 1) @ np.linalg.solve(inner, gap[far][:, :, None]))[:, :, 0]
    return q, np.linalg.norm(target[:, :3] - frames(q, dh)[:, -1, :3, 3], axis=1)


def _rows(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s]) if len(s) else np.zeros((0, 0))


def _vectorised(f: Callable[..., list | pd.DataFrame], kind: str, width: int) -> Callable[..., Column]:
    """An Arrow UDF over array columns; rows with a null input, or arrays of another length, are null."""
    struct = kind.startswith("struct")

    def run(*cols: pd.Series) -> pd.Series | pd.DataFrame:
        ok = np.array([all(v is not None and (k or len(v) == width) for k, v in enumerate(row)) for row in zip(*cols, strict=True)], bool)
        got = f(*[_rows(c[ok]) for c in cols]) if ok.any() else []
        if struct:
            names = [p.split(":")[0] for p in kind[7:-1].split(",")]
            out = pd.DataFrame(np.nan, index=range(len(ok)), columns=names)
            if ok.any():
                out.loc[ok, :] = np.asarray(got)
            return out
        out = pd.Series([None] * len(ok), dtype=object)
        for i, v in zip(np.flatnonzero(ok), got, strict=True):
            out[i] = v
        return out

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def one_struct(a: pd.Series) -> pd.DataFrame:
        return run(a)

    def apply(*cols: Column) -> Column:
        return F.pandas_udf((one_struct if struct else one) if len(cols) == 1 else two, T._parse_datatype_string(kind))(*cols)

    return apply


def forward_kinematics(joints: DataFrame, dh: Table, q: str = "q") -> DataFrame:
    """``joints`` with pose (position, then quaternion); null joints have a pose of nulls."""
    need(joints, [q], "joints")
    table = list(dh)
    pose = _vectorised(lambda x: poses(x, table), POSE, len(table))(F.col(q).cast("array<double>"))
    return joints.withColumn("pose", pose)


def jacobian(joints: DataFrame, dh: Table, q: str = "q", method: str = "analytic") -> DataFrame:
    one_of(method, ("analytic", "numeric"), "method")
    table = list(dh)
    return joints.withColumn("jacobian", _vectorised(lambda x: [m.tolist() for m in jacobians(x, table, method)], "array<array<double>>", len(table))(F.col(q).cast("array<double>")))


def inverse_kinematics(targets: DataFrame, dh: Table, pose: str = "pose", start: str = "q0") -> DataFrame:
    """``targets`` with q, reached from ``start``; the last element of ``solution`` is the distance left. From the contract alone."""
    table = list(dh)

    def run(q0: np.ndarray, goal: np.ndarray) -> list:
        q, left = solve(goal, q0, table)
        return np.hstack([q, left[:, None]]).tolist()

    xyz = F.array(*[F.col(f"{pose}.{a}") for a in "xyz"]).cast("array<double>")
    out = targets.withColumn("solution", _vectorised(run, "array<double>", len(table))(F.col(start).cast("array<double>"), xyz))
    return out.withColumns({"q": F.slice("solution", 1, len(table)), "distance": F.element_at("solution", -1)}).drop("solution")


def cartesian_to_joint_velocity(rows: DataFrame, dh: Table, q: str = "q", twist: str = "v") -> DataFrame:
    """``rows`` with dq, the least joint velocity whose twist (3 linear, 3 angular) is nearest to ``v``. From the contract alone."""
    table = list(dh)

    def run(x: np.ndarray, v: np.ndarray) -> list:
        return (np.linalg.pinv(jacobians(x, table)) @ v[:, :, None])[:, :, 0].tolist()

    return rows.withColumn("dq", _vectorised(run, "array<double>", len(table))(F.col(q).cast("array<double>"), F.col(twist).cast("array<double>")))


def convert_action_space(rows: DataFrame, dh: Table, to: str, **columns: str) -> DataFrame:
    one_of(to, ("cartesian", "joint"), "to")
    return forward_kinematics(rows, dh, **columns) if to == "cartesian" else inverse_kinematics(rows, dh, **columns)


def joint_path(moves: DataFrame, keys: list[str], seconds: float, target_hz: float, source_hz: float = 100.0) -> DataFrame:
    """Straight lines in joint space from ``start`` to ``goal``, sampled at source_hz and resampled to target_hz: (keys, t, q)."""
    n = max(2, int(seconds * source_hz))
    steps = moves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("alpha", F.col("k") / F.lit(float(n - 1)))
    samples = steps.select(*keys, (F.col("alpha") * seconds).alias("t"), F.zip_with(F.col("start").cast("array<double>"), F.col("goal").cast("array<double>"), lambda a, b: a * (1 - F.col("alpha")) + b * F.col("alpha")).alias("q"))
    return resample(samples, grid_rate(moves.select(*keys).distinct(), 0.0, max(1, int(seconds * target_hz)), target_hz), keys, "t", "q")


