"""Registered queries of the sensor operators over the driver's tables, each with equivalent SQL where there is such.

Events play sensor logs (user: series, type: stream), embeddings and line items play point clouds and joint angles, conversations
play episodes. Sums of fractions are rounded on both sides, since their order is free.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, attention, augment, episodes, grids, kinematics, metrics, planning, voxel
from ..schema import micros
from ..sources import readers
from ..streaming import operators as streaming
from ..streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
START, HOUR, DAY = 1704067200000000, 3600000000, 86400000000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", micros(e, "ts").alias("t"), "value")


def grid(spark: SparkSession, d: str, keys: tuple[str, ...] = ("user_id",), step: int = 6 * HOUR, n: int = 120) -> DataFrame:
    return grids.grid_steps(events(spark, d).select(*keys).distinct(), START, step, n)


def rounded(c: str | Column, n: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def dims(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    """Embeddings' first numbers as x, y, z, ... ."""
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias("xyzuvw"[i]) for i in range(n)])


# SQL in pieces: the same tables and rules.
EV = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, value FROM events)"


def sql_grid(keys: str = "user_id", step: int = 6 * HOUR, n: int = 120) -> str:
    return f"g AS (SELECT {keys}, {START} + k * {step} AS t FROM (SELECT DISTINCT {keys} FROM events) AS s, range({n}) AS r(k))"


def sql_round(x: str, n: int = 9) -> str:
    return f"(round({x}, {n}) + 0e0)"


def sql_between(name: str, source: str, keys: tuple[str, ...] = ("user_id",), targets: str = "g", linear: bool = False) -> str:
    """CTEs that give ``name`` (keys, t, value): ``source`` (keys, t, value) at the targets' times."""
    on = " AND ".join(f"g.{k} = s.{k}" for k in keys)
    cols = ", ".join(f"g.{k}" for k in keys)
    part = ", ".join(keys)
    src = f"(SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY t))"
    first = "CASE WHEN r.rt > l.t AND r.nt IS NOT NULL THEN r.rv + (CAST(l.t - r.rt AS DOUBLE) / CAST(r.nt - r.rt AS DOUBLE)) * (r.nv - r.rv) ELSE r.rv END" if linear else "r.rv"
    last = "CASE WHEN l.pt IS NOT NULL THEN l.pv + (CAST(l.t - l.pt AS DOUBLE) / CAST(l.lt - l.pt AS DOUBLE)) * (l.lv - l.pv) ELSE l.lv END" if linear else "l.lv"
    using = " AND ".join(f"l.{k} = r.{k}" for k in keys)
    return f"""{name}_s AS {src},
{name}_l AS (SELECT {cols}, g.t, s.t AS lt, s.value AS lv, s.pt, s.pv FROM (SELECT DISTINCT {part}, t FROM {targets}) AS g ASOF LEFT JOIN {name}_s AS s ON {on} AND g.t > s.t),
{name}_r AS (SELECT {cols}, g.t, s.t AS rt, s.value AS rv, s.nt, s.nv FROM (SELECT DISTINCT {part}, t FROM {targets}) AS g ASOF LEFT JOIN {name}_s AS s ON {on} AND g.t <= s.t),
{name} AS (SELECT {", ".join(f"l.{k}" for k in keys)}, l.t, l.lt, r.rt, CASE WHEN l.lt IS NULL THEN {first} WHEN r.rt IS NULL THEN {last} ELSE l.lv + (CAST(l.t - l.lt AS DOUBLE) / CAST(r.rt - l.lt AS DOUBLE)) * (r.rv - l.lv) END AS value
 FROM {name}_l AS l JOIN {name}_r AS r ON {using} AND l.t = r.t)"""


def sql_stream(kind: str) -> str:
    return f"(SELECT user_id, t, value FROM ev WHERE event_type = '{kind}')"


# ---- resampling and fusion


@query(f"WITH {EV}, {sql_grid()}, {sql_between('v', 'ev')} SELECT user_id, t, value FROM v")
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return align.resample(events(spark, d), grid(spark, d), ["user_id"])


@query(SQL["resample_linear"])
def resample_bucketed(spark: SparkSession, d: str) -> DataFrame:
    return align.resample(events(spark, d), grid(spark, d), ["user_id"], bucket=3 * DAY)


@query(SQL["resample_linear"])
def resample_arrow(spark: SparkSession, d: str) -> DataFrame:
    return align.resample(events(spark, d), grid(spark, d), ["user_id"], strategy="arrow")


@query(f"WITH {EV}, {sql_grid('user_id, event_type', DAY, 30)}, {sql_between('v', 'ev', ('user_id', 'event_type'))} SELECT user_id, event_type, t, value FROM v")
def resample_by_type(spark: SparkSession, d: str) -> DataFrame:
    return align.resample(events(spark, d), grid(spark, d, ("user_id", "event_type"), DAY, 30), ["user_id", "event_type"])


@query(f"WITH {EV}, {sql_grid()}, {sql_between('v', 'ev', linear=True)} SELECT user_id, t, {sql_round('value')} AS value FROM v")
def resample_extrapolate(spark: SparkSession, d: str) -> DataFrame:
    return align.resample(events(spark, d), grid(spark, d), ["user_id"], extrapolate="linear").withColumn("value", rounded("value"))


BY_INDEX = f"""WITH {EV}, p AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS DOUBLE) AS t, value FROM ev),
g AS (SELECT user_id, k, k * m / 19 AS t FROM (SELECT user_id, max(t) AS m FROM p GROUP BY user_id) AS s, range(20) AS r(k)), {sql_between('v', 'p')}
SELECT g.user_id, CAST(g.k AS INTEGER) AS k, {sql_round('v.value')} AS value FROM g JOIN v ON g.user_id = v.user_id AND g.t = v.t"""


@query(BY_INDEX)
def resample_by_index(spark: SparkSession, d: str) -> DataFrame:
    return align.resample_by_index(events(spark, d), ["user_id"], 20).withColumn("value", rounded("value"))


STREAMS = ("view", "click", "purchase")


def stream(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind).select("user_id", "t", "value")


FUSED = f"WITH {EV}, {sql_grid()}, " + ", ".join(sql_between(k, sql_stream(k)) for k in STREAMS)
FUSED += ' SELECT g.user_id, g.t, "view".value AS "view", click.value AS click, purchase.value AS purchase FROM g ' + " ".join(f'JOIN "{k}" ON g.user_id = "{k}".user_id AND g.t = "{k}".t' for k in STREAMS)
FUSED = FUSED.replace("view_s AS", '"view_s" AS').replace(" view AS (", ' "view" AS (').replace(", view AS (", ', "view" AS (').replace("\nview AS (", '\n"view" AS (')


@query(FUSED)
def fuse_three_streams(spark: SparkSession, d: str) -> DataFrame:
    return align.fuse({k: stream(spark, d, k) for k in STREAMS}, grid(spark, d), ["user_id"])


PRIMARY = f"WITH {EV}, g AS (SELECT user_id, event_id, t, value FROM ev WHERE event_type = 'purchase'), {sql_between('v', sql_stream('view'))} SELECT g.user_id, g.event_id, g.t, g.value, v.value AS secondary FROM g JOIN v ON g.user_id = v.user_id AND g.t = v.t"


@query(PRIMARY)
def fuse_primary(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", "t", "value")
    return align.fuse_primary(own, stream(spark, d, "view"), ["user_id"])


OPTIONAL = f"WITH {EV}, {sql_grid()}, {sql_between('a', sql_stream('view'))}, {sql_between('b', sql_stream('click'))} SELECT a.user_id, a.t, a.value AS f0, b.value AS f1 FROM a JOIN b ON a.user_id = b.user_id AND a.t = b.t WHERE a.value IS NOT NULL AND b.value IS NOT NULL"


@query(OPTIONAL)
def fuse_optional(spark: SparkSession, d: str) -> DataFrame:
    out = align.fuse({k: stream(spark, d, k) for k in ("view", "click")}, grid(spark, d), ["user_id"], concat=True)
    return out.select("user_id", "t", F.get("fused", F.lit(0)).alias("f0"), F.get("fused", F.lit(1)).alias("f1")).where("f0 is not null and f1 is not null")


@query(f"WITH {EV} SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM ev")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("valid", F.col("event_type") != "error")
    return align.forward_fill(e, ["user_id"], tie="event_id").select("event_id", "user_id", "filled")


def sql_nearest(source: str, targets: str) -> str:
    return f"""{sql_between('v', source, targets=targets)},
n AS (SELECT user_id, t, CASE WHEN lt IS NULL THEN rt WHEN rt IS NULL THEN lt WHEN t - lt <= rt - t THEN lt ELSE rt END AS sample_t FROM v)"""


@query(f"WITH {EV}, c AS {sql_stream('click')}, {sql_grid()}, {sql_nearest('c', 'g')} SELECT n.user_id, n.t, n.sample_t, c.value FROM n LEFT JOIN c ON n.user_id = c.user_id AND n.sample_t = c.t")
def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    return align.nearest_asof(stream(spark, d, "click"), grid(spark, d), ["user_id"])


@query(f"WITH {EV}, k AS (SELECT user_id, {START} + k * {DAY} AS tick FROM (SELECT DISTINCT user_id FROM events) AS s, range(30) AS r(k)), g AS (SELECT user_id, tick - {HOUR} AS t FROM k), {sql_nearest('ev', 'g')} SELECT n.user_id, n.t + {HOUR} AS tick, n.sample_t, ev.value FROM n JOIN ev ON n.user_id = ev.user_id AND n.sample_t = ev.t")
def latency_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = align.observed_with_latency(events(spark, d), grid(spark, d, step=DAY, n=30), ["user_id"], HOUR)
    return out.select("user_id", "tick", "sample_t", "value")


GRADIENT = f"""WITH {EV}, {sql_grid(step=DAY, n=30)}, {sql_between('v', 'ev')},
w AS (SELECT user_id, lt, rt, CASE WHEN lt IS NULL THEN 1e0 WHEN rt IS NULL THEN 0e0 ELSE CAST(t - lt AS DOUBLE) / CAST(rt - lt AS DOUBLE) END AS w FROM v),
p AS (SELECT user_id, lt AS t, (1e0 - w) AS x FROM w WHERE lt IS NOT NULL UNION ALL SELECT user_id, rt, w FROM w WHERE rt IS NOT NULL)
SELECT user_id, t, {sql_round('sum(x)')} AS source_grad FROM p GROUP BY user_id, t"""


@query(GRADIENT)
def resample_gradient(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d, step=DAY, n=30).withColumn("grad", F.lit(1.0))
    return align.resample_gradient(events(spark, d), g, ["user_id"]).withColumn("source_grad", rounded("source_grad"))


# ---- voxels

CELL, ITEMS = 2.5, (21, 5, 4)
LINES = "p AS (SELECT l_returnflag, l_quantity AS x, l_discount * 100e0 AS y, l_tax * 100e0 AS z, l_extendedprice AS price, l_quantity AS qty FROM lineitem), "
LINES += "c AS (SELECT *, CAST(floor(x / 25e-1) AS INTEGER) AS vx, CAST(floor(y / 25e-1) AS INTEGER) AS vy, CAST(floor(z / 25e-1) AS INTEGER) AS vz FROM p), b AS (SELECT * FROM c WHERE vx >= 0 AND vx < 21 AND vy >= 0 AND vy < 5 AND vz >= 0 AND vz < 4)"
OF_LINES = {"grid_min": 0.0, "voxel_size": CELL, "grid_size": ITEMS}


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100.0).alias("y"), (F.col("l_tax") * 100.0).alias("z"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))


def sql_voxels(columns: str, cloud: str = "") -> str:
    return f"WITH {LINES} SELECT {cloud}vx, vy, vz, {columns} FROM b GROUP BY {cloud}vx, vy, vz"


@query(sql_voxels("CAST(count(*) AS INTEGER) AS n"))
def voxel_count(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "count", **OF_LINES)


@query(sql_voxels("1 AS occupied"))
def voxel_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "occupancy", **OF_LINES)


@query(sql_voxels(f"CAST(count(*) AS INTEGER) AS n, {sql_round('avg(price)', 6)} AS mean_price"))
def voxel_mean(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "mean", ["price"], **OF_LINES).withColumn("mean_price", rounded("mean_price", 6))


@query(sql_voxels("CAST(count(*) AS INTEGER) AS n, max(price) AS max_price"))
def voxel_max(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "max", ["price"], **OF_LINES)


@query(sql_voxels("1 AS occupied", "l_returnflag, "))
def voxel_occupancy_batched(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "occupancy", cloud="l_returnflag", **OF_LINES)


@query(sql_voxels("CAST(count(*) AS DOUBLE) AS density", "l_returnflag, "))
def voxel_density_batched(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "density", cloud="l_returnflag", **OF_LINES)


@query(sql_voxels("CAST(count(*) AS INTEGER) AS n, max(price) AS max_price", "l_returnflag, "))
def voxel_feature_max_batched(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "max", ["price"], cloud="l_returnflag", **OF_LINES)


@query(sql_voxels(f"CAST(count(*) AS INTEGER) AS n, {sql_round('avg(price)', 6)} AS mean_price", "l_returnflag, "))
def voxel_feature_mean_batched(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(lines(spark, d), "mean", ["price"], cloud="l_returnflag", **OF_LINES).withColumn("mean_price", rounded("mean_price", 6))


@query(sql_voxels(f"CAST(count(*) AS INTEGER) AS n, {sql_round('avg(price)', 6)} AS mean_price, {sql_round('avg(qty)', 6)} AS mean_qty"))
def voxel_multi_feature(spark: SparkSession, d: str) -> DataFrame:
    return voxel.multi_feature(lines(spark, d), ["price", "qty"], **OF_LINES).withColumns({c: rounded(c, 6) for c in ("mean_price", "mean_qty")})


DIMS = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def sql_bins(rule: str, size: str, low: str, n: int, where: bool) -> str:
    out = f"c AS (SELECT *, {', '.join(f'CAST({rule.format(f"(({a} - {low}) / {size})")} AS INTEGER) AS v{a}' for a in 'xyz')} FROM p)"
    return out + (f", b AS (SELECT * FROM c WHERE {' AND '.join(f'v{a} >= 0 AND v{a} < {n}' for a in 'xyz')})" if where else "")


@query(f"WITH {DIMS}, {sql_bins('greatest(0, least(5, floor({})))', '5e-2', '-15e-2', 6, False)} SELECT vx, vy, vz, CAST(count(*) AS INTEGER) AS n FROM c GROUP BY vx, vy, vz")
def voxel_clamp(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(dims(spark, d), "count", grid_min=-0.15, voxel_size=0.05, grid_size=6, oob="clamp")


@query(f"WITH {DIMS}, {sql_bins('trunc({})', '5e-2', '-15e-2', 6, True)} SELECT vx, vy, vz, CAST(count(*) AS INTEGER) AS n FROM b GROUP BY vx, vy, vz")
def voxel_truncated(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(dims(spark, d), "count", grid_min=-0.15, voxel_size=0.05, grid_size=6, rounding="trunc")


@query("WITH " + DIMS + " SELECT label, " + ", ".join(f"{f}({a}) AS {f}_{a}" for f in ("min", "max") for a in "xyz") + " FROM p GROUP BY label")
def cloud_bounds(spark: SparkSession, d: str) -> DataFrame:
    return voxel.bounds(dims(spark, d), "label")


OCCUPIED = f"{DIMS}, {sql_bins('floor({})', '1e-1', '-6e-1', 12, True)}, o AS (SELECT DISTINCT vx, vy, vz FROM b)"


def occupied(spark: SparkSession, d: str) -> DataFrame:
    return voxel.voxelize(dims(spark, d), "occupancy", grid_min=-0.6, voxel_size=0.1, grid_size=12)


CUBE = "q AS (SELECT CAST(a.i AS INTEGER) AS vx, CAST(b.i AS INTEGER) AS vy, CAST(c.i AS INTEGER) AS vz FROM range(12) AS a(i), range(12) AS b(i), range(12) AS c(i))"


@query(f"WITH {OCCUPIED}, {CUBE} SELECT q.vx, q.vy, q.vz, CASE WHEN o.vx IS NULL THEN 0 ELSE 1 END AS occupied, CAST((q.vx * 12 + q.vy) * 12 + q.vz AS BIGINT) AS voxel_id FROM q LEFT JOIN o USING (vx, vy, vz)")
def voxel_dense(spark: SparkSession, d: str) -> DataFrame:
    return voxel.densify(occupied(spark, d), 12, {"occupied": 0})


def sql_plane(a: str, b: str, name: str) -> str:
    return f"{name} AS (SELECT {a}, {b}, sum(f) / 12e0 AS m FROM f GROUP BY {a}, {b})"


DESCRIPTOR = f"""WITH {OCCUPIED}, {CUBE}, f AS (SELECT q.*, CASE WHEN o.vx IS NULL THEN 0e0 ELSE 1e0 END AS f FROM q LEFT JOIN o USING (vx, vy, vz)),
{sql_plane('vx', 'vy', 'xy')}, {sql_plane('vx', 'vz', 'xz')}, {sql_plane('vy', 'vz', 'yz')}
SELECT {sql_round('(SELECT avg(f) FROM f)')} AS mean, """ + ", ".join(f"{sql_round(f'(SELECT {g}(m) FROM {p})')} AS {n}_{p}" for n, g in (("max", "max"), ("std", "stddev_samp")) for p in ("xy", "xz", "yz"))


@query(DESCRIPTOR)
def voxel_descriptor(spark: SparkSession, d: str) -> DataFrame:
    out = voxel.descriptor(occupied(spark, d), 12)
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(f"WITH {OCCUPIED} SELECT vx, vy, CAST(100 AS TINYINT) AS cost FROM o WHERE vz = 6")
def voxel_slice(spark: SparkSession, d: str) -> DataFrame:
    return voxel.slice_z(occupied(spark, d), 12)


@query(f"WITH {OCCUPIED} SELECT vec_id, {sql_round('(SELECT count(*) FROM o) / 1728e0')} AS voxel_mean FROM embeddings")
def voxel_summary(spark: SparkSession, d: str) -> DataFrame:
    return voxel.summary(table(spark, d, "embeddings").select("vec_id"), occupied(spark, d), 12).withColumn("voxel_mean", rounded("voxel_mean"))


TSDF = f"""WITH {DIMS}, r AS (SELECT CAST(i AS INTEGER) AS i FROM range(8) AS s(i)),
e AS (SELECT label, vec_id, a.i AS vx, b.i AS vy, c.i AS vz, -4e-1 + (a.i + 5e-1) * 1e-1 - x AS dx, -4e-1 + (b.i + 5e-1) * 1e-1 - y AS dy, -4e-1 + (c.i + 5e-1) * 1e-1 - z AS dz FROM p, r AS a, r AS b, r AS c),
f AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM e WHERE sqrt(dx * dx + dy * dy + dz * dz) < 15e-2),
n AS (SELECT *, greatest(-1e0, least(1e0, CASE WHEN 1e0 * dx > 0 THEN -1e0 ELSE 1e0 END * dist / 15e-2)) AS v FROM f)
SELECT label, vx, vy, vz, {{}} AS tsdf, count(*) AS weight FROM n GROUP BY label, vx, vy, vz"""


def _tsdf(spark: SparkSession, d: str, fusion: str) -> DataFrame:
    points = dims(spark, d).withColumns({"nx": F.lit(1.0), "ny": F.lit(0.0), "nz": F.lit(0.0)})
    return voxel.tsdf(points, 0.15, -0.4, 0.1, 8, "label", "vec_id", ("nx", "ny", "nz"), fusion).withColumn("tsdf", rounded("tsdf"))


@query(TSDF.format(sql_round("arg_min(v, (abs(v), vec_id))")))
def tsdf(spark: SparkSession, d: str) -> DataFrame:
    return _tsdf(spark, d, "nearest")


@query(TSDF.format(sql_round("avg(v)")))
def tsdf_mean(spark: SparkSession, d: str) -> DataFrame:
    return _tsdf(spark, d, "mean")


@query("WITH p AS (SELECT p_partkey, p_partkey % 640 AS u, p_size AS v, p_retailprice / 200e0 AS depth FROM part) SELECT p_partkey, (u - 320e0) * depth / 500e0 AS x, (v - 24e1) * depth / 500e0 AS y, depth AS z FROM p WHERE depth > 1e-1 AND depth < 10e0")
def depth_unproject(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 640).alias("u"), F.col("p_size").alias("v"), (F.col("p_retailprice") / 200.0).alias("depth"))
    return voxel.unproject(pixels, 500.0, 500.0, 320.0, 240.0).select("p_partkey", "x", "y", "z")


@query("SELECT vec_id, CAST(k AS BIGINT) AS point_id, CAST(embedding[3 * k + 1] AS DOUBLE) AS x, CAST(embedding[3 * k + 2] AS DOUBLE) AS y, CAST(embedding[3 * k + 3] AS DOUBLE) AS z FROM embeddings, range(2) AS r(k)")
def point_cloud_bytes(spark: SparkSession, d: str) -> DataFrame:
    def packed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "data": [struct.pack("<ffff", *e[:3], 0.0) + struct.pack("<ffff", *e[3:6], 0.0) for e in pdf["embedding"]]})

    clouds = table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(packed, "vec_id bigint, data binary")
    return readers.point_cloud2(clouds, "vec_id", step=16)


# ---- kinematics

ARM = [(1.0, 0.0, 0.0, 0.0)] * 3
ANGLES = f"{DIMS}, a AS (SELECT vec_id, x AS a1, x + y AS a2, x + y + z AS a3, x, y, z FROM p)"


def joints(spark: SparkSession, d: str) -> DataFrame:
    return dims(spark, d).select("vec_id", F.array("x", "y", "z").alias("q"))


POSED = [("x", "cos(a1) + cos(a2) + cos(a3)"), ("y", "sin(a1) + sin(a2) + sin(a3)"), ("z", "0e0"), ("qx", "0e0"), ("qy", "0e0"), ("qz", "sin(a3 / 2)"), ("qw", "cos(a3 / 2)")]
FORWARD = f"WITH {ANGLES} SELECT vec_id, " + ", ".join(f"{sql_round(e)} AS {n}" for n, e in POSED) + " FROM a"


@query(FORWARD)
def forward_kinematics(spark: SparkSession, d: str) -> DataFrame:
    return kinematics.forward_kinematics(joints(spark, d), ARM).select("vec_id", *[rounded(f"pose.{n}").alias(n) for n, _ in POSED])


@query(FORWARD)
def convert_action_space(spark: SparkSession, d: str) -> DataFrame:
    return kinematics.convert_action_space(joints(spark, d), ARM, "cartesian").select("vec_id", *[rounded(f"pose.{n}").alias(n) for n, _ in POSED])


REACH = {1: ("cos(a1) + cos(a2) + cos(a3)", "sin(a1) + sin(a2) + sin(a3)"), 2: ("cos(a2) + cos(a3)", "sin(a2) + sin(a3)"), 3: ("cos(a3)", "sin(a3)")}
JACOBIAN = f"WITH {ANGLES} " + " UNION ALL ".join(f"SELECT vec_id, {j} AS joint, {sql_round(f'-({s})')} AS dx, {sql_round(c)} AS dy, 0e0 AS dz, 0e0 AS wx, 0e0 AS wy, 1e0 AS wz FROM a" for j, (c, s) in REACH.items())


def _jacobian_rows(df: DataFrame, n: int) -> DataFrame:
    rows = df.select("vec_id", "jacobian", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("joint"))
    return rows.select("vec_id", "joint", *[rounded(F.element_at(F.element_at("jacobian", i + 1), F.col("joint")), n).alias(c) for i, c in enumerate(("dx", "dy", "dz", "wx", "wy", "wz"))])


@query(JACOBIAN)
def jacobian(spark: SparkSession, d: str) -> DataFrame:
    return _jacobian_rows(kinematics.jacobian(joints(spark, d), ARM), 9)


@query(f"WITH {ANGLES}, j AS ({' UNION ALL '.join(f'SELECT vec_id, {j} AS joint, -({s}) AS dx, {c} AS dy FROM a' for j, (c, s) in REACH.items())}) SELECT vec_id, joint, true AS near, 0e0 AS wz FROM j")
def jacobian_numeric(spark: SparkSession, d: str) -> DataFrame:
    exact = _jacobian_rows(kinematics.jacobian(joints(spark, d), ARM), 12).select("vec_id", "joint", F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    near = (F.abs(F.col("dx") - F.col("ex")) < 1e-4) & (F.abs(F.col("dy") - F.col("ey")) < 1e-4)
    return _jacobian_rows(kinematics.jacobian(joints(spark, d), ARM, method="numeric"), 12).join(exact, ["vec_id", "joint"]).select("vec_id", "joint", near.alias("near"), "wz")


@query("SELECT vec_id, true AS reached FROM embeddings")
def inverse_kinematics(spark: SparkSession, d: str) -> DataFrame:
    goals = kinematics.forward_kinematics(joints(spark, d), ARM).withColumn("q0", F.array(F.lit(0.1), F.lit(0.2), F.lit(0.1)))
    solved = kinematics.inverse_kinematics(goals, ARM).drop("pose")
    again = kinematics.forward_kinematics(solved, ARM).withColumnRenamed("pose", "got")
    both = again.select("vec_id", "got", "distance").join(goals.select("vec_id", "pose"), "vec_id")
    gap = F.sqrt(sum((F.pow(F.col(f"got.{a}") - F.col(f"pose.{a}"), 2) for a in "xyz"), F.lit(0.0)))
    return both.select("vec_id", ((gap < 1e-3) & (F.col("distance") < 1e-3)).alias("reached"))


@query("SELECT vec_id, true AS met FROM embeddings")
def joint_velocity(spark: SparkSession, d: str) -> DataFrame:
    q = kinematics.jacobian(joints(spark, d), ARM)
    twist = F.transform("jacobian", lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + x))  # of unit joint velocities
    out = kinematics.cartesian_to_joint_velocity(q.withColumn("v", twist), ARM)
    got = F.transform("jacobian", lambda row: F.aggregate(F.zip_with(row, F.col("dq"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    return out.select("vec_id", F.forall(F.zip_with(got, F.col("v"), lambda a, b: F.abs(a - b) < 1e-6), lambda x: x).alias("met"))


PATH = ", ".join(f"{sql_round(f'a{i} + (b{i} - a{i}) * t')} AS q{i}" for i in (1, 2, 3))


@query(f"WITH p AS (SELECT vec_id, k / 2e1 AS t, {', '.join(f'CAST(embedding[{i}] AS DOUBLE) AS a{i}, CAST(embedding[{i + 3}] AS DOUBLE) AS b{i}' for i in (1, 2, 3))} FROM embeddings, range(20) AS r(k)) SELECT vec_id, {sql_round('t')} AS t, {PATH} FROM p")
def joint_path(spark: SparkSession, d: str) -> DataFrame:
    moves = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("start"), F.slice("embedding", 4, 3).alias("goal"))
    out = kinematics.joint_path(moves, ["vec_id"], 1.0, 20.0)
    return out.select("vec_id", rounded("t").alias("t"), *[rounded(F.get("q", F.lit(i))).alias(f"q{i + 1}") for i in range(3)])


# ---- episodes


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))


PLACED = "p AS (SELECT conv_id, turn, role, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), "
PLACED += "c AS (SELECT *, CAST(place // 4 AS INTEGER) AS chunk, CAST(place % 4 AS INTEGER) AS step_in_chunk FROM p WHERE n < 4 OR place < (n // 4) * 4)"


@query(f"WITH {PLACED} SELECT conv_id, turn, chunk, step_in_chunk FROM c")
def episode_chunks(spark: SparkSession, d: str) -> DataFrame:
    return episodes.chunks(turns(spark, d), "conv_id", "turn", 4).select("conv_id", "turn", "chunk", F.col("step_in_chunk").cast("int").alias("step_in_chunk"))


FILLED = f"{PLACED}, f AS (SELECT conv_id, turn, chunk, step_in_chunk, false AS padded, size FROM c UNION ALL SELECT conv_id, turn, chunk, CAST(r.k AS INTEGER), true, size FROM c, range(4) AS r(k) WHERE n < 4 AND place = n - 1 AND r.k > place)"


@query(f"WITH {FILLED} SELECT conv_id, turn, chunk, step_in_chunk, padded FROM f")
def episode_pad(spark: SparkSession, d: str) -> DataFrame:
    out = episodes.padded(episodes.chunks(turns(spark, d), "conv_id", "turn", 4), "conv_id", 4)
    return out.select("conv_id", "turn", "chunk", "step_in_chunk", "padded")


@query(f"WITH {FILLED} SELECT conv_id, chunk, CAST(count(*) AS INTEGER) AS length, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY step_in_chunk) AS turns, string_agg(CAST(size AS VARCHAR), ',' ORDER BY step_in_chunk) AS sizes FROM f GROUP BY conv_id, chunk")
def episode_stack(spark: SparkSession, d: str) -> DataFrame:
    out = episodes.padded(episodes.chunks(turns(spark, d), "conv_id", "turn", 4), "conv_id", 4)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return episodes.stacked(out, ["conv_id", "chunk"], "step_in_chunk", ["turn", "size"]).select("conv_id", "chunk", "length", text("turn").alias("turns"), text("size").alias("sizes"))


@query("WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT vec_id, CAST(k // 32 AS BIGINT) AS batch, CAST(k % 32 AS BIGINT) AS place FROM p")
def collate_batches(spark: SparkSession, d: str) -> DataFrame:
    return episodes.shuffled_batches(table(spark, d, "embeddings").select("vec_id"), ["vec_id"], 32, train=False)


@query()
def collate_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return episodes.shuffled_batches(table(spark, d, "embeddings").select("vec_id"), ["vec_id"], 32, seed=7)


RAGGED = """WITH s AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS total, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
m AS (SELECT *, max(n) OVER (PARTITION BY conv_id // 8) AS m FROM s)
SELECT conv_id, CAST(n AS INTEGER) AS length, CAST(total AS BIGINT) AS total, text || repeat(',0', CAST(m - n AS INTEGER)) AS sizes FROM m"""


@query(RAGGED)
def ragged_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = episodes.stacked(turns(spark, d), ["conv_id"], "turn", ["size"]).drop("length").withColumn("batch", F.expr("conv_id div 8"))
    out = episodes.ragged_pad(rows, ["batch"], "size")
    return out.select("conv_id", "length", F.aggregate("size", F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"), F.array_join(F.col("size").cast("array<string>"), ",").alias("sizes"))


MULTIRATE = f"WITH {EV}, {sql_grid(step=DAY, n=30)}, {sql_between('a', sql_stream('view'))}, {sql_between('b', sql_stream('click'))}, {sql_between('c', sql_stream('purchase'))}"
MULTIRATE += " SELECT a.user_id, a.t, a.value AS vision, b.value AS actions, c.value AS proprio, a.value AS f0, c.value AS f1 FROM a JOIN b ON a.user_id = b.user_id AND a.t = b.t JOIN c ON a.user_id = c.user_id AND a.t = c.t"


@query(MULTIRATE)
def multirate_episode(spark: SparkSession, d: str) -> DataFrame:
    names = {"view": "vision", "click": "actions", "purchase": "proprio"}
    samples = events(spark, d).where(F.col("event_type").isin(*names)).replace(names, subset=["event_type"]).withColumnRenamed("event_type", "stream")
    out = episodes.multirate(samples, grid(spark, d, step=DAY, n=30), "user_id")
    return out.select("user_id", "t", "vision", "actions", "proprio", F.get("fused", F.lit(0)).alias("f0"), F.get("fused", F.lit(1)).alias("f1"))


@query("SELECT CAST(conv_id AS VARCHAR) AS episode_id, CAST(turn AS INTEGER) AS step_idx, 0e0 AS reward, turn > 2 AS is_terminal, CASE WHEN role = 'user' THEN role ELSE '' END AS language_instruction, length(text) / 255e0 AS rgb, CAST(turn AS DOUBLE) AS proprio FROM conversations")
def parse_steps(spark: SparkSession, d: str) -> DataFrame:
    raw = turns(spark, d).select(
        F.col("conv_id").alias("episode_id"),
        F.col("turn").alias("step_idx"),
        F.lit(None).cast("double").alias("reward"),
        (F.col("turn") > 2).alias("is_terminal"),
        F.when(F.col("role") == "user", F.col("role")).alias("language_instruction"),
        F.create_map(F.lit("rgb"), F.array(F.col("size").cast("double")), F.lit("state"), F.array(F.col("turn").cast("double"))).alias("observation"),
    )
    out = episodes.parsed_steps(raw)
    return out.select("episode_id", "step_idx", "reward", "is_terminal", "language_instruction", F.get(F.col("observation")["rgb"], F.lit(0)).alias("rgb"), F.get(F.col("observation")["proprio"], F.lit(0)).alias("proprio"))


@query("SELECT CAST(conv_id AS VARCHAR) AS episode_id, coalesce(arg_min(role, turn) FILTER (WHERE turn > 1), '') AS language_instruction FROM conversations GROUP BY conv_id")
def episode_language(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    own = t.select(F.col("conv_id").cast("string").alias("episode_id")).distinct().withColumn("language_instruction", F.lit(None).cast("string"))
    steps = t.select(F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").alias("step_idx"), F.when(F.col("turn") > 1, F.col("role")).alias("language_instruction"))
    return episodes.with_language(own, steps)


@query()
def image_resize(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    out = episodes.resized(images, "pixels", "h", "w", (4, 4))
    return out.select("vec_id", "h", "w", F.size("pixels").alias("n"), rounded(F.get("pixels", F.lit(5)), 6).alias("p5"))


# ---- attention

CODE = ", ".join(f"{sql_round(f'embedding[{i + 1}] + {('sin' if i % 2 == 0 else 'cos')}(label * exp(-(ln(1e4) / 8e0) * {i - i % 2}))', 6)} AS p{i}" for i in range(4))


@query(f"SELECT vec_id, {CODE} FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) AS e")
def positional_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 8).alias("values"))
    out = attention.positional_encoding(rows, "label", "values", 8)
    return out.select("vec_id", *[rounded(F.get("values", F.lit(i)), 6).alias(f"p{i}") for i in range(4)])


@query("SELECT label, " + ", ".join(f"{sql_round(f'avg(CAST(embedding[{i + 1}] AS DOUBLE))')} AS m{i}" for i in range(4)) + " FROM embeddings GROUP BY label")
def temporal_pool(spark: SparkSession, d: str) -> DataFrame:
    out = attention.temporal_pool(table(spark, d, "embeddings"), ["label"], "embedding", 4)
    return out.select("label", *[rounded(F.get("pooled", F.lit(i))).alias(f"m{i}") for i in range(4)])


@query()
def attention_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.expr("vec_id div 50").alias("sequence"), (F.col("vec_id") % 50).alias("place"), F.slice("embedding", 1, 16).alias("vision"), F.slice("embedding", 17, 8).alias("lidar"), F.slice("embedding", 25, 4).alias("proprio"))
    model = attention.Fusion.seeded({"vision": 16, "lidar": 8, "proprio": 4}, d_model=32, layers=2, heads=4, forward=64)
    out = attention.temporal_fusion(rows, model, "sequence", "place")
    return out.select("sequence", "place", F.size("features").alias("n"), rounded(F.get("features", F.lit(0)), 6).alias("f0"))


# ---- augmentation


@query()
def augment_proprio(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 7).alias("values"))
    return augment.proprio(rows, "vec_id", seed=3).select("vec_id", rounded(F.get("values", F.lit(0))).alias("v0"), F.size("values").alias("n"))


@query()
def augment_lidar(spark: SparkSession, d: str) -> DataFrame:
    return augment.lidar(dims(spark, d), ["vec_id"], seed=3).select("vec_id", "x", "y", "z")


@query()
def augment_vision(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return augment.vision(images, "vec_id", seed=3, batch="label", height="h", width="w").select("vec_id", F.size("pixels").alias("n"), rounded(F.get("pixels", F.lit(0))).alias("p0"))


# ---- measures

COMPARED = f"WITH {EV}, {sql_grid()}, {sql_between('a', 'ev')}, {sql_between('b', 'ev', linear=True)}, p AS (SELECT a.user_id, a.t, a.value AS x, b.value AS y FROM a JOIN b ON a.user_id = b.user_id AND a.t = b.t WHERE a.value IS NOT NULL AND b.value IS NOT NULL), o AS (SELECT *, abs(x - y) AS gap, abs(x - y) > 1e-5 AND abs(x - y) > 1e-4 * abs(y) AS off FROM p)"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(align.resample(events(spark, d), grid(spark, d), ["user_id"], extrapolate=x) for x in ("clamp", "linear"))


@query(f"{COMPARED} SELECT count(*) AS n, {sql_round('max(gap)', 6)} AS max_error, {sql_round('avg(gap)', 6)} AS mean_error, {sql_round('sqrt(avg(gap * gap))', 6)} AS rms_error, count_if(off)::BIGINT AS mismatches, {sql_round('count_if(off) / count(*)')} AS mismatch_rate FROM o")
def accuracy_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.accuracy(*_two(spark, d), ["user_id", "t"])
    return out.withColumns({c: rounded(c, 6) for c in ("max_error", "mean_error", "rms_error")}).withColumn("mismatch_rate", rounded("mismatch_rate"))


@query(f"{COMPARED} SELECT user_id, t, {sql_round('x', 6)} AS got, {sql_round('y', 6)} AS want FROM o WHERE off")
def tolerance_compare(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tolerance_compare(*_two(spark, d), ["user_id", "t"]).withColumns({c: rounded(c, 6) for c in ("got", "want")})


TIMES = "t AS (SELECT event_type AS operation, value AS d, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), "
TIMES += "q AS (SELECT operation, max(d) FILTER (WHERE k = CAST(floor(n * 5e-1) AS BIGINT)) AS p50, max(d) FILTER (WHERE k = least(n - 1, CAST(floor(n * 99e-2) AS BIGINT))) AS p99, avg(d) AS mean, stddev_samp(d) AS std, max(n) AS n FROM t GROUP BY operation)"


def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"), "user_id")


@query(f"SELECT event_type AS operation, count(*) AS n, min(value) AS min, max(value) AS max, {sql_round('avg(value)', 6)} AS mean, {sql_round('sum(value)', 4)} AS total FROM events GROUP BY event_type")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_stats(durations(spark, d)).withColumns({"mean": rounded("mean", 6), "total": rounded("total", 4)})


@query(f"WITH {TIMES} SELECT operation, p50, p99, n, {sql_round('mean', 6)} AS mean, {sql_round('std', 6)} AS std, {sql_round('std / mean * 100', 6)} AS cv_percent, {sql_round('196e-2 * std / sqrt(n)', 6)} AS ci95 FROM q")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_percentiles(durations(spark, d)).withColumns({c: rounded(c, 6) for c in ("mean", "std", "cv_percent", "ci95")})


@query(f"WITH {TIMES}, b AS (SELECT min(p50) AS base_p50, min(p99) AS base_p99 FROM q) SELECT q.operation, q.p50, q.p99, q.p50 <= b.base_p50 * 105e-2 AND q.p99 <= b.base_p99 * 11e-1 AS passed FROM q, b")
def perf_gate(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.latency_percentiles(durations(spark, d))
    best = found.agg(F.min("p50").alias("p50"), F.min("p99").alias("p99"))
    baseline = found.select("operation").crossJoin(F.broadcast(best))  # one row
    return metrics.perf_gate(found, baseline).select("operation", "p50", "p99", "passed")


@query(f"SELECT count(*) AS n, {sql_round('avg(CASE WHEN o_orderstatus = $$F$$ THEN 1e0 ELSE 0e0 END)')} AS success_rate, {sql_round('avg(CASE WHEN o_orderstatus = $$F$$ THEN 1e5 / greatest(o_totalprice, 1e5) ELSE 0e0 END)')} AS spl FROM orders")
def spl(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("success"), F.lit(1e5).alias("shortest"), F.col("o_totalprice").alias("path"))
    return metrics.spl(runs).withColumns({c: rounded(c) for c in ("success_rate", "spl")})


@query(f"WITH s AS (SELECT event_type AS operation, avg(value) AS m, max(value) AS x FROM events GROUP BY event_type) SELECT operation, {sql_round('x', 6)} AS a, {sql_round('m', 6)} AS b, {sql_round('x / m', 6)} AS speedup, {sql_round('(x - m) / 36e5 * 2', 9)} AS cost_saved FROM s")
def ab_compare(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.latency_stats(durations(spark, d))
    out = metrics.ab_compare(s.withColumn("v", F.col("max")), s.withColumn("v", F.col("mean")), ["operation"], "v", 2.0)
    return out.withColumns({c: rounded(c, 6) for c in ("a", "b", "speedup")}).withColumn("cost_saved", rounded("cost_saved"))


@query("WITH s AS (SELECT event_type AS operation, count(*) AS n, max(value) AS max FROM events GROUP BY event_type) SELECT operation, max <= 1e2 AS ok_max, n >= 2000 AS ok_n, max <= 1e2 AND n >= 2000 AS accepted FROM s")
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.acceptance(metrics.latency_stats(durations(spark, d)), {"max": ("max", 100.0), "n": ("min", 2000)})
    return out.select("operation", "ok_max", "ok_n", "accepted")


@query("SELECT user_id AS iteration, max(value) AS duration_ms FROM events GROUP BY user_id")
def slowest_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.slowest_rank(durations(spark, d).withColumnRenamed("user_id", "iteration"))


# ---- sizes and splits


@query("SELECT 32 AS per_chunk, 4 AS chunks, 4 AS last")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    p = planning.chunk_plan(100, 10, 400, 0.8)
    return spark.createDataFrame([tuple(p.values())], "per_chunk int, chunks int, last int")


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT c_custkey, CAST(c_custkey // CAST(ceil(n / 4e0) AS BIGINT) AS INTEGER) AS part FROM customer, n")
def split_batch(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("i"))
    return planning.split_batch(c, "i", c.count(), 4).select("c_custkey", "part")


@query("WITH n AS (SELECT count(*) AS n FROM customer), b AS (SELECT r, (r * n) // 3 AS lo, ((r + 1) * n) // 3 AS hi FROM n, range(3) AS s(r)) SELECT c_custkey, CAST(r AS INTEGER) AS rank FROM customer JOIN b ON c_custkey >= lo AND c_custkey < hi")
def rank_slices(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("i"))
    return planning.rank_slices(c, "i", c.count(), 3).select("c_custkey", "rank")


@query(sql_voxels("1 AS occupied"))
def merge_grids(spark: SparkSession, d: str) -> DataFrame:
    flags = [r[0] for r in table(spark, d, "lineitem").select("l_returnflag").distinct().orderBy("l_returnflag").collect()]  # three flags
    parts = [voxel.voxelize(lines(spark, d).where(F.col("l_returnflag") == f), "occupancy", **OF_LINES) for f in flags]
    return planning.merge_grids(parts, voxel.VOXEL)


# ---- streams


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    raw = replay.source(spark, d, "events", table(spark, d, "events").schema)
    return raw.select("event_id", "user_id", F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("SELECT user_id, event_type AS stream, epoch_us(max(ts)) AS t, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type")
def streaming_hold_last(spark: SparkSession, d: str) -> DataFrame:
    out = replay.run(streaming.hold_last(event_stream(spark, d), ["user_id", "stream"], "ts", ["value"]), "complete")
    return out.select("user_id", "stream", F.unix_micros("ts").alias("t"), "value")


@query("SELECT epoch_us(date_trunc('day', ts)) AS start, event_type AS stream, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def streaming_latest(spark: SparkSession, d: str) -> DataFrame:
    out = replay.run(streaming.latest_per_window(event_stream(spark, d), ["stream"], "ts", ["value"], "1 day", "3650 days"), "complete")
    return out.select(F.unix_micros("start").alias("start"), "stream", "value")


@query("SELECT epoch_us(date_trunc('day', ts)) AS start, event_type AS stream, CAST(floor((value - 0e0) / 5e1) AS INTEGER) AS vx, CAST(user_id % 4 AS INTEGER) AS vy, 0 AS vz, count(*) AS n FROM events WHERE floor(value / 5e1) >= 0 AND floor(value / 5e1) < 4 GROUP BY ALL")
def streaming_voxel(spark: SparkSession, d: str) -> DataFrame:
    points = event_stream(spark, d).select("stream", "ts", F.col("value").alias("x"), (F.col("user_id") % 4 * 50).cast("double").alias("y"), F.lit(0.0).alias("z"))
    out = replay.run(streaming.voxelize(points, "stream", "ts", "3650 days", "1 day", grid_min=0.0, voxel_size=50.0, grid_size=4), "complete")
    return out.select(F.unix_micros("start").alias("start"), "stream", "vx", "vy", "vz", "n")


@query(TSDF.format(sql_round("arg_min(v, (abs(v), vec_id))")))
def streaming_tsdf(spark: SparkSession, d: str) -> DataFrame:
    raw = replay.source(spark, d, "embeddings", table(spark, d, "embeddings").schema)
    points = raw.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias("xyz"[i]) for i in range(3)], F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    out = replay.run(voxel.tsdf(points, 0.15, -0.4, 0.1, 8, "label", "vec_id", ("nx", "ny", "nz")), "complete")
    return out.withColumn("tsdf", rounded("tsdf"))


LIVE = f"""WITH {EV}, b AS (SELECT user_id, event_type, min(t) AS lo, max(t) AS hi FROM ev WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id, event_type),
u AS (SELECT user_id, CAST(ceil(min(lo) / {6 * HOUR}e0) AS BIGINT) * {6 * HOUR} AS lo, min(hi) AS hi FROM b GROUP BY user_id HAVING count(*) = 3),
g AS (SELECT user_id, unnest(range(lo, hi + 1, {6 * HOUR})) AS t FROM u), """ + ", ".join(sql_between(n, sql_stream(k)) for n, k in (("a", "view"), ("b2", "click"), ("c", "purchase")))
LIVE += f' SELECT a.user_id, a.t, {sql_round("a.value")} AS "view", {sql_round("b2.value")} AS click, {sql_round("c.value")} AS purchase FROM a JOIN b2 ON a.user_id = b2.user_id AND a.t = b2.t JOIN c ON a.user_id = c.user_id AND a.t = c.t'


@query(LIVE)
def streaming_fuse(spark: SparkSession, d: str) -> DataFrame:
    rows = event_stream(spark, d).where(F.col("stream").isin(*STREAMS))
    out = replay.run(streaming.fuse(rows, "user_id", "ts", STREAMS, 6 * HOUR, "3650 days", capacity={k: 1_000_000 for k in STREAMS}))
    return out.select("user_id", "t", *[rounded(k).alias(k) for k in STREAMS])


@query()
def streaming_fuse_hold(spark: SparkSession, d: str) -> DataFrame:
    rows = event_stream(spark, d).where(F.col("stream").isin(*STREAMS))
    return replay.run(streaming.fuse(rows, "user_id", "ts", STREAMS, 6 * HOUR, "3650 days", least={"view": 2, "click": 2}, hold=True))


SEEN = """WITH k AS (SELECT user_id, ts AS tick, event_id FROM events WHERE event_type = 'purchase')
SELECT k.user_id, epoch_us(k.tick) AS tick, arg_max(e.value, e.ts) AS value FROM k JOIN events AS e ON e.user_id = k.user_id AND e.event_type = 'view' AND e.ts <= k.tick - INTERVAL 1 HOUR AND e.ts >= k.tick - INTERVAL 1 HOUR - INTERVAL 2 DAY GROUP BY k.user_id, k.tick"""


@query(SEEN)
def streaming_latency(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d)
    joined = streaming.observe_late(e.where("stream = 'view'"), e.where("stream = 'purchase'"), "user_id", "1 hour", "2 days", "1 hour")
    return replay.run(joined).groupBy("user_id", F.unix_micros("tick_ts").alias("tick")).agg(F.max_by("value", "sample_ts").alias("value"))
