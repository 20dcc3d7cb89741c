import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrace.diagnostics import Config, Metrics, check_environment, health_check, self_test
from kinetrace.operators import attention, augment, episodes, kinematics, metrics, planning, voxel
from kinetrace.sources import readers
from kinetrace.streaming import operators as streaming


def cloud(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(rows)], "cloud_id int, point_id int, x double, y double, z double")


def test_voxel_golden(spark):
    same = cloud(spark, [(0, 0, 0), (0.01, 0.01, 0.01), (0.02, 0.02, 0.02)])
    assert [tuple(r) for r in voxel.voxelize(same, "count", grid_min=-10, voxel_size=0.5, grid_size=64).collect()] == [(20, 20, 20, 3)]
    far = cloud(spark, [(100, 100, 100), (-100, -100, -100), (50, 50, 50), (math.nan, 0, 0), (math.inf, 0, 0)])
    assert voxel.voxelize(far, "count", grid_min=-10, voxel_size=0.15625, grid_size=128).count() == 0
    faces = cloud(spark, [(0, 0, 0), (0.1, 0.1, 0.1), (3.2, 0, 0), (-0.01, 0, 0)])
    assert sorted(tuple(r)[:3] for r in voxel.voxelize(faces, grid_min=0, voxel_size=0.1, grid_size=32).collect()) == [(0, 0, 0), (1, 1, 1)]


def test_voxel_max_of_negatives(spark):
    points = cloud(spark, [(0, 0, 0), (0, 0, 0)]).withColumn("f", -F.col("point_id") - 1.0)
    one = lambda **k: voxel.voxelize(points, "max", ["f"], **k).first()["max_f"]
    assert one() == -1.0
    assert one(zero_floor=True) == 0.0


@pytest.mark.parametrize(("change", "what"), [({"voxel_size": -1.0}, "voxel_size"), ({"grid_size": 0}, "grid_size"), ({"mode": "median"}, "mode"), ({"mode": "mean"}, "features")])
def test_voxel_errors(spark, change, what):
    with pytest.raises(ValueError, match=what):
        voxel.voxelize(cloud(spark, [(0, 0, 0)]), **change)


def test_tsdf_sign_and_weight(spark):
    points = cloud(spark, [(0.05, 0.05, 0.05)]).withColumns({"nx": F.lit(1.0), "ny": F.lit(0.0), "nz": F.lit(0.0)})
    rows = {tuple(r)[1:4]: (r["tsdf"], r["weight"]) for r in voxel.tsdf(points, 0.15, 0.0, 0.1, 4, normals=("nx", "ny", "nz")).collect()}
    assert rows[(0, 0, 0)] == (pytest.approx(0.0, abs=1e-12), 1)
    assert rows[(1, 0, 0)][0] == pytest.approx(-2 / 3)
    assert rows[(0, 1, 0)][0] == pytest.approx(2 / 3)


def test_planar_arm(spark):
    joints = spark.createDataFrame([(0, [0.0, 0.0]), (1, [math.pi / 2, 0.0]), (2, None), (3, [1.0])], "id int, q array<double>")
    rows = {r["id"]: r["pose"] for r in kinematics.forward_kinematics(joints, [(1.0, 0, 0, 0)] * 2).collect()}
    assert list(rows[0]) == pytest.approx([2, 0, 0, 0, 0, 0, 1])
    assert list(rows[1]) == pytest.approx([0, 2, 0, 0, 0, math.sqrt(0.5), math.sqrt(0.5)], abs=1e-12)
    assert rows[2] is None or rows[2]["x"] is None or math.isnan(rows[2]["x"])


def test_quaternions_of_any_rotation():
    rng = np.random.default_rng(1)
    q = rng.normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    x, y, z, w = q.T
    m = np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], -1), np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], -1), np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], -1)], 1)
    got = kinematics.quaternions(m)
    assert np.abs((got * q).sum(1)) == pytest.approx(np.ones(200))


def test_augmentation_statistics_and_repeatability(spark):
    points = spark.range(20000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    a = augment.lidar(points, ["id"], seed=1)
    origin = a.where("x = 0 and y = 0 and z = 0").count() / 20000
    assert origin == pytest.approx(0.05 * 0.95, abs=0.01)
    near = a.where("abs(x - 1) < 0.1 and abs(y - 2) < 0.1").agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert near["m"] == pytest.approx(1, abs=0.002)
    assert near["s"] == pytest.approx(0.02, abs=0.002)
    assert sorted(a.collect()) == sorted(augment.lidar(points.repartition(7), ["id"], seed=1).collect())


def test_box_blur_counts_zeros_beyond_the_edge():
    got = augment.box_blur(np.ones((4, 4, 1)), 3)
    assert got[1, 1, 0] == pytest.approx(1)
    assert got[0, 0, 0] == pytest.approx(4 / 9)


def test_bilinear_identity_and_constant():
    x = np.arange(12.0).reshape(3, 4, 1)
    assert episodes.bilinear(x, 3, 4) == pytest.approx(x)
    assert episodes.bilinear(np.full((2, 2, 3), 5.0), 7, 5) == pytest.approx(np.full((7, 5, 3), 5.0))


def test_attention_is_causal_within_a_stream_and_repeatable():
    model = attention.Fusion.seeded({"vision": 4, "lidar": 3, "proprio": 2}, d_model=8, layers=1, heads=2, forward=16)
    rng = np.random.default_rng(0)
    args = [rng.normal(size=(5, w)) for w in (4, 3, 2)]
    assert model(*args) == pytest.approx(model(*args))
    x = rng.normal(size=(5, 8))
    y = x.copy()
    y[4] += 1
    assert attention.block(x, model.weights, "vision.0", 2)[:4] == pytest.approx(attention.block(y, model.weights, "vision.0", 2)[:4])


def test_plans():
    assert planning.chunk_plan(100, 10, 400, 0.8) == {"per_chunk": 32, "chunks": 4, "last": 4}
    assert planning.chunk_plan(0, 10, 400)["chunks"] == 0
    assert planning.would_not_fit(81, 100)


def test_percentiles_by_index(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 1.0)] * 3, "operation string, duration_ms double")
    got = {r["operation"]: (r["p50"], r["p99"]) for r in metrics.latency_percentiles(rows).collect()}
    assert got == {"a": (50.0, 99.0), "b": (1.0, 1.0)}


def test_record_files(spark, tmp_path):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    def feature(name, kind, payload):
        return field(1, field(1, name.encode()) + field(2, field(kind, payload)))

    body = field(1, feature("pos", 2, field(1, struct.pack("<2f", 1.5, 2.5))) + feature("n", 3, field(1, varint(300))) + feature("say", 1, field(1, "é".encode())))
    (tmp_path / "a.tfrecord").write_bytes((struct.pack("<QI", len(body), 0) + body + struct.pack("<I", 0)) * 2)
    (tmp_path / "b.tfrecord").write_bytes(struct.pack("<QI", 1000, 0) + b"short")
    rows = readers.read_tfrecords(spark, str(tmp_path)).orderBy("path", "record").collect()
    assert [(r["floats"], r["ints"], r["texts"]) for r in rows[:2]] == [({"pos": [1.5, 2.5]}, {"n": [300]}, {"say": ["é"]})] * 2
    assert "expected" in rows[2]["error"]


def test_exports_and_health(spark, tmp_path):
    m = Metrics()
    with m.timed("step"):
        m.count("n")
    stats = metrics.latency_stats(m.frame(spark))
    assert any(r["value"].startswith('kinetrace_n{operation="step"} 1') for r in readers.prometheus(stats).collect())
    assert health_check(spark)["status"] in ("healthy", "degraded")
    assert all(self_test(spark).values())
    assert "pyspark" in check_environment(spark)
    Config(tolerance=1e-3).save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")).tolerance == 1e-3


class State:
    """A key's state, as applyInPandasWithState hands it on."""

    hasTimedOut, exists = False, False

    def update(self, value):
        self.exists, self.get = True, value

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        pass


@pytest.mark.parametrize("hold", [False, True])
@pytest.mark.parametrize("size", [1000, 38])
def test_fuser_emits_before_samples_leave_full_buffers(hold, size):
    rows = pd.DataFrame([(s, t, float(t)) for t in range(0, 5000, 10) for s in ("a", "b")], columns=["stream", "t", "value"])
    run, state, got = streaming._fuser(("a", "b"), 5, {"a": 2}, {"a": 20, "b": 20}, "k", hold), State(), []
    for at in range(0, len(rows), size):
        got += [tuple(r) for p in run((7,), iter([rows[at : at + size]]), state) for r in p.itertuples(index=False)]
    assert got == [(7, t, t, t) for t in range(5, 4991, 5)]


@pytest.mark.parametrize("train", [True, False])
def test_batches_number_every_row_once(spark, monkeypatch, train):
    monkeypatch.setattr(episodes, "BUCKET", 5_000)
    samples = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_003).alias("k"), F.lit("x").alias("v"))
    out = episodes.shuffled_batches(samples, ["k"], 32, train=train, seed=3).withColumn("at", F.col("batch") * 32 + F.col("place")).cache()
    facts = out.agg(F.count("*"), F.countDistinct("at"), F.min("at"), F.max("at"), F.countDistinct("k")).first()
    assert tuple(facts) == (200_000, 200_000, 0, 199_999, 200_000)
    rising = out.selectExpr("at", "k", "lag(k) over (partition by at div 20000 order by at) < k as ok").where("ok is not null")
    assert rising.where("ok").count() == rising.count() if not train else 0.4 < rising.where("ok").count() / rising.count() < 0.6
