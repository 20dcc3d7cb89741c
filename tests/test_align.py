import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import align, grids

SOURCE = "series_id int, t double, value double"


def frames(spark, x, t, tau):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, x)], SOURCE), spark.createDataFrame([(1, float(v)) for v in tau], "series_id int, t double")


def values(df):
    return [r["value"] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize(
    ("x", "t", "tau", "want"),
    [
        ([1, 2, 3], [0, 0.5, 1], [0.25, 0.75], [1.5, 2.5]),
        ([0, 1, 2], [0, 0.5, 1], [0, 0.25, 0.5, 0.75, 1], [0, 0.5, 1, 1.5, 2]),
        (range(1, 11), range(1, 11), [0.5, 11], [1, 10]),
        ([7], [0], [-1, 0, 1], [7, 7, 7]),
    ],
)
def test_golden(spark, x, t, tau, want):
    assert values(align.resample(*frames(spark, x, t, tau), ["series_id"])) == pytest.approx(want)


def test_linear_ends(spark):
    got = values(align.resample(*frames(spark, [0, 1, 3], [0, 1, 2], [-1, 4]), ["series_id"], extrapolate="linear"))
    assert got == pytest.approx([-1, 7])


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 3, 40))
    x, tau = rng.normal(size=40), np.sort(np.concatenate([rng.uniform(-0.5, 3.5, 60), t[::7]]))
    assert values(align.resample(*frames(spark, x, t, tau), ["series_id"])) == pytest.approx(np.interp(tau, t, x).tolist())


def test_arrays_keep_order_and_missing_streams_are_null(spark):
    streams = {f"s{k}": spark.createDataFrame([(1, float(i), [float(k)] * k) for i in range(5)], "series_id int, t double, value array<double>") for k in (1, 2, 3)}
    targets = spark.createDataFrame([(1, 2.5), (2, 2.5)], "series_id int, t double")
    rows = {r["series_id"]: r["fused"] for r in align.fuse(streams, targets, ["series_id"], concat=True).collect()}
    assert rows == {1: [1.0, 2.0, 2.0, 3.0, 3.0, 3.0], 2: None}


def test_nulls_empty_and_duplicates(spark):
    source = spark.createDataFrame([(1, 0.0, None, 0), (1, 1.0, 5.0, 1), (1, 1.0, 9.0, 2)], "series_id int, t double, value double, k int")
    targets = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 2.0)], "series_id int, t double")
    assert values(align.resample(source, targets, ["series_id"], tie="k")) == [5.0, 5.0, 9.0]
    assert values(align.resample(source.limit(0), targets, ["series_id"], tie="k")) == [None] * 3
    assert not align.resample(source, targets.limit(0), ["series_id"], tie="k").count()


def test_errors(spark):
    source, targets = frames(spark, [1], [0], [0])
    with pytest.raises(ValueError, match="expected columns"):
        align.resample(source.drop("value"), targets, ["series_id"])
    with pytest.raises(ValueError, match="extrapolate"):
        align.resample(source, targets, ["series_id"], extrapolate="cubic")
    with pytest.raises(ValueError, match="expected numbers"):
        align.resample(source.withColumn("value", F.lit("a")), targets, ["series_id"])


def test_nearest_takes_the_earlier_of_two(spark):
    source, targets = frames(spark, [1, 2], [0, 1], [0.5, 0.6, -5])
    assert values(align.nearest_asof(source, targets, ["series_id"])) == [1.0, 1.0, 2.0]


def test_one_shuffle_for_all_streams(spark):
    s = {n: frames(spark, [1, 2], [0, 1], [0])[0] for n in "abc"}
    plan = align.fuse(s, frames(spark, [1], [0], [0.5])[1], ["series_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 2


def test_grids(spark):
    one = spark.createDataFrame([(1,)], "s int")
    assert [r["t"] for r in grids.grid_linspace(one, 0, 1, 5).collect()] == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    assert [r["t"] for r in grids.grid_rate(one, 0, 3, 50).collect()] == pytest.approx([0, 0.02, 0.04])


def test_strategies_agree_on_arrays(spark):
    rng = np.random.default_rng(5)
    source = spark.createDataFrame([(int(s), float(t), rng.normal(size=3).tolist()) for s in range(3) for t in np.sort(rng.random(12))], "series_id int, t double, value array<double>")
    targets = spark.createDataFrame([(int(s), float(t)) for s in range(4) for t in rng.uniform(-0.2, 1.2, 9)], "series_id int, t double")
    a, b = ({(r["series_id"], r["t"]): r["value"] for r in align.resample(source, targets, ["series_id"], strategy=k).collect()} for k in ("window", "arrow"))
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert (v is None and b[k] is None) or v == pytest.approx(b[k])


def test_buckets_change_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(s, float(t), float(rng.normal()), k) for s in range(2) for k, t in enumerate(np.repeat(rng.uniform(0, 40, 30), 2))]
    source = spark.createDataFrame(rows, "series_id int, t double, value double, k int")
    other = source.where("t < 5 or t > 30").drop("k").withColumn("k", F.lit(0)).dropDuplicates(["series_id", "t"])
    targets = spark.createDataFrame([(s, float(t)) for s in range(3) for t in rng.uniform(-5, 50, 40)], "series_id int, t double")
    whole, cut = ({tuple(r)[:2]: tuple(r)[2:] for r in align.fuse({"a": source, "b": other}, targets, ["series_id"], tie="k", bucket=b).collect()} for b in (None, 3.0))
    assert whole == cut
    with pytest.raises(ValueError, match="bucket"):
        align.resample(source, targets, ["series_id"], bucket=0)
