"""Blocked scans and time-series operators against plain loops, with blocks far smaller than a series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavelens.operators import resample, smoothing, telemetry as tl, trajectory as tr
from pavelens.operators.blocks import Steps, index_rows, scan, series


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for sid, n in (("hot", 300), ("small", 5), ("one", 1)):
        out += [(sid, i * 3, rng.random() if rng.random() < 0.6 else None) for i in range(n)]
    return out


def test_scan_crosses_block_borders(spark, rows):
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    got = scan(
        df, series("k", "i", 40), lags={"p": F.col("v")}, leads={"n": F.col("v")}, sums={"s": F.coalesce("v", F.lit(0.0))},
        mins={"m": F.col("v")}, fills={"f": F.col("v")}, befores={"b": F.col("v")}, next_fills={"g": F.col("v")}, number="at",
        totals={"c": ("count", F.col("v")), "first": ("first", F.col("i")), "last": ("last", F.col("i"))},
    ).collect()
    by = {(r["k"], r["i"]): r for r in got}
    assert len(by) == len(rows)
    for k in {r[0] for r in rows}:
        vs = [r for r in rows if r[0] == k]
        total, low, fill = 0.0, None, None
        for j, (_, i, v) in enumerate(vs):
            r = by[(k, i)]
            before = fill
            if v is not None:
                total, low, fill = total + v, v if low is None else min(low, v), v
            ahead = next((x[2] for x in vs[j:] if x[2] is not None), None)
            assert r["at"] == j and r["p"] == (vs[j - 1][2] if j else None)
            assert r["n"] == (vs[j + 1][2] if j + 1 < len(vs) else None)
            assert math.isclose(r["s"], total, abs_tol=1e-9) and r["m"] == low
            assert (r["f"], r["b"], r["g"]) == (fill, before, ahead)
            assert r["c"] == sum(x[2] is not None for x in vs) and r["first"] == 0 and r["last"] == vs[-1][1]


def test_index_rows_is_dense_for_text_order(spark):
    names = [("a", f"f{(i * 7919) % 1009:05d}") for i in range(500)] + [("b", "x"), ("b", "c")]
    got = index_rows(spark.createDataFrame(names, "k string, name string").repartition(4), "k", "name").collect()
    for k in "ab":
        want = sorted(n for kk, n in names if kk == k)
        assert [r["name"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["pos"])] == want
        assert sorted(r["pos"] for r in got if r["k"] == k) == list(range(len(want)))


def _haversine(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6378137.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _greedy(track):
    if len(track) < 3:
        return [x[1] for x in track]
    kept = [track[0]]
    for cur in track[1:]:
        dt = cur[2] - kept[-1][2]
        if dt <= 0:
            continue
        v = _haversine(kept[-1][3], kept[-1][4], cur[3], cur[4]) / dt
        if v > 1.0 and abs(v - cur[5]) > 8.0:
            continue
        kept.append(cur)
    return [x[1] for x in (kept if len(kept) >= 2 else track)]


@pytest.mark.parametrize("width", [60.0, 1000.0])
def test_outlier_filter_equals_sequential_pass(spark, width):
    rng = random.Random(11)
    rows = []
    for sid, n in ((1, 250), (2, 2), (3, 3), (4, 60)):
        lat = -32.0
        for i in range(n):
            lat += 1e-4 if sid != 4 else 0.01
            jump = 0.02 if rng.random() < 0.2 else 0.0
            rows.append((sid, i, float(i if rng.random() > 0.05 else max(i - 1, 0)), lat + jump, 151.0, 11.0))
    got = tl.drop_speed_outliers(
        spark.createDataFrame(rows, "session_id long, seq long, time_sec double, lat double, lon double, speed double"), width=width
    ).collect()
    for sid in (1, 2, 3, 4):
        track = sorted((r for r in rows if r[0] == sid), key=lambda r: (r[2], r[1]))
        assert sorted(r["seq"] for r in got if r["session_id"] == sid) == sorted(_greedy(track))


@pytest.mark.parametrize("mode", ["nearest", "reflect"])
@pytest.mark.parametrize("n", [4, 60])
def test_gaussian_equals_direct_sum(spark, mode, n):
    rng = np.random.default_rng(n)
    x = rng.random(n)
    sigma, r = 4.0, 16
    idx = np.arange(-r, n + r)
    if mode == "nearest":
        idx = np.clip(idx, 0, n - 1)
    else:
        idx = np.mod(idx, 2 * n)
        idx = np.where(idx < n, idx, 2 * n - 1 - idx)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    want = np.convolve(x[idx], w / w.sum(), "valid")
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    got = smoothing.gaussian_smooth(df, series("k", "i", 7), ["v"], sigma, mode, chunk=10).orderBy("i").collect()
    assert np.allclose([g["v"] for g in got], want)


def test_distance_sampling_equals_accumulator(spark):
    rng = random.Random(5)
    fps, interval = 30.0, 2.0
    frames = [("s", i, i / fps, rng.uniform(-2, 30)) for i in range(400)]
    dist, last, want = 0.0, 0.0, []
    for _, i, t, v in frames:
        dist += max(0.0, v) * (t - last)
        last = t
        if i == 0:
            dist = 0.0
            want.append(i)
        elif dist >= interval:
            dist -= interval * max(1, int(dist // interval))
            want.append(i)
    df = spark.createDataFrame(frames, "k string, i long, time_sec double, speed double")
    got = tr.sample_by_distance(df, series("k", "i", 50), interval).orderBy("i").collect()
    assert [r["i"] for r in got] == want


def test_rate_sampling_with_gaps(spark):
    rng = random.Random(9)
    frames = sorted(rng.sample(range(500), 200))
    for interval in (0.7, 2.5, 9.0):
        want, k = [], 0
        for f in frames:
            if f >= int(k * interval):
                want.append((f, k))
                k += 1
        df = spark.createDataFrame([("s", f) for f in frames], "k string, f long")
        got = tr.sample_by_rate(df, series("k", "f", 60), "f", interval).orderBy("f").collect()
        assert [(r["f"], r["extract_index"]) for r in got] == want


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan") + plan.count("Scan ExistingRDD")


def test_series_operators_read_their_input_a_few_times(spark, tmp_path):
    rows = [(k % 3, i, i * 0.5, -32.0 + i * 1e-5, 151.0, 2.0, float(i), 0.0) for k in range(3) for i in range(50)]
    path = str(tmp_path / "frames")
    spark.createDataFrame(rows, "k long, i long, t double, lat double, lon double, speed double, x double, y double").write.parquet(path)
    df, s = spark.read.parquet(path), series("k", "i", 20)
    samples = df.select(F.col("k").alias("session_id"), F.lit("GPS5").alias("stream"), F.col("i").alias("seq"), F.col("t").alias("time_sec"), F.array("lat", "lon", "speed", "speed").alias("data"))
    few = {
        "gps_health": tl.gps_health(samples), "arc_length": tr.arc_length(df, s, geodesic=True), "distance": tr.sample_by_distance(df, s, 5.0, time="t"),
        "rate": tr.sample_by_rate(df, s, "i", 2.5), "locations": tr.location_segments(df, s), "unwrap": smoothing.unwrap(df, s, "lat", "u"),
    }
    assert {n: _scans(d) for n, d in few.items() if _scans(d) > 2} == {}
    four = {
        "heading": tr.baseline_heading(df.withColumn("arc_m", F.col("x")), s), "pchip": resample.pchip_resample(df, df.select("k", (F.col("t") + 0.1).alias("t")), ["k"], "t", ["lat"]),
    }
    # besides the files they read a narrow table that they have written
    files = lambda d: d._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert {n: (files(d), _scans(d)) for n, d in four.items() if files(d) > 2 or _scans(d) > 8} == {}


@pytest.mark.parametrize("width", [1, 3, 10_000])
def test_steps_equal_a_loop(spark, width):
    rnd = random.Random(width)
    rows = [(k, i, rnd.choice([None, 1.0, 2.5, 7.0]), rnd.random()) for k in range(3) for i in range(60) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "k long, i long, v double, other double")
    at = F.when(F.col("v").isNotNull(), F.struct("v"))
    start = F.struct(F.lit(100.0).alias("v"))
    out = scan(df, series("k", "i", width), steps={"a": Steps(at, lambda p, q: F.abs(q["v"] - p["v"]), before="w"), "b": Steps(at, lambda p, q: q["v"] - p["v"], start)})
    got = {(r["k"], r["i"]): r for r in out.collect()}
    assert len(got) == len(rows) and set(out.columns) == {*df.columns, "a", "w", "b"}
    for k in range(3):
        a, b, last, was = 0.0, 0.0, None, None
        for key in sorted(x for x in got if x[0] == k):
            r = got[key]
            assert r["w"] == was
            if r["v"] is not None:
                a += abs(r["v"] - last) if last is not None else 0
                b += r["v"] - (last if last is not None else 100.0)
                last = r["v"]
            assert r["a"] == pytest.approx(a) and r["b"] == pytest.approx(b)
            was = r["a"]
