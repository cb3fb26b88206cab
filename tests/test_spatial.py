"""Spatial joins, graphs and polygons against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavelens.functions import camera as cam, geo, polygons as pg
from pavelens.operators import detection as dt, graph, grouping as gp, joins, passes as ps, points as pt
from pavelens.operators.points import exact_percentiles
from pavelens.session import cut


def _hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6378137.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_pass_candidates_near_pole_and_date_line(spark):
    rng = random.Random(1)
    rows = []
    for p, (la, lo) in {"line": (10.0, 180.0), "pole": (89.9999, 0.0), "flat": (-32.4, 151.7)}.items():
        for i in range(120):
            lon = lo + rng.uniform(-1, 1) * (40 if p == "pole" else 1e-4)
            lon = lon - 360 if lon > 180 else lon
            rows.append((p, i, la + rng.uniform(-1, 1) * 5e-5, lon))
    rows.append(("flat", 500, None, None))
    got = ps.repeat_pass_candidates(spark.createDataFrame(rows, "p string, frame_idx long, lat double, lon double"), ["p"]).collect()
    want = set()
    for p in ("line", "pole", "flat"):
        pts = [r for r in rows if r[0] == p and r[2] is not None]
        want |= {(p, a[1], b[1]) for a in pts for b in pts if b[1] - a[1] >= 15 and _hav(a[2], a[3], b[2], b[3]) <= 4.0}
    assert {(r["p"], r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 50


def test_salted_join_splits_hot_keys(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (800, "b"), (5, "c")], "k long, v string")
    got = joins.salted_join(left, right, ["k"], per_task=50)
    assert got.count() == left.join(right, "k").count() == 701
    assert joins.hot_keys(left.groupBy("k").count(), ["k"], "count", 50).first()["_splits"] == 14


def test_greedy_match_equals_scan(spark):
    rng = random.Random(4)
    pairs = [(g, a, b, round(rng.random(), 1)) for g in range(4) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.2]
    want = set()
    for g in range(4):
        used = set()
        for _, a, b, d in sorted((p for p in pairs if p[0] == g), key=lambda p: (p[3], p[1], p[2])):
            if a not in used and b not in used:
                used |= {a, b}
                want.add((g, a, b))
    got = graph.greedy_match(spark.createDataFrame(pairs, "g int, a long, b long, dist double"), ["g"]).collect()
    assert {(r["g"], r["a"], r["b"]) for r in got} == want


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(12)] + [(100, i) for i in range(101, 110)] + [(300, 200), (200, 250)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(13)) and all(got[i] == 100 for i in range(100, 110)) and got[300] == got[250] == 200


def test_polygon_measures():
    sq = ([0, 2, 2, 0], [0, 0, 2, 2])
    far = ([5, 6, 6, 5], [0, 0, 1, 1])
    inner = ([0.5, 1, 1, 0.5], [0.5, 0.5, 1, 1])
    ell = ([0, 4, 4, 1, 1, 0], [0, 0, 1, 1, 4, 4])
    assert pg._gap(*sq, *far) == 3.0 and pg._gap(*sq, *inner) == 0.0 and pg._gap(*sq, *sq) == 0.0
    assert abs(pg._similarity(*sq, *far) - 0.25) < 1e-12 and abs(pg._similarity(*sq, *sq) - 1) < 1e-12
    assert abs(pg._overlap(pg._edges(*sq), pg._edges(*ell)) - 3.0) < 1e-12
    rng = np.random.default_rng(0)
    for _ in range(5):
        t = np.sort(rng.random(7)) * 2 * np.pi
        a, b = (np.cos(t) * 2, np.sin(t)), (np.cos(t + 1) + 0.4, np.sin(t + 1) * 1.5)
        p = rng.uniform(-3, 3, (60000, 2))
        inside = lambda poly: np.array([((y0 > p[:, 1]) != (y1 > p[:, 1])) & (p[:, 0] < x0 + (p[:, 1] - y0) * (x1 - x0) / (y1 - y0 + 1e-300)) for x0, y0, x1, y1 in zip(*pg._edges(*poly))]).sum(0) % 2 == 1
        est = (inside(a) & inside(b)).mean() * 36
        assert abs(pg._overlap(pg._edges(*a), pg._edges(*b)) - est) < 0.15


def _drop_in_order(items, alike, d):
    active = list(items)
    while True:
        for i in range(len(active)):
            hit = next((j for j in range(i + 1, len(active)) if (active[i], active[j]) in alike), None)
            if hit is not None:
                active.pop(i if d[active[i]] > d[active[hit]] else hit)
                break
        else:
            return set(items) - set(active)


def test_dedupe_rule_equals_restarting_scan(spark):
    rng = random.Random(8)
    n = 24
    d = {i: float(rng.randint(0, 9)) for i in range(n)}
    alike = {(i, j) for i in range(n) for j in range(i + 1, min(n, i + 9)) if rng.random() < 0.3}
    rows = [(i, j, d[i], d[j]) for i, j in alike]
    lost = gp._visit(spark.createDataFrame(rows, "a long, b long, da double, db double"))
    assert {r["det_id"] for r in lost.collect()} == _drop_in_order(range(n), alike, d)


def _align(frames, gap=15, radius=4.0):
    lat0, lon0 = next((a, o) for _, a, o in frames if a is not None)
    R, c = 6378137.0, math.cos(math.radians(lat0))
    ok = [i for i, f in enumerate(frames) if f[1] is not None]
    xy = np.zeros((len(frames), 2))
    for i in ok:
        xy[i] = math.radians(frames[i][2] - lon0) * c * R, math.radians(frames[i][1] - lat0) * R
    for _ in range(5):
        pull = np.full((len(frames), 2), np.nan)
        for i in ok:
            near = [(np.hypot(*(xy[j] - xy[i])), j) for j in ok if j < i - gap]
            near = [x for x in near if x[0] <= radius]
            if near:
                pull[i] = xy[min(near)[1]] - xy[i]
        at = np.flatnonzero(~np.isnan(pull[:, 0]))
        if len(at) < 2:
            break
        drift = np.column_stack([np.interp(np.arange(len(frames)), at, pull[at, k], 0, 0) for k in (0, 1)])
        w = np.exp(-0.5 * (np.arange(-60, 61) / 15.0) ** 2)
        idx = np.mod(np.arange(-60, len(frames) + 60), 2 * len(frames))
        idx = np.where(idx < len(frames), idx, 2 * len(frames) - 1 - idx)
        xy = xy + np.column_stack([np.convolve(drift[idx, k], w / w.sum(), "valid") for k in (0, 1)])
    return [(lat0 + math.degrees(xy[i, 1] / R), lon0 + math.degrees(xy[i, 0] / (R * c))) if i in set(ok) else (None, None) for i in range(len(frames))]


def test_alignment_equals_direct_loop(spark):
    rng = random.Random(2)
    frames = []
    for lap in range(3):
        for k in range(40):
            frames.append((len(frames), -32.4 + k * 2e-5 + rng.gauss(0, 2e-6), 151.75 + lap * 1.2e-5 + rng.gauss(0, 2e-6)))
    frames[7] = (7, None, None)
    want = _align(frames)
    rows = [("p", *f) for f in frames] + [("tiny", i, -32.0, 151.0) for i in range(5)]
    got = ps.align_passes(spark.createDataFrame(rows, "p string, frame_idx long, lat double, lon double"), ["p"]).where("p = 'p'").orderBy("frame_idx").collect()
    for r, (la, lo) in zip(got, want):
        if la is None:
            assert r["lat"] is None
        else:
            assert abs(r["lat"] - la) < 1e-10 and abs(r["lon"] - lo) < 1e-10


def test_geo_and_pose_round_trips(spark):
    L = lambda v: F.lit(float(v))
    df = spark.range(50).select((F.rand(1) * 60 - 30).alias("x"), (F.rand(2) * 60 - 30).alias("z"), (F.rand(3) * 360).alias("h"), F.rand(4).alias("a"))
    g = geo.local_to_global(L(-32.4), L(151.7), F.col("h"), F.col("x"), F.col("z"))
    back = geo.global_to_local(L(-32.4), L(151.7), F.col("h"), g["lat"], g["lon"])
    r = cam.rodrigues_matrix(F.col("x"), F.col("a"), F.col("z"))
    eye = cam.matmul(r, cam.transpose(r))
    k = cam.intrinsics(F.col("a") * 100 + 1, L(400), L(3), L(4))
    ident = cam.matmul(k, cam.inverse(k))
    for row in df.select("x", "z", back.alias("b"), eye.alias("e"), ident.alias("i")).collect():
        assert abs(row["b"]["x"] - row["x"]) < 1e-5 and abs(row["b"]["z"] - row["z"]) < 1e-5
        assert np.allclose(row["e"], np.eye(3).ravel()) and np.allclose(row["i"], np.eye(3).ravel())


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.exponential(size=400).round(2)] + [("b", 2.0), ("b", None)]
    got = {r["k"]: r["p"] for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.01, 0.5, 0.98]).collect()}
    a = [v for k, v in rows if k == "a"]
    assert np.allclose(got["a"], np.percentile(a, [1, 50, 98])) and got["b"] == [2.0, 2.0, 2.0]


def test_nms_keeps_at_most_k(spark):
    rows = [(1, "c", i, i * 30, 0, 10, 10, 1 - i / 100) for i in range(6)] + [(1, "c", 10 + i, 0, 0, 10, 10, 0.6) for i in range(4)]
    det = spark.createDataFrame(rows, "frame_id int, class string, det_idx int, x int, y int, w int, h int, confidence double")
    assert sorted(r["det_idx"] for r in dt.nms(det, ["frame_id"], k=4).collect()) == [0, 1, 2, 3]


def test_points_on_their_own_plane_have_no_depth(spark):
    rows = [("p", i, float(i % 7), float(i // 7), 0.3 * (i % 7) - 0.2 * (i // 7) + 4.0) for i in range(70)]
    sunk = rows + [("p", 70, 3.0, 4.0, 0.3 * 3 - 0.2 * 4 + 4.0 + 0.1 * (0.3**2 + 0.2**2 + 1) ** 0.5)]
    schema = "det string, idx int, x double, y double, z double"
    flat, deep = spark.createDataFrame(rows, schema), spark.createDataFrame(sunk, schema)
    plane = pt.fit_plane(flat, ["det"])
    got = pt.depth_stats(flat, plane, ["det"]).first()
    assert (got["max_depth_m"], got["mean_depth_m"], got["quality"]) == (0.0, 0.0, 0.0)
    again = pt.refit_plane(deep, plane, ["det"]).first()
    assert abs(-again["a"] / again["c"] - 0.3) < 1e-9 and abs(-again["b"] / again["c"] + 0.2) < 1e-9 and abs(-again["d"] / again["c"] - 4.0) < 1e-9
    got = pt.depth_stats(deep, pt.refit_plane(deep, plane, ["det"]), ["det"]).first()
    assert abs(got["max_depth_m"] - 0.1) < 1e-9 and abs(got["quality"] - 1 / 71) < 1e-12


def _suppressed_plainly(boxes, iou):
    """Kept (frame, det) of (frame, class, det, x, y, w, h, confidence) boxes, box by box."""
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[7], b[2])):
        def over(a):
            ix = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
            iy = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
            union = a[5] * a[6] + b[5] * b[6] - ix * iy
            return ix * iy / union if union > 0 else 0.0
        if not any(a[:2] == b[:2] and over(a) > iou for a in kept):
            kept.append(b)
    return sorted((b[0], b[2]) for b in kept)


@pytest.mark.parametrize("iou", [0.0, 0.05, 0.45, 0.9, 1.0])
def test_nms_equals_the_sequential_rule(spark, iou):
    rnd = random.Random(int(iou * 100))
    boxes = []
    for i in range(220):
        big = rnd.choice([1, 1, 6])
        boxes.append((i % 3, rnd.choice(["a", "b"]), i, rnd.uniform(-60, 60), rnd.uniform(0, 40), rnd.uniform(8, 14) * big, rnd.uniform(8, 14) * big, rnd.choice([0.6, 0.7, rnd.uniform(0.5, 1)])))
    boxes += [(0, "a", 900, 5.0, 5.0, 0.0, 4.0, 0.9), (0, "a", 901, 5.0, 5.0, 0.0, 4.0, 0.9), (0, "a", 902, *boxes[0][3:7], 0.99)]
    det = spark.createDataFrame(boxes, "frame_id int, class string, det_idx int, x double, y double, w double, h double, confidence double")
    got = sorted((r["frame_id"], r["det_idx"]) for r in dt.nms(det, ["frame_id"], iou=iou).collect())
    assert got == _suppressed_plainly(boxes, iou)


def test_nms_rounds_do_not_follow_the_boxes_kept(spark, monkeypatch):
    rnd = random.Random(3)
    boxes = [(1, "a", i, 30.0 * (i % 60) + rnd.uniform(0, 9), 30.0 * (i // 60) + rnd.uniform(0, 9), 20.0, 20.0, rnd.uniform(0.5, 1)) for i in range(3600)]
    det = spark.createDataFrame(boxes, "frame_id int, class string, det_idx int, x double, y double, w double, h double, confidence double")
    cuts = []
    monkeypatch.setattr(dt, "cut", lambda df: cuts.append(1) or cut(df))
    assert dt.nms(det, ["frame_id"]).count() > 3000
    assert len(cuts) <= 1 + 3 * 8


def test_percentiles_of_several_columns_in_few_passes(spark, tmp_path, monkeypatch):
    rnd = np.random.default_rng(2)
    inf = float("inf")
    data = {
        "a": (rnd.normal(0, 1, 5000), np.exp(rnd.normal(0, 40, 5000)), np.round(rnd.uniform(0, 5, 5000))),
        "b": (np.array([1.0]), np.array([-0.0]), np.array([5e-324])), "c": (np.array([1e308, -1e308, 3.0]), np.array([5e-324, 0.0, 1e-323]), np.array([1.0, 1.0, 2.0])),
    }
    rows = [(k, *map(float, v)) for k, cols in data.items() for v in zip(*cols)] + [("a", None, float("nan"), None), ("d", None, 1.0, inf), ("d", float("nan"), 2.0, inf), ("d", None, 3.0, -inf), ("d", None, 4.0, inf)]
    path = str(tmp_path / "points")
    spark.createDataFrame(rows, "k string, x double, y double, z double").write.parquet(path)
    df = spark.read.parquet(path)
    cuts = []
    monkeypatch.setattr(pt, "cut", lambda d: cuts.append(1) or cut(d))
    shares = [0.0, 0.013, 0.5, 0.98, 1.0]
    got = {r["k"]: r for r in pt.percentiles(df, ["k"], {"x": shares, "y": shares, "z": [0.5]}).collect()}
    assert len(cuts) <= 2 + 12
    for k, (x, y, z) in data.items():
        for name, v, s in (("x", x, shares), ("y", y, shares), ("z", z, [0.5])):
            assert np.allclose(got[k][name], [np.sort(v)[int(np.floor(q * (len(v) - 1)))] + (np.sort(v)[int(np.ceil(q * (len(v) - 1)))] - np.sort(v)[int(np.floor(q * (len(v) - 1)))]) * (q * (len(v) - 1) % 1) for q in s]), (k, name)
    assert got["d"]["x"] is None and got["d"]["y"] == pytest.approx([1, 1.039, 2.5, 3.94, 4]) and got["d"]["z"] == [inf] and got["a"]["n"] == 5000
    plan = pt.median_center(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1 and plan.count("FileScan") + plan.count("Scan ExistingRDD") <= 4


def test_smallest_rectangle_of_turned_rectangles_and_clouds(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(40):
        a, w, h, x, y = rnd.uniform(0, math.pi), rnd.uniform(1, 9), rnd.uniform(1, 9), rnd.uniform(-50, 50), rnd.uniform(-50, 50)
        at = [(u * w, v * h) for u, v in [(0, 0), (1, 0), (1, 1), (0, 1)] + [(rnd.random(), rnd.random()) for _ in range(i % 7)]]
        pts = [(x + u * math.cos(a) - v * math.sin(a), y + u * math.sin(a) + v * math.cos(a)) for u, v in at]
        rnd.shuffle(pts)
        rows.append((i, pts, max(w, h), min(w, h)))
    rows += [(100, [(1.0, 1.0), (4.0, 5.0), (2.5, 3.0)], 5.0, 0.0), (101, [(2.0, 2.0)] * 3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, points array<struct<x:double,y:double>>, a double, b double")
    for r in df.withColumn("s", geo.smallest_rectangle(F.col("points"))).collect():
        assert r["s"]["long"] == pytest.approx(r["a"], abs=1e-9) and r["s"]["short"] == pytest.approx(r["b"], abs=1e-9), r["i"]
    some = [(i, [(rnd.gauss(0, 3), rnd.gauss(0, 1)) for _ in range(25)]) for i in range(5)]
    for r in spark.createDataFrame(some, "i int, points array<struct<x:double,y:double>>").withColumn("s", geo.smallest_rectangle(F.col("points"))).collect():
        pts = np.array([(p["x"], p["y"]) for p in r["points"]])
        def box(t):
            q = pts @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
            return float(np.prod(q.max(0) - q.min(0)))
        best = min(box(t) for t in np.linspace(0, math.pi / 2, 20001))
        assert r["s"]["long"] * r["s"]["short"] <= best + 1e-9 and r["s"]["long"] * r["s"]["short"] > best - 0.02


def test_nearest_center_has_no_bound(spark):
    from pavelens.operators.corridor import nearest_center

    rnd = random.Random(4)
    centers = [("a", i, rnd.uniform(0, 50), rnd.uniform(0, 5)) for i in range(40)] + [("a", 40, 9000.0, 0.0), ("a", 41, 9000.0, 300.0)]
    centers += [("one", 0, 3.0, 3.0), ("two", 0, 1.0, 1.0), ("two", 1, 1.0, 1.0), ("two", 2, 80.0, 1.0)]
    cells = [(c, f, float(round(x + rnd.uniform(-20, 20))), float(round(y + rnd.uniform(-20, 20)))) for c, f, x, y in centers for _ in range(15)]
    cells = sorted(set(cells))
    got = nearest_center(spark.createDataFrame(cells, "c string, frame_idx int, x double, y double"), spark.createDataFrame(centers, "c string, frame_idx int, cx double, cy double"), ["c"]).collect()
    assert len(got) == len(cells)
    where = {(c, f): (x, y) for c, f, x, y in centers}
    for r in got:
        far = [math.hypot(r["x"] - x, r["y"] - y) for (c, f), (x, y) in where.items() if c == r["c"] and f != r["frame_idx"]]
        own = math.hypot(r["x"] - where[r["c"], r["frame_idx"]][0], r["y"] - where[r["c"], r["frame_idx"]][1])
        assert r["own"] == pytest.approx(own) and (r["other"] == pytest.approx(min(far)) if far else r["other"] is None)
        assert r["alpha"] == pytest.approx(max(0, min(1, (min(far) - own + 10) / 20)) if far else 1)


@pytest.mark.parametrize("in_order", [0, 1_000_000])
def test_matching_with_ties_equals_the_scan(spark, monkeypatch, in_order):
    rnd = random.Random(2)
    n = 300 if in_order else 24
    rows = [("parked", a, b, 0.0) for a in range(n) for b in range(a + 15, n)] + [("road", a, b, round(rnd.uniform(0, 4), 1)) for a in range(120) for b in range(a + 15, 120) if rnd.random() < 0.1]
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda d: cuts.append(1) or cut(d))
    got = graph.greedy_match(spark.createDataFrame(rows, "project string, a long, b long, dist double"), ["project"], in_order)
    want, used = set(), set()
    for p, a, b, d in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        if not {(p, a), (p, b)} & used:
            used |= {(p, a), (p, b)}
            want.add((p, a, b))
    assert {(r["project"], r["a"], r["b"]) for r in got.collect()} == want
    if in_order:
        assert len(cuts) <= 30


@pytest.mark.parametrize("in_order", [0, 1_000_000])
def test_duplicates_of_a_long_chain_go_in_order(spark, monkeypatch, in_order):
    n = 1000 if in_order else 40
    rnd = random.Random(3)
    square = lambda x: [(x, 0.0), (x + 4.0, 0.0), (x + 4.0, 4.0), (x, 4.0)]
    cam = [rnd.uniform(0, 30) for _ in range(n)]
    rows = [("p", i, "pothole", i, 0, square(1.9 * i), (1.9 * i, -cam[i])) for i in range(n)]
    det = spark.createDataFrame(rows, "project string, det_id int, class string, frame_idx int, group_id int, points array<struct<x:double,y:double>>, cam struct<x:double,y:double>")
    cuts = []
    monkeypatch.setattr(gp, "cut", lambda d: cuts.append(1) or cut(d))
    got = {r["det_id"] for r in gp.dedupe_group(det, ["project"], in_order).collect()}
    alike = {(r["a"], r["b"]) for r in gp.polygon_pairs(det, ["project"]).where("similarity > 0.5").collect()}
    gone = set()
    for a, b in sorted(alike):
        if a not in gone and b not in gone:
            da, db = (math.hypot(2.0, 2.0 + cam[i]) for i in (a, b))
            gone.add(a if db < da else b)
    assert got == set(range(n)) - gone and len(gone) > n / 4
    if in_order:
        assert len(cuts) <= 3


def test_volume_of_a_dent_in_a_tilted_road(spark):
    """A dent 6 cm deep along the normal of a tilted road, seen in units of half a metre."""
    n = np.array([0.1, -0.5, 1.0])
    n /= np.linalg.norm(n)
    k = np.array([[400.0, 0, 50], [0, 420.0, 40], [0, 0, 1]])
    height, unit, deep = 1.4, 0.5, 0.06
    rows, cells = 30, {}
    for r in range(rows):
        for c in range(rows):
            ray = np.linalg.inv(k) @ [c, r, 1.0]
            inside = 10 <= r < 20 and 10 <= c < 20
            cells[r, c] = (ray, (height + deep * inside) / (n @ ray), inside)
    at = lambda r, c: (np.linalg.inv(k) @ [c, r, 1.0]) * height / (n @ np.linalg.inv(k) @ [c, r, 1.0])
    area = sum(np.linalg.norm(np.cross(at(r, c + 1) - at(r, c), at(r + 1, c) - at(r, c))) for (r, c), v in cells.items() if v[2])
    df = spark.createDataFrame([(1, r, c, float(v[1] / unit), 5 <= r < 25 and 5 <= c < 25) for (r, c), v in cells.items()], "id int, row int, col int, depth double, mask boolean")
    cams = spark.createDataFrame([(1, [float(x) for x in k.ravel()])], "id int, k array<double>")
    plane = spark.createDataFrame([(1, *map(float, -n), height / unit, None)], "id int, a double, b double, c double, d double, sqm double")
    got = pt.physical_depth(df, cams, plane, ["id"], height, area="sqm").first()
    assert got["volume_m3"] == pytest.approx(area * deep, abs=1e-9) and got["area_sqm"] == pytest.approx(area, abs=1e-9)
    assert got["max_depth_m"] == pytest.approx(deep) and got["mean_depth_m"] == pytest.approx(deep) and got["quality"] == pytest.approx(100 / 400)
    got = pt.physical_depth(df, cams, plane.withColumn("sqm", F.lit(2.0)), ["id"], height, area="sqm").first()
    assert got["volume_m3"] == pytest.approx(2.0 * deep) and got["area_sqm"] == 2.0


def test_boundary_distance_equals_all_pairs(spark):
    from pavelens.operators.raster import boundary_distance

    rnd = random.Random(1)
    cells = {("a", r, c) for r in range(30) for c in range(40) if rnd.random() < 0.93} | {("b", 5, 5)} | {("c", r, c) for r in range(25) for c in range(25)}
    got = boundary_distance(spark.createDataFrame(sorted(cells), "det string, row int, col int"), ["det"]).collect()
    assert len(got) == len(cells)
    for x in got:
        far = min(math.hypot(x["row"] - r, x["col"] - c) for r in range(-1, 31) for c in range(-1, 41) if (x["det"], r, c) not in cells)
        assert x["dist"] == pytest.approx(far)
