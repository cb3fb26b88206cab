"""Steps that have to grow with their input: pairs, neighbours, outlier blocks and polygon measures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pavelens.functions import polygons as pg
from pavelens.operators import corridor as co
from pavelens.operators import detection as dt
from pavelens.operators import graph
from pavelens.operators import grouping as gp
from pavelens.operators import joins
from pavelens.operators import passes as ps
from pavelens.operators import telemetry as tl
from pavelens.operators.blocks import BLOCK, series
from pavelens.queries import streams
from pavelens.queries.registry import rnd, rnd_fast


def test_polygon_measures_of_a_batch_are_those_of_single_pairs():
    rng = np.random.default_rng(3)
    rings = []
    for k in rng.integers(3, 8, 60):
        t, r, c = np.sort(rng.random(k) * 6.28), rng.random(k) + 0.3, rng.random(2) * 3
        rings.append((c[0] + r * np.cos(t), c[1] + r * np.sin(t)))
    ax, ay, bx, by = (pd.Series([np.array(r[i]) for r in part]) for part in (rings[:30], rings[30:]) for i in (0, 1))
    for batch, one in ((pg._by_size(pg._gaps, pg._gap_cells, ax, ay, bx, by), pg._gap), (pg._by_size(pg._similarities, pg._overlap_cells, ax, ay, bx, by), pg._similarity)):
        assert list(batch) == [one(*p) for p in zip(ax, ay, bx, by)]


def test_copies_of_a_ring_hang_on_the_first_one(spark):
    p = lambda x, y: {"x": float(x), "y": float(y)}
    box = lambda x: [p(x, 0), p(x + 1, 0), p(x + 1, 1), p(x, 1)]
    rows = [("g", i, box(0)) for i in range(200)] + [("g", 200 + i, box(1)) for i in range(100)] + [("g", 900, box(5)), (None, 901, box(5))]
    det = spark.createDataFrame(rows, "group_id string, det_id long, points array<struct<x:double,y:double>>")
    links = gp.touching_pairs(det, ["group_id"], 1e-5).collect()
    assert len(links) == 199 + 99 + 1  # and not all pairs
    assert (0, 200) in {(r.u, r.v) for r in links}
    area = {r.group_id: (r.part, r.area_sqm) for r in gp.merge_polygons(det.where("group_id is not null").withColumn("frame_idx", F.lit(0)), [], 0.5).collect()}
    assert area["g"] == (0, pytest.approx(2.0))


def test_box_pairs_meet_once(spark):
    rnd = random.Random(5)
    boxes = []
    for i in range(250):
        x, y = rnd.randrange(40) * 0.5, rnd.randrange(20) * 0.5
        boxes.append((i, rnd.randrange(60), x, x + rnd.randrange(1, 9) * 0.5, y, y + rnd.randrange(1, 5) * 0.5))
    df = spark.createDataFrame([(1, *b) for b in boxes], "g int, det_id long, frame_idx long, _x0 double, _x1 double, _y0 double, _y1 double")
    for reach, gap in ((0.0, None), (1.0, None), (1.0, 10)):
        want = []
        for a in boxes:
            for b in boxes:
                dx, dy = max(b[2] - a[3], a[2] - b[3], 0), max(b[4] - a[5], a[4] - b[5], 0)
                if a[0] < b[0] and dx * dx + dy * dy <= reach * reach and (gap is None or abs(a[1] - b[1]) <= gap):
                    want.append((a[0], b[0], a[2], b[2]))
        got = gp.box_pairs(df, ["g"], reach, 0.75, gap).select("det_id", "det_id_b", "_x0", "_x0_b").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_nearest_earlier_without_all_pairs(spark):
    rnd = random.Random(7)
    rows = [("p", i, rnd.randrange(60) * 0.5, rnd.randrange(30) * 0.5) for i in range(500)] + [("q", 3, 1.0, 1.0), ("q", 90, 1.0, None), ("q", 91, 1.0, 2.0)]
    rows += [("p", 44, 3.0, 3.0), (None, 400, 1.0, 1.0)]
    got = {(r.project, r.frame_idx): (r._d, r._t) for r in ps.nearest_earlier(spark.createDataFrame(rows, "project string, frame_idx long, x double, y double"), ["project"], 15, 4.0).collect()}
    want = {}
    for p, i, x, y in rows:
        near = [(np.hypot(u - x, v - y), j) for q, j, u, v in rows if p is not None and p == q and y is not None and v is not None and j < i - 15]
        near = [n for n in near if n[0] <= 4.0]
        if near:
            want[p, i] = min([min(near), *([want[p, i]] if (p, i) in want else [])])
    assert {k: (round(d, 9), t) for k, (d, t) in got.items()} == {k: (round(float(d), 9), t) for k, (d, t) in want.items()}


def test_earlier_neighbours_of_a_crowded_square():
    """40,000 frames in a square of four metres are 800 million pairs."""
    rng = np.random.default_rng(2)
    n = 40_000
    f, x, y = np.arange(n), rng.random(n) * 4, rng.random(n) * 4
    own, at = ps.earlier_neighbours(f, x, y, f, x, y, 15, 4.0)
    assert len(own) == n - 16
    for i in rng.integers(16, n, 50):
        d = np.hypot(x[: i - 15] - x[i], y[: i - 15] - y[i])
        assert at[np.searchsorted(own, i)] == d.argmin()


def test_pairs_carry_their_telemetry(spark):
    lat = lambda i: -32.4 + (i % 7) * 1e-5
    frames = [("p", i, f"f{i}", lat(i), 151.75) for i in range(60)] + [("p", 9, "f9", lat(9), 151.75), ("p", 11, "f11", None, None), (None, 4, "f4", lat(4), 151.75)]
    f = spark.createDataFrame(frames, "project string, frame_idx long, filename string, lat double, lon double")
    meta = spark.createDataFrame(
        [(f"f{i}", lat(i), 151.75 if i % 5 else None, lat(i) if i % 4 else None, None, float(i) if i % 3 else None, 1.0) for i in [*range(50), 12]],
        "filename string, lat double, lon double, raw_lat double, raw_lon double, heading double, speed_ms double")
    key = ["project"]
    carried = ps.attach_telemetry(ps.repeat_pass_candidates(ps.frame_telemetry(f, meta, key), key, carry=["tele"]), f, meta, key)
    joined = ps.attach_telemetry(ps.repeat_pass_candidates(f, key), f, meta, key)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(carried) == rows(joined) and carried.count() > 100
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(tele_b") < plan.index("Join ")  # pairs are unpacked last and meet no join


def test_sparse_sessions_are_folded_in_few_blocks(spark):
    rows = [("s", i, i * 1000.0 if i % 50 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id string, seq long, time_sec double")
    s = series("session_id", ("time_sec", "seq"), 3600.0)
    got = tl._fold_blocks(df.withColumn(BLOCK, s.block()), s, 100)
    sizes = sorted(r["count"] for r in got.groupBy(BLOCK).count().collect())
    assert sum(sizes) == 300 and len(sizes) == 4 and max(sizes) < 110
    apart = got.groupBy(BLOCK).agg(F.min("time_sec").alias("a"), F.max("time_sec").alias("b")).where("a is not null").orderBy("a").collect()
    assert all(p.b < q.a and p[BLOCK] < q[BLOCK] for p, q in zip(apart, apart[1:]))


def test_passes_are_matched_by_bands_of_distance(spark, monkeypatch):
    rnd_ = random.Random(11)
    rows = [(rnd_.choice("pq"), i, -32.4 + rnd_.randrange(4) * 1e-5 + rnd_.random() * 2e-6, 151.75 + rnd_.randrange(2) * 1e-4) for i in range(160)]
    rows += [("p", 700 + i, -32.4, 151.75) for i in range(20)] + [("p", 9, -32.4, 151.75), ("p", 760, None, 151.75), (None, 761, -32.4, 151.75)]
    f = spark.createDataFrame(rows, "project string, frame_idx long, lat double, lon double")
    cand = ps.repeat_pass_candidates(f, ["project"]).withColumn("dist", F.round("dist", 4)).collect()
    want, used = set(), set()
    for p in sorted(cand, key=lambda p: (p.project, p.dist, p.a, p.b)):
        if (p.project, p.a) not in used and (p.project, p.b) not in used:
            used |= {(p.project, p.a), (p.project, p.b)}
            want.add((p.project, p.a, p.b, p.dist))
    seen = []
    monkeypatch.setattr(ps, "WIDER", 16.0)
    monkeypatch.setattr(ps, "greedy_match", lambda pairs, keys: (seen.append(pairs.count()), graph.greedy_match(pairs, keys))[1])
    got = ps.find_repeat_passes(f, ["project"], digits=4)
    assert sorted(map(tuple, got.select("project", "a", "b", "dist").collect())) == sorted(want)
    assert len(seen) > 1 and sum(seen) < len(cand) / 2  # most pairs are never formed


def test_small_groups_of_boxes_are_walked_in_order(spark):
    rnd_ = random.Random(12)
    rows = [(rnd_.choice([1, None]), rnd_.choice("ab"), i, rnd_.randrange(40), rnd_.randrange(30), rnd_.randrange(1, 25), rnd_.randrange(8, 20), rnd_.choice([0.4, 0.6, 0.7, 0.9, float("nan")])) for i in range(400)]
    det = spark.createDataFrame(rows, "frame_id int, class string, det_idx long, x int, y int, w int, h int, confidence double")

    def iou(a, b):
        inter = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        return inter / (a[5] * a[6] + b[5] * b[6] - inter)

    kept = []
    for r in sorted(rows, key=lambda r: (-2.0 if np.isnan(r[7]) else -r[7], r[2])):
        if r[7] != 0.4 and not any(q[:2] == r[:2] and iou(q, r) > 0.45 for q in kept):
            kept.append(r)
    out = dt.nms(det, ["frame_id"])
    assert sorted(r.det_idx for r in out.collect()) == sorted(r[2] for r in kept)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # no rounds: only groups are picked


def test_cells_meet_their_frame_once(spark):
    rnd_ = random.Random(13)
    centers = [(1, i, float(rnd_.randrange(20) * 5), float(rnd_.randrange(3) * 4)) for i in range(40)] + [(1, 5, 10.0, 4.0), (2, 1, 0.0, 0.0), (3, 1, None, 0.0), (3, 2, 7.0, 0.0)]
    cells = [(c, i, (x or 0.0) + rnd_.randrange(-30, 30), y + rnd_.randrange(-9, 9)) for c, i, x, y in centers for _ in range(6)] + [(1, 3, None, 1.0), (9, 9, 1.0, 1.0)]
    f, c = spark.createDataFrame(centers, "c int, frame_idx long, cx double, cy double"), spark.createDataFrame(cells, "c int, frame_idx long, x double, y double")
    out = co.nearest_center(c, f, ["c"])
    d = lambda x, y, u, v: None if None in (x, y, u, v) else float(np.hypot(x - u, y - v))
    want = []
    for k, i, x, y in cells:
        for j, (l, m, u, v) in enumerate(centers):
            if (l, m) == (k, i):
                far = [d(x, y, *q[2:]) for n, q in enumerate(centers) if q[0] == k and n != j and None not in q[2:]]
                far = [q for q in far if q is not None]
                want.append((k, i, x, y, d(x, y, u, v), min(far) if far and u is not None else None))
    key = lambda r: repr([None if v is None else round(float(v), 6) for v in r])
    assert sorted(key(tuple(r)[:6]) for r in out.collect()) == sorted(map(key, want))


def test_a_piece_of_a_stream_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "_dir", lambda spark, name: str(tmp_path / name))
    rows = spark.range(0, 900, 1, 6).withColumnRenamed("id", "seq").withColumn("_piece", F.floor(F.col("seq") % 3))
    stream, pieces = streams._event_stream(spark, "", lambda s, sf: rows)
    sizes, files = [], [len(list((tmp_path / "feed").glob("*.parquet")))]
    for _ in pieces:
        files.append(len(list((tmp_path / "feed").glob("*.parquet"))))
        query = stream.writeStream.foreachBatch(lambda b, k: sizes.append((k, b.count()))).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sizes == [(0, 300), (1, 300), (2, 300)] and all(b - a >= 6 for a, b in zip(files, files[1:]))


def test_fast_rounding_is_the_same(spark):
    rnd_ = random.Random(14)
    values = [rnd_.uniform(-5, 5) * 10.0**e for e in range(-8, 14) for _ in range(200)] + [k * 5e-7 for k in range(-200, 200)] + [k * 1e-6 for k in range(-50, 50)] + [float("nan"), float("inf"), -0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (5, 6):
        assert df.where(~rnd("v", digits).eqNullSafe(rnd_fast("v", digits))).count() == 0


def test_boxes_visit_cells_without_their_rings(spark, monkeypatch):
    rnd_ = random.Random(15)
    p = lambda x, y: {"x": x, "y": y}
    rows = []
    for i in range(120):
        x, y, w, h = (rnd_.randrange(40) * 0.5, rnd_.randrange(20) * 0.5, rnd_.randrange(1, 9) * 0.5, rnd_.randrange(1, 5) * 0.5)
        rows.append((rnd_.choice([1, 1, 2, None]), i // 2 if i < 20 else i, rnd_.randrange(60), [p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)], i * 1.5))  # ids repeat
    det = spark.createDataFrame(rows, "g int, det_id long, frame_idx long, points array<struct<x:double,y:double>>, away double")
    carried, meet = [], gp.salted_join
    monkeypatch.setattr(gp, "salted_join", lambda left, *a, **k: (carried.extend(left.dtypes), meet(left, *a, **k, per_task=5))[1])  # many buckets are hot
    got = gp.polygon_pairs(det, ["g"], 1.0, 10, ("away",)).collect()
    want = []
    for a in rows:
        for b in rows:
            (ax, bx), (ay, by) = ([[q[c] for q in r[3]] for r in (a, b)] for c in "xy")
            if a[0] is not None and a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 10 and pg._gap(ax, ay, bx, by) < 1.0:
                want.append((a[0], a[1], b[1], pg._gap(ax, ay, bx, by), pg._similarity(ax, ay, bx, by), a[4], b[4]))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    assert carried and not [c for c, kind in carried if kind.startswith("array")]


def test_boxes_are_counted_by_bucket(spark, monkeypatch):
    seen, hot = [], joins.hot_keys
    monkeypatch.setattr(joins, "hot_keys", lambda counts, *a: (seen.append(counts.count()), hot(counts, *a))[1])
    monkeypatch.setattr(gp, "CELL_BUCKETS", 16)
    boxes = spark.range(3000).selectExpr("id % 3 g", "id det_id", "id frame_idx", "id * 2.0 _x0", "id * 2.0 + 1 _x1", "0.0 _y0", "1.0 _y1")
    assert gp.box_pairs(boxes, ["g"], 2.0, 4.0).count() == 0 and seen == [16]
    assert gp.box_pairs(boxes.withColumn("g", F.lit(1)), ["g"], 2.0, 4.0, 10).count() == 2999


def test_centroid_takes_each_step_once(spark):
    rng = np.random.default_rng(16)
    p = lambda x, y: {"x": float(x), "y": float(y)}
    rings = [[p(*q) for q in rng.random((int(k), 2)) * 9 + 100] for k in rng.integers(3, 12, 50)] + [[p(1, 1), p(2, 2), p(4, 4)], [p(3, 5)], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, points array<struct<x:double,y:double>>")
    out = df.select("i", pg.centroid(F.col("points")).alias("m"))
    for r in out.collect():
        if rings[r.i] is None:
            assert r.m.x is None and r.m.y is None
            continue
        x, y = pg._centroids(*(np.array([[q[c] for q in rings[r.i]]]) for c in "xy"))
        assert (r.m.x, r.m.y) == (pytest.approx(x[0, 0]), pytest.approx(y[0, 0]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1
