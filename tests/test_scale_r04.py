"""Findings of round 4: work that follows the rows, compared with plain Python."""

import math
import random

from pyspark.sql import functions as F

from pavelens.functions.scalar import round_fast
from pavelens.operators import grouping as gp, passes as ps
from pavelens.operators.blocks import scan, series


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_ahead_are_looked_at_once(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.random() if rnd.random() < 0.05 else None) for k in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, v double")
    got = scan(df, series("k", "at", 90), next_fills={"n": F.col("v")}, fills={"p": F.col("v")})
    assert "unboundedfollowing" not in _plan(got).lower()  # such a frame is worked out anew for every row
    for k in ("a", "b", None):
        own = [v for key, _, v in rows if key == k]
        known = {r["at"]: (r["n"], r["p"]) for r in got.where(F.col("k").eqNullSafe(k)).collect()}
        if k is not None:  # a null key meets no row of its borders
            assert known == {i: (next((v for v in own[i:] if v is not None), None), next((v for v in own[i::-1] if v is not None), None)) for i in range(400)}


def _arc(p, q):
    a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6378137.0 * math.atan2(math.sqrt(a), math.sqrt(max(1 - a, 0)))


def test_pairs_are_told_by_chords(spark):
    rnd = random.Random(5)
    at = [(-32.4 + rnd.random() * 2e-4, 179.9999 + rnd.random() * 2e-4) for _ in range(90)] + [(89.99997 + rnd.random() * 3e-5, rnd.random() * 360) for _ in range(40)]
    at = [(a, o - 360 if o > 180 else o) for a, o in at] + [(float("nan"), 1.0), (0.0, 0.0), (0.0, 180.0)]
    df = spark.createDataFrame([("p", i, a, o) for i, (a, o) in enumerate(at)] + [("p", 7, *at[8]), ("q", 1, None, 2.0), (None, 2, *at[2])], "p string, frame_idx long, lat double, lon double")
    rows = [(i, *c) for i, c in enumerate(at)] + [(7, *at[8])]
    for radius, gap in ((4.0, 3), (4.0, 0), (20.1e6, 1)):
        found = ps.repeat_pass_candidates(df, ["p"], gap, radius)
        condition = _plan(found.drop("dist")).split("Join Inner")[1].split("\n")[0]
        assert condition.index("_q0") < condition.index("ATAN2")  # no arc is worked out for a pair that its chord rules out
        want = sorted((a[0], b[0]) for a in rows for b in rows if b[0] - a[0] >= gap and _arc(a[1:], b[1:]) <= radius)
        assert sorted((r.a, r.b) for r in found.collect()) == want and want


def test_telemetry_is_unpacked_before_pairs_meet(spark):
    lat = lambda i: -32.4 + (i % 7) * 1e-5
    frames = [("p", i, f"f{i}", lat(i), 151.75) for i in range(60)] + [("p", 9, "f9", lat(8), 151.75), ("p", 11, "f11", None, None), (None, 4, "f4", lat(4), 151.75)]
    f = spark.createDataFrame(frames, "project string, frame_idx long, filename string, lat double, lon double")
    meta = spark.createDataFrame(
        [(f"f{i}", lat(i), 151.75 if i % 5 else None, lat(i) if i % 4 else None, None, float(i) if i % 3 else None, 1.0) for i in [*range(50), 12]],
        "filename string, lat double, lon double, raw_lat double, raw_lon double, heading double, speed_ms double")
    key = ["project"]
    got = ps.attach_telemetry(ps.repeat_pass_candidates(ps.telemetry_rows(f, meta, key), key, carry=ps.CARRIED), f, meta, key)
    packed = ps.attach_telemetry(ps.repeat_pass_candidates(ps.frame_telemetry(f, meta, key), key, carry=["tele"]), f, meta, key)
    assert got.columns == packed.columns and got.count() > 100
    assert sorted(map(repr, got.collect())) == sorted(map(repr, packed.collect()))
    assert "Generate" not in _plan(got)[: _plan(got).index("Join ")]  # nothing is unpacked per pair


def test_fast_rounding_keeps_the_values(spark):
    rnd = random.Random(6)
    values = [rnd.uniform(-500, 500) for _ in range(3000)] + [k / 2000 for k in range(-4001, 4001)] + [0.0, -0.0, -1e-9, 1e15 + 0.5, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 1, 3, 5):
        rows = df.select(round_fast("v", d).alias("fast"), F.round("v", d).alias("slow")).collect()
        assert [repr(r.fast) for r in rows] == [repr(r.slow) for r in rows]


def _rings(spark, own_ids):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        g, x, y = rnd.choice([1, 2, 3, 4, None]), rnd.randrange(30) * 0.3, rnd.randrange(6) * 0.25 - 1
        ring = [(x, y), (x + 0.6, y), (x + 0.6, y + 0.5), (x, y + 0.5)] if i % 3 else [(x, y), (x + 0.7, y), (x + 0.3, y + 0.8)]
        det = None if i % 20 == 0 else rnd.randrange(120) * (10 if own_ids else 1) + (g or 0) * own_ids
        rows.append((rnd.choice(["a", "a", "b", None]), g, det, ring))
    return spark.createDataFrame(rows + rows[:20], "project string, group_id long, det_id long, points array<struct<x:double,y:double>>").withColumn("frame_idx", F.lit(0))


def test_small_groups_are_united_by_one_task(spark, monkeypatch):
    asked = []
    joins = gp._united_by_joins
    monkeypatch.setattr(gp, "_united_by_joins", lambda held, *a: asked.append(held) or joins(held, *a))
    monkeypatch.setattr(gp, "STEP_CORNERS", 7)  # many steps, whose borders are borders of groups
    rows = lambda df: sorted(map(repr, df.select("group_id", "part", "row", "c0", "c1").collect()))
    for own_ids in (True, False):
        det = _rings(spark, own_ids)
        got = rows(gp._merged_runs(det, ["project"], 0.1))
        assert bool(asked) != own_ids  # groups that share an id with another are joined
        assert got == rows(joins(det.select("project", "group_id", "det_id", "points"), ["project"], 0.1)) and len(got) > 100
    asked.clear()
    monkeypatch.setattr(gp, "GROUP_POLYGONS", 30)  # some groups are too large for a task
    det = _rings(spark, True)
    assert rows(gp._merged_runs(det, ["project"], 0.1)) == rows(joins(det.select("project", "group_id", "det_id", "points"), ["project"], 0.1)) and asked


def test_outlines_are_cut_from_runs(spark, monkeypatch):
    monkeypatch.setattr(gp, "STEP_RUNS", 5)
    det = _rings(spark, True)
    assert gp.connected_components and "explode(sequence" not in _plan(gp.merged_outline(det, ["project"], 0.01)).lower()  # cells inside are never formed
    runs = gp._merged_runs(det, ["project"], 0.01)
    best = {(r.group_id, r.part) for r in gp._best_parts(runs, 0.01).collect()}
    cells = {(r.group_id, r.part, r.row, c) for r in runs.collect() if (r.group_id, r.part) in best and r.group_id is not None and r.part is not None for c in range(r.c0, r.c1 + 1)}
    want = {(g, p, i, j) for g, p, i, j in cells if not {(g, p, i + 1, j), (g, p, i - 1, j), (g, p, i, j + 1), (g, p, i, j - 1)} <= cells}
    got = [tuple(r) for r in gp.merged_outline(det, ["project"], 0.01).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({i // gp.STRIPE_ROWS for _, _, i, _ in got}) > 2


def test_bucket_numbers_stay_behind(spark):
    rnd = random.Random(8)
    rows = [("g", i, rnd.randrange(90), rnd.random() * 9, rnd.random() * 9, rnd.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, det_id long, frame_idx long, _x0 double, _y0 double, w double").selectExpr("g", "det_id", "frame_idx", "_x0", "_x0 + w as _x1", "_y0", "_y0 + w as _y1")
    pairs = gp.box_pairs(df, ["g"], 0.5, 1.0, 7)
    for line in _plan(pairs).split("\n"):
        assert "RepartitionByExpression" not in line or "_bucket" not in line  # buckets are for counting; other keys decide them
    want = sorted(
        (a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and abs(a[2] - b[2]) <= 7
        and max(a[3] - b[3] - b[5], b[3] - a[3] - a[5], 0) ** 2 + max(a[4] - b[4] - b[5], b[4] - a[4] - a[5], 0) ** 2 <= 0.25)
    assert sorted((r.det_id, r.det_id_b) for r in pairs.collect()) == want and len(want) > 20
