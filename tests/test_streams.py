"""Streams with rows out of order across batches against one batch over all rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pavelens.operators import telemetry as tl
from pavelens.streaming import folds


def run(spark, folder, fold, rows, schema, parts):
    """Feed ``rows`` in ``parts`` files, one a batch, and close."""
    feed = str(folder / "feed")
    for k in range(parts):
        spark.createDataFrame([r for i, r in enumerate(rows) if i * parts // len(rows) == k], schema).coalesce(1).write.mode("append").parquet(feed)
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    out = str(folder / "fold")
    query = folds.run_fold(sdf, out, fold)
    query.awaitTermination()
    folds.close_fold(spark, out, fold, query, sdf.schema)
    return folds.fold_output(spark, out), folds.late_rows(spark, out), out


def shuffled(rows, at, spread, seed=1):
    """Rows in order of time, each up to ``spread`` behind its turn."""
    rnd = random.Random(seed)
    return sorted(rows, key=lambda r: r[at] + rnd.uniform(0, spread))


def test_failures_out_of_order(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", "c"]), i, rnd.random() < 0.8) for i in range(600)]
    schema = "source string, seq long, failed boolean"
    out, late, _ = run(spark, tmp_path, folds.failure_fold(3).lasting(40), shuffled(rows, 1, 39), schema, 3)
    want = folds.failure_breaches(spark.createDataFrame(rows, schema), 3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and late.count() == 0


def test_late_rows_and_rows_without_key_go_to_their_own_table(spark, tmp_path):
    rows = [("a", i, True) for i in range(100)] + [("a", 3, False), (None, 100, True), ("a", None, True), ("a", 100, True)]
    schema = "source string, seq long, failed boolean"
    out, late, _ = run(spark, tmp_path, folds.failure_fold(9).lasting(5), rows, schema, 3)
    assert [tuple(r) for r in out.collect()] == [("a", 9, 10)]
    assert sorted((r["source"], r["seq"], r["why"]) for r in late.collect() if r["source"] and r["seq"] is not None) == [("a", 3, "late")]
    assert sorted(r["why"] for r in late.collect()) == ["late", "no key or time", "no key or time"]


def test_quiet_keys_end_and_old_versions_are_removed(spark, tmp_path):
    fold = folds.failure_fold(3).lasting(0, 50)
    rows = [("old", i, True) for i in range(3)] + [("busy", i, True) for i in range(3, 300)] + [("old", 300, True)]
    schema = "source string, seq long, failed boolean"
    one = folds.Fold(**{**fold.__dict__, "buckets": 1})
    out, _, folder = run(spark, tmp_path, one, rows, schema, 6)
    # three failures of the source that went quiet are forgotten, the busy one goes on
    assert sorted(map(tuple, out.collect())) == [("busy", 6, 4)]
    for kind in ("state", "waiting"):
        kept = [p for p in Path(folder, kind).glob("batch=*") if "-1" not in p.name and list(p.glob("*/*.parquet"))]
        assert len(kept) <= 2, kept
    assert len(list(Path(folder, "clock").glob("batch=*"))) <= 3


@pytest.mark.parametrize("parts", [1, 3])
def test_outlier_filter_equals_the_batch(spark, tmp_path, parts):
    rnd = random.Random(8)
    rows = []
    for s in range(4):
        for i in range(150):
            jump = rnd.random() < 0.1
            rows.append((s, i, i * 0.5, -32.0 + i * 1e-5 + (0.01 if jump else 0), 151.0, 2.2))
    rows += [(7, 0, 3.0, 1.0, 1.0, 0.0), (7, 1, 4.0, 2.0, 1.0, 0.0), (7, 2, 5.0, 3.0, 1.0, 0.0), (7, 3, 6.0, 4.0, 1.0, 0.0), (8, 0, 9.0, 1.0, 1.0, 1.0)]
    schema = "session_id long, seq long, time_sec double, lat double, lon double, speed double"
    out, late, _ = run(spark, tmp_path, folds.outlier_fold().lasting(8), shuffled(rows, 2, 7.5), schema, parts)
    want = tl.drop_speed_outliers(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and late.count() == 0
    assert {tuple(r)[:2] for r in out.collect()} >= {(7, 0), (7, 1), (7, 2), (7, 3), (8, 0)}


def test_health_equals_the_batch_and_takes_gps9_alone(spark, tmp_path):
    rnd = random.Random(9)
    rows = []
    for s in range(5):
        for i in range(80):
            fix = [-32.0 + i * 1e-5, 151.0, 10.0, rnd.uniform(1, 4), 2.0]
            rows.append((s, "GPS5", i, i * 0.5, fix))
            if s % 2:
                rows.append((s, "GPS9", i, i * 0.5 + 0.1, [*fix, 0.0, 0.0, rnd.uniform(1, 6), float(rnd.randrange(4))]))
            if s != 4:
                rows.append((s, "GRAV", i, i * 0.5 + 0.2, [rnd.uniform(0, 0.3), 0.9, 0.1]))
            rows.append((s, "ISOE", i, i * 0.5, [100.0]))
    schema = "session_id long, stream string, seq long, time_sec double, data array<double>"
    out, late, _ = run(spark, tmp_path, folds.health_fold().lasting(6), shuffled(rows, 3, 5.5), schema, 3)
    df = spark.createDataFrame(rows, schema)
    want = {r["session_id"]: r for r in tl.gps_health(df).join(tl.imu_health(df), "session_id", "left").collect()}
    got = {r["session_id"]: r for r in out.collect()}
    assert got.keys() == want.keys() and late.count() == 0
    for k, w in want.items():
        assert got[k]["samples"] == w["samples"] and got[k]["bad_fix_ratio"] == w["bad_fix_ratio"] and got[k]["max_speed_error"] == w["max_speed_error"]
        assert got[k]["gps_score"] == pytest.approx(w["gps_score"]) and got[k]["imu_score"] == pytest.approx(w["imu_score"] if k != 4 else 100.0)
    assert out.where(F.size("warnings") > 0).count() > 0


def test_events_get_ids_by_content(spark):
    from pavelens.sources.schemas import LIVE_EVENT
    from pavelens.streaming.results import with_event_ids

    rows = [{"type": "item_error", "source": "a", "message": m} for m in ("x", "y", "x", None)]
    got = [r["event_id"] for r in with_event_ids(spark.createDataFrame(rows, LIVE_EVENT)).collect()]
    assert got[0] == got[2] and len(set(got)) == 3 and None not in got
