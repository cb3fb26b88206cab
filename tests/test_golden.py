"""The golden manifest pair, boundary values and file round trips."""

import pytest
from pyspark.sql import functions as F

from pavelens.functions import scalar as sc
from pavelens.operators import detection as dt, manifest as mf, points as pt, raster
from pavelens.operators.dataset import split_counts
from pavelens.plans.manifest_flow import manifest_features, manifest_report
from pavelens.sources import readers, schemas, sinks

BLUR = [1046.14, 933.04, 1241.59, 1545.29, 1061.23, 28.46, 890.78, 641.61, 1206.44]


def _manifest(spark):
    rows = []
    for i, b in enumerate(BLUR, 1):
        row = {c: "" for c in schemas.MANIFEST_FIELDS}
        row.update(frame_id=f"image_{i:06d}", image_path=f"frames/{i}.jpg", latitude=f"{-32.4 - i / 1000:.7f}", longitude="151.75", camera_height_m="1.600", status="ready")
        rows.append((*[row[c] for c in schemas.MANIFEST_FIELDS], True, True, b, "s", i))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schemas.MANIFEST_FIELDS) + ", file_exists boolean, readable boolean, blur_score double, session_id string, frame_idx long")


def test_golden_report(spark):
    got = {r["line"]: r["frames"] for r in manifest_report(_manifest(spark)).collect()}
    assert got == {"total": 9, "ready": 8, "excluded": 1, f"status:{mf.READY_BASIC}": 8, "status:warning_low_quality_blurry": 1}
    checked = mf.validate_manifest(_manifest(spark)).first()
    assert checked["missing_metadata"] == ["pitch", "roll", "yaw"]


def test_features_carry_heading(spark):
    out = manifest_features(_manifest(spark)).orderBy("frame_idx").collect()
    assert len(out) == 8 and out[0]["heading"] == 0.0 and abs(out[1]["heading"] - 180) < 1e-6
    assert '"type":"Feature"' in out[0]["feature"]


def test_empty_manifest_is_an_error(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(",".join(schemas.MANIFEST_FIELDS) + "\n")
    with pytest.raises(ValueError):
        readers.read_manifest(spark, str(path))


def test_severity_bounds(spark):
    df = spark.createDataFrame([(499.9,), (500.0,), (2000.0,), (2000.1,), (None,)], "a double")
    assert [r[0] for r in df.select(sc.severity(F.col("a"))).collect()] == ["minor", "moderate", "moderate", "severe", None]


def test_mask_extent_has_no_plus_one(spark):
    cells = spark.range(30 * 40).select(F.lit(1).alias("det"), (F.col("id") / 40 + 20).cast("int").alias("row"), (F.col("id") % 40 + 30).cast("int").alias("col"))
    m = dt.mask_measure(cells, ["det"]).first()
    assert (m["length_pixels"], m["width_pixels"], m["area_pixels"]) == (29, 39, 1200)
    one = spark.createDataFrame([(1, 100, 9, 9)], "det int, area_pixels long, length_pixels int, width_pixels int")
    assert dt.metric_measure(one, F.lit(200.0), F.lit(1000.0)).first()["area_cm2"] == 4.0
    assert dt.metric_measure(one, F.lit(0.0), F.lit(1000.0)).first()["severity"] is None


def test_diagonal_touch_is_one_component(spark):
    cells = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 5, 5), (1, 5, 6), (2, 0, 0)]
    got = raster.largest_component(spark.createDataFrame(cells, "det int, row int, col int"), ["det"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 0)]


def test_bev_majority_and_tie(spark):
    def grid(classes):
        rows = [(i, 0.0, 0.0, 0.0, c, 0.1 * i) for i, c in enumerate(classes)]
        return pt.bev_grid(spark.createDataFrame(rows, "idx long, x double, y double, z double, class int, severity double"), 0.02).first()

    assert grid([1, 2, 2, 1, 2])["class"] == 2
    tie = grid([1, 3, 1, 3])
    assert tie["class"] == 1 and abs(tie["severity"] - 0.3) < 1e-12


def test_filter_bounds_are_inclusive(spark):
    rows = [(0, 0.3, 0.0), (1, 0.7, 0.5), (2, 0.5, -0.5), (3, 0.9, 0.51)]
    got = pt.filter_points(spark.createDataFrame(rows, "idx int, confidence double, y double")).collect()
    assert sorted(r["idx"] for r in got) == [1, 2]


def test_split_counts(spark):
    r = {"train": 0.8, "val": 0.1, "test": 0.1}
    groups = spark.createDataFrame([("a", 10), ("b", 100), ("c", 16036), ("d", 1)], "g string, n long")
    got: dict = {}
    for row in split_counts(groups, ["g"], "n", r).collect():
        got.setdefault(row["g"], {})[row["split"]] = row["samples"]
    assert got["a"] == {"train": 8, "val": 1, "test": 1}
    assert got["b"] == {"train": 80, "val": 10, "test": 10}
    assert sum(got["c"].values()) == 16036
    assert got["d"] == {"train": 1, "val": 0, "test": 0}
    even = split_counts(groups.where("g = 'd'"), ["g"], "n", {"b": 0.5, "a": 0.5}).collect()
    assert {x["split"]: x["samples"] for x in even} == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        split_counts(groups, ["g"], "n", {"train": 0.8, "val": 0.1})
    with pytest.raises(Exception, match="total must be positive"):
        split_counts(groups.select("g", F.lit(0).alias("n")), ["g"], "n", r).collect()


def test_label_round_trip(spark, tmp_path):
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    df = spark.range(3).select(F.lit("im").alias("image"), F.col("id").alias("line_no"), F.lit(2).alias("class_id"), F.array(p(0.1, 0.2), p(0.3, 0.4), p(0.5, 0.6)).alias("points"))
    sinks.write_labels(df, str(tmp_path / "l"))
    back = readers.read_labels(spark, str(tmp_path / "l" / "*" / "*.txt")).collect()
    assert len(back) == 3 and back[0]["class_id"] == 2 and back[0]["points"][2]["y"] == 0.6


def test_stream_csv(spark, tmp_path):
    (tmp_path / "hero5_GPS5.csv").write_text("0,1,2,3,4\n33.1,-117.3,-20.1,0.1,0.2\n33.2,-117.3,-20.1,0.1,0.2\n")
    (tmp_path / "hero5_ISOG.csv").write_text("0\n1.5\n")
    got = readers.read_stream_csv(spark, str(tmp_path / "*.csv")).collect()
    assert {(r["session_id"], r["stream"], len(r["data"])) for r in got} == {("hero5", "GPS5", 5), ("hero5", "ISOG", 1)}


def test_stream_csv_keeps_positions_and_all_columns(spark, tmp_path):
    (tmp_path / "hero5_GPS5.csv").write_text("0,1,2,3,4\n1.0,,3.0,4.0,5.0\n1.0,2.0,,,\n")
    (tmp_path / "hero9_WIDE.csv").write_text(",".join(map(str, range(11))) + "\n" + ",".join(map(str, range(100, 111))) + "\n")
    (tmp_path / "lone_clip.csv").write_text("0,1\n7.5,8.5\n")
    got = {(r["session_id"], r["stream"], tuple(r["data"])) for r in readers.read_stream_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {
        ("hero5", "GPS5", (1.0, None, 3.0, 4.0, 5.0)), ("hero5", "GPS5", (1.0, 2.0)), ("hero9", "WIDE", tuple(float(i) for i in range(100, 111))), ("lone_clip", None, (7.5, 8.5)),
    }


def test_process_meta(spark, tmp_path):
    (tmp_path / "process_meta_a.jpg.json").write_text('{"telemetry": {"lat": 1.5},\n "view_meta": {"front": {"detections": [{"class_name": "Crack", "conf": 0.5}]}}}')
    (tmp_path / "process_meta_b.jpg.json").write_text("{broken")
    meta = readers.read_process_meta(spark, str(tmp_path / "*.json"))
    frames = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "filename string")
    got = {r["filename"]: r["telemetry"] for r in readers.attach_process_meta(frames, meta).collect()}
    assert got["a.jpg"]["lat"] == 1.5 and (got["b.jpg"] is None or got["b.jpg"]["lat"] is None) and got["c.jpg"] is None
    assert readers.flatten_frame_results(meta).first()["class_name"] == "Crack"
