"""Manifest checks over frames derived from events."""

from pyspark.sql import functions as F

from ..operators import manifest as mf
from ..plans.manifest_flow import manifest_features, manifest_report as report_plan
from .registry import query, r, rnd, sql_bearing, table

MANIFEST_SQL = """m AS (
  SELECT event_id, user_id, 'frame_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS frame_id,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE 'frames/' || event_id || '.jpg' END AS image_path,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE printf('%.5f', (event_id % 1000) * 1e-5::DOUBLE - 32.4::DOUBLE) END AS latitude,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE printf('%.5f', (event_id % 7) * 1e-5::DOUBLE + 151.75::DOUBLE) END AS longitude,
    CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'tall' ELSE '1.600' END AS camera_height_m,
    CASE WHEN event_type IN ('view', 'click') THEN '' ELSE '1.5' END AS pitch,
    CASE WHEN event_type = 'view' THEN '' ELSE '0.5' END AS roll, CASE WHEN event_type = 'view' THEN '' ELSE '9' END AS yaw,
    event_id % 13 <> 0 AS file_exists, event_id % 19 <> 0 AS readable, value AS blur_score FROM events),
v AS (SELECT *, CASE WHEN image_path = '' THEN 'invalid_missing_image_path' WHEN NOT file_exists THEN 'invalid_image_file_not_found'
    WHEN NOT readable THEN 'invalid_image_unreadable' WHEN TRY_CAST(camera_height_m AS DOUBLE) IS NULL THEN 'invalid_missing_camera_height'
    WHEN blur_score < 100 THEN 'warning_low_quality_blurry'
    WHEN pitch = '' OR roll = '' OR yaw = '' THEN 'ready_for_basic_homography_needs_orientation_data' ELSE 'ready_for_full_homography' END AS homography_status,
    CASE WHEN image_path = '' OR NOT file_exists OR NOT readable THEN '' ELSE concat_ws(';', CASE WHEN latitude = '' THEN 'latitude' END, CASE WHEN longitude = '' THEN 'longitude' END,
      CASE WHEN camera_height_m = '' THEN 'camera_height_m' END, CASE WHEN pitch = '' THEN 'pitch' END, CASE WHEN roll = '' THEN 'roll' END, CASE WHEN yaw = '' THEN 'yaw' END) END AS missing_metadata FROM m)"""


def manifest(spark, sf):
    i = F.col("event_id")
    num = lambda c: F.format_string("%.5f", c)
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        i, "user_id", F.concat(F.lit("frame_"), F.lpad(i.cast("string"), 9, "0")).alias("frame_id"),
        F.when(i % 17 == 0, "").otherwise(F.concat(F.lit("frames/"), i.cast("string"), F.lit(".jpg"))).alias("image_path"),
        F.when(i % 5 == 0, "").otherwise(num((i % 1000) * F.lit(1e-5) - 32.4)).alias("latitude"),
        F.when(i % 5 == 0, "").otherwise(num((i % 7) * F.lit(1e-5) + 151.75)).alias("longitude"),
        F.when(i % 9 == 0, "").when(i % 9 == 1, "tall").otherwise("1.600").alias("camera_height_m"),
        F.when(t.isin("view", "click"), "").otherwise("1.5").alias("pitch"), F.when(t == "view", "").otherwise("0.5").alias("roll"),
        F.when(t == "view", "").otherwise("9").alias("yaw"),
        (i % 13 != 0).alias("file_exists"), (i % 19 != 0).alias("readable"), F.col("value").alias("blur_score"))


@query("validate_manifest", "WITH " + MANIFEST_SQL + " SELECT frame_id, homography_status, missing_metadata FROM v")
def validate_manifest(spark, sf):
    out = mf.validate_manifest(manifest(spark, sf))
    return out.select("frame_id", "homography_status", F.concat_ws(";", "missing_metadata").alias("missing_metadata"))


@query("ready_frames", "WITH " + MANIFEST_SQL + " SELECT frame_id FROM v WHERE homography_status LIKE 'ready%'")
def ready_frames(spark, sf):
    return mf.ready_frames(mf.validate_manifest(manifest(spark, sf))).select("frame_id")


REPORT = "WITH " + MANIFEST_SQL + """
SELECT 'total' AS line, count(*) AS frames FROM v UNION ALL SELECT 'ready', count(*) FROM v WHERE homography_status LIKE 'ready%'
UNION ALL SELECT 'excluded', count(*) FROM v WHERE homography_status NOT LIKE 'ready%' UNION ALL SELECT 'status:' || homography_status, count(*) FROM v GROUP BY 1"""


@query("status_counts", REPORT)
def status_counts(spark, sf):
    return mf.status_counts(mf.validate_manifest(manifest(spark, sf)))


@query("manifest_report", REPORT)
def manifest_report(spark, sf):
    return report_plan(manifest(spark, sf))


# Where the usable frames are and which way the camera looked, as GeoJSON points.
@query("manifest_features", "WITH " + MANIFEST_SQL + f""", n AS (
  SELECT event_id, user_id, frame_id, coalesce(TRY_CAST(nullif(latitude, '') AS DOUBLE), 0.0) AS la, coalesce(TRY_CAST(nullif(longitude, '') AS DOUBLE), 0.0) AS lo FROM v WHERE homography_status LIKE 'ready%'),
p AS (SELECT *, last_value(CASE WHEN la <> 0 AND lo <> 0 THEN la END IGNORE NULLS) OVER b AS pla, last_value(CASE WHEN la <> 0 AND lo <> 0 THEN lo END IGNORE NULLS) OVER b AS plo FROM n
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE WHEN la <> 0 AND lo <> 0 AND pla IS NOT NULL THEN {sql_bearing('pla', 'plo', 'la', 'lo')} END AS own FROM p),
h AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 0.0) AS h FROM o)
SELECT user_id AS session_id, frame_id, {r('h', 4)} AS heading, la AS lat, lo AS lon,
  '{{"type":"Feature","properties":{{"type":"camera","filename":"' || frame_id || '"}},"geometry":{{"type":"Point","coordinates":[' || printf('%.5f', lo) || ',' || printf('%.5f', la) || ']}}}}' AS feature
FROM h WHERE la <> 0 AND lo <> 0""")
def manifest_features_q(spark, sf):
    out = manifest_features(manifest(spark, sf).withColumnRenamed("user_id", "session_id").withColumnRenamed("event_id", "frame_idx"))
    fixed = lambda c: F.format_string("%.5f", c)
    text = F.regexp_replace("feature", r"\[[^\]]*\]", "@")
    coords = F.concat(F.lit("["), fixed(F.col("lon")), F.lit(","), fixed(F.col("lat")), F.lit("]"))
    return out.select("session_id", "frame_id", rnd("heading", 4).alias("heading"), "lat", "lon", F.replace(text, F.lit("@"), coords).alias("feature"))
