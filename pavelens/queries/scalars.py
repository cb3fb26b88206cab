"""Value rules over the given tables."""

from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import detection, manifest
from . import feeds
from .registry import query, r, rnd, table

TEXTS = "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN ' 12.5 ' WHEN 3 THEN NULL ELSE CAST(event_id AS VARCHAR) END"


@query("safe_double", f"""SELECT event_id, TRY_CAST(nullif(trim({TEXTS}), '') AS DOUBLE) AS plain,
  coalesce(TRY_CAST(nullif(trim({TEXTS}), '') AS DOUBLE), -1.0::DOUBLE) AS filled FROM events""")
def safe_double(spark, sf):
    i = F.col("event_id")
    text = (F.when(i % 5 == 0, "").when(i % 5 == 1, "n/a").when(i % 5 == 2, " 12.5 ").when(i % 5 == 3, F.lit(None).cast("string"))
            .otherwise(i.cast("string")))
    return table(spark, sf, "events").select("event_id", sc.safe_double(text).alias("plain"), sc.safe_double(text, -1.0).alias("filled"))


@query("sanitize", """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN NULL ELSE value END AS v,
  CASE WHEN event_id % 2 = 0 THEN '<binary data: 2000 bytes>' ELSE event_type END AS b FROM events""")
def sanitize(spark, sf):
    i = F.col("event_id")
    v = F.when(i % 4 == 0, F.lit(float("nan"))).when(i % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    blob = F.when(i % 2 == 0, F.repeat(F.lit("x"), 2000)).otherwise(F.col("event_type"))
    return sc.sanitize(table(spark, sf, "events").select("event_id", v.alias("v"), blob.cast("binary").alias("b")))


@query("format_seconds", """
WITH v AS (SELECT event_id, greatest(0.0, value * 37 - 500) AS s FROM events)
SELECT event_id, printf('%02d:%02d:%06.3f', CAST(floor(s / 3600) AS INTEGER), CAST(floor((s - 3600 * floor(s / 3600)) / 60) AS INTEGER), s - 60 * floor(s / 60)) AS t FROM v""")
def format_seconds(spark, sf):
    return table(spark, sf, "events").select("event_id", sc.format_seconds(F.col("value") * 37 - 500).alias("t"))


@query("dms_to_decimal", f"""
SELECT event_id, {r("(event_id % 90 + (event_id % 60) / 60.0::DOUBLE + value / 3600.0) * CASE WHEN event_id % 4 IN (1, 3) THEN -1 ELSE 1 END")} AS deg FROM events""")
def dms_to_decimal(spark, sf):
    i = F.col("event_id")
    ref = F.element_at(F.array(*[F.lit(x) for x in "NSEW"]), (i % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", rnd(sc.dms_to_decimal(i % 90, i % 60, F.col("value"), ref)).alias("deg"))


@query("coalesce_metadata", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'A' || event_id ELSE 'N/A' END ELSE 'L' || event_id END AS latitude,
  CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'B' || event_id ELSE 'N/A' END ELSE 'M' || event_id END AS longitude,
  CASE WHEN event_id % 5 = 0 THEN 'orig' WHEN event_id % 7 = 0 THEN 'made' ELSE 'Unknown Date' END AS taken_at,
  CASE WHEN event_id % 11 = 0 THEN 'N/A' ELSE 'high' END AS altitude,
  CASE WHEN event_id % 2 = 0 THEN 'day noon' ELSE 'both' END AS gps_datetime FROM events""")
def coalesce_metadata(spark, sf):
    i, c = F.col("event_id"), F.concat
    s = i.cast("string")
    tags = table(spark, sf, "events").select(
        "event_id",
        F.when(i % 3 != 0, c(F.lit("L"), s)).alias("latitude"), F.when(i % 3 != 0, c(F.lit("M"), s)).alias("longitude"),
        F.when(i % 2 == 0, c(F.lit("A"), s, F.lit("  B"), s)).otherwise("lonely").alias("composite_position"),
        F.when((i % 7 == 0) & (i % 5 != 0), "made").otherwise("").alias("create_date"), F.when(i % 5 == 0, "orig").alias("original_date"),
        F.lit("").alias("altitude"), F.when(i % 11 != 0, "high").alias("composite_altitude"),
        F.when(i % 2 == 0, "day").alias("gps_date"), F.lit("noon").alias("gps_time"), F.lit("both").alias("composite_datetime"))
    return sc.coalesce_metadata(tags).select("event_id", "latitude", "longitude", "taken_at", "altitude", "gps_datetime")


@query("is_pothole", "SELECT p_partkey, coalesce(contains(lower(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' PotHole' WHEN p_partkey % 3 = 1 THEN p_name END), 'pothole'), false) AS hit FROM part")
def is_pothole(spark, sf):
    k = F.col("p_partkey")
    cls = F.when(k % 3 == 0, F.concat("p_name", F.lit(" PotHole"))).when(k % 3 == 1, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", sc.is_pothole(cls).alias("hit"))


@query("is_defect", "SELECT vec_id, label > 1 AS hit FROM embeddings")
def is_defect(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", sc.is_defect(F.col("label")).alias("hit"))


@query("visible", "SELECT event_id FROM events WHERE NOT coalesce(CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END, false)")
def visible(spark, sf):
    i = F.col("event_id")
    return sc.visible(table(spark, sf, "events").select("event_id", F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("hidden"))).select("event_id")


@query("valid_resolution", "SELECT o_orderkey FROM orders WHERE o_orderkey % 6000 BETWEEN 64 AND 5312 AND o_custkey * 3 BETWEEN 64 AND 2988")
def valid_resolution(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 6000).alias("width"), (F.col("o_custkey") * 3).alias("height"))
    return manifest.valid_resolution(o).select("o_orderkey")


@query("valid_bbox", "WITH " + feeds.BOXES_SQL + """
SELECT frame_id, x - 5 AS x, y, w - 2 AS w, h FROM boxes WHERE w - 2 > 0 AND h > 0 AND x - 5 >= 0 AND y >= 0 AND x - 5 + w - 2 <= 400 AND y + h <= 300""")
def valid_bbox(spark, sf):
    b = feeds.boxes(spark, sf).withColumn("x", F.col("x") - 5).withColumn("w", F.col("w") - 2)
    return detection.valid_bbox(b, F.lit(400), F.lit(300)).select("frame_id", "x", "y", "w", "h")


@query("bbox_convert", f"""
WITH b AS (SELECT l_orderkey AS k, l_extendedprice / 1000 AS x1, l_tax * 50 AS y1, l_extendedprice / 1000 + l_quantity / 4 AS x2, l_tax * 50 + l_quantity / 8 AS y2 FROM lineitem)
SELECT k, CAST(round_even(x1, 0) AS INTEGER) AS x, CAST(round_even(y1, 0) AS INTEGER) AS y, CAST(round_even(x2 - x1, 0) AS INTEGER) AS w, CAST(round_even(y2 - y1, 0) AS INTEGER) AS h,
  {r('(x1 + x2) / 2 / 640')} AS cx, {r('(y1 + y2) / 2 / 480')} AS cy, {r('(x2 - x1) / 640')} AS nw, {r('(y2 - y1) / 480')} AS nh FROM b""")
def bbox_convert(spark, sf):
    c = F.col
    b = table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("k"), (c("l_extendedprice") / 1000).alias("x1"), (c("l_tax") * 50).alias("y1"),
        (c("l_extendedprice") / 1000 + c("l_quantity") / 4).alias("x2"), (c("l_tax") * 50 + c("l_quantity") / 8).alias("y2"))
    p = [c(n) for n in ("x1", "y1", "x2", "y2")]
    px, n = sc.xyxy_to_xywh(*p), sc.xyxy_to_cxcywh(*p, F.lit(640), F.lit(480))
    return b.select("k", *[px[f].alias(f) for f in "xywh"], rnd(n["cx"]).alias("cx"), rnd(n["cy"]).alias("cy"), rnd(n["w"]).alias("nw"), rnd(n["h"]).alias("nh"))


@query("map_class", """SELECT vec_id, CASE label WHEN 0 THEN 'Crack' WHEN 1 THEN 'Edge Damage' WHEN 2 THEN 'Faded Line Marking' WHEN 3 THEN 'Patch Deformation'
  WHEN 4 THEN 'Ponding Water' WHEN 5 THEN 'Pothole' WHEN 6 THEN 'Road Debris' ELSE 'Vegetation Obstruction' END AS class_label FROM embeddings WHERE label < 8""")
def map_class(spark, sf):
    return detection.map_class(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("class_id"))).select("vec_id", "class_label")


@query("quality_gate", """SELECT event_id, CASE WHEN value < 100 THEN 'motion_blur' WHEN value / 2 < 80 THEN 'underexposed' WHEN value / 2 > 235 THEN 'overexposed' END AS reject_reason,
  value >= 100 AND value / 2 >= 80 AND value / 2 <= 235 AS accepted FROM events""")
def quality_gate(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("value").alias("blur_score"), (F.col("value") / 2).alias("luminance"))
    return manifest.quality_gate(ev, 100.0, 80.0, 235.0).select("event_id", "reject_reason", "accepted")


@query("severity", "SELECT l_orderkey AS k, l_quantity * 50 AS area, CASE WHEN l_quantity * 50 < 500 THEN 'minor' WHEN l_quantity * 50 <= 2000 THEN 'moderate' ELSE 'severe' END AS grade FROM lineitem")
def severity(spark, sf):
    a = F.col("l_quantity") * 50
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), a.alias("area"), sc.severity(a).alias("grade"))


@query("drift_class", "SELECT c_custkey, CASE WHEN abs(c_acctbal) >= 6000 THEN 'red' WHEN abs(c_acctbal) >= 2000 THEN 'orange' ELSE 'green' END AS light FROM customer")
def drift_class(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sc.drift_class(F.col("c_acctbal"), 2000.0, 6000.0).alias("light"))


@query("area_rating", "SELECT event_id, CASE WHEN value / 15 < 5 THEN 'EXCELLENT' WHEN value / 15 < 10 THEN 'GOOD' WHEN value / 15 < 20 THEN 'DRIFT' ELSE 'CHECK SETUP' END AS rating FROM events")
def area_rating(spark, sf):
    return table(spark, sf, "events").select("event_id", sc.area_rating(F.col("value") / 15).alias("rating"))


@query("depth_color", "WITH " + feeds.POINTS_SQL + """, c AS (SELECT idx, severity AS s, list_extract([128, 0, 255, 255, 0, 0, 255, 255, 0, 0], class + 1) AS cr,
  list_extract([128, 0, 0, 165, 0, 255, 255, 0, 0, 0], class + 1) AS cg, list_extract([128, 0, 0, 0, 255, 0, 0, 255, 0, 0], class + 1) AS cb FROM points)
SELECT idx, CAST(floor(cr * least(1.0, s * 0.7 + 0.3)) AS INTEGER) AS r, CAST(floor(cg * least(1.0, s * 0.7 + 0.3)) AS INTEGER) AS g, CAST(floor(cb * least(1.0, s * 0.7 + 0.3)) AS INTEGER) AS b FROM c""")
def depth_color(spark, sf):
    col = sc.depth_color(F.col("class"), F.col("severity"))
    return feeds.points(spark, sf).select("idx", *[col[x].alias(x) for x in "rgb"])


@query("within_road", "WITH " + feeds.BOXES_SQL + " SELECT frame_id, x, y FROM boxes WHERE x - 3 >= 0 AND y >= 0 AND x + w <= 300 AND y + h <= 250")
def within_road(spark, sf):
    b = feeds.boxes(spark, sf).select(
        "frame_id", "x", "y", (F.col("x") - 3).alias("x_min"), F.col("y").alias("y_min"), (F.col("x") + F.col("w")).alias("x_max"), (F.col("y") + F.col("h")).alias("y_max"))
    return detection.within_road(b, 300.0, 250.0).select("frame_id", "x", "y")
