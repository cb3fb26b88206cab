"""Survey-shaped views over the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

# Frames: one session per user, revisited places every 1000 ids; every 11th fix is missing.
FRAMES_SQL = """frames AS (
  SELECT user_id AS session_id, event_id AS frame_idx, event_id * 0.5::DOUBLE AS time_sec,
         CAST(event_id % 1000 AS DOUBLE) * 1e-5::DOUBLE - 32.4::DOUBLE AS lat,
         CAST(event_id % 7 AS DOUBLE) * 1e-5::DOUBLE + 151.75::DOUBLE AS lon,
         CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 1000 AS DOUBLE) * 1e-5::DOUBLE - 32.4::DOUBLE END AS fix_lat,
         CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 7 AS DOUBLE) * 1e-5::DOUBLE + 151.75::DOUBLE END AS fix_lon,
         value / 10.0::DOUBLE AS speed, value, event_type, ts
  FROM events)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    lat = (i % 1000).cast("double") * 1e-5 - 32.4
    lon = (i % 7).cast("double") * 1e-5 + 151.75
    known = i % 11 != 0
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), i.alias("frame_idx"), (i * F.lit(0.5)).alias("time_sec"),
        lat.alias("lat"), lon.alias("lon"), F.when(known, lat).alias("fix_lat"), F.when(known, lon).alias("fix_lon"),
        (F.col("value") / 10.0).alias("speed"), "value", "event_type", F.col("ts").cast("timestamp").alias("ts"),
    )


# Telemetry samples: every third user has GPS9 (and some GPS5), the others GPS5; GRAV for all.
SAMPLES_SQL = FRAMES_SQL + """, gps_raw AS (
  SELECT session_id, frame_idx AS seq, time_sec,
         CASE WHEN session_id % 3 = 0 AND frame_idx % 5 <> 0 THEN 'GPS9' ELSE 'GPS5' END AS stream,
         CASE WHEN frame_idx % 13 = 0 THEN 0.0::DOUBLE ELSE lat END AS lat, lon, speed,
         CAST(1 + frame_idx % 6 AS DOUBLE) AS dop, CAST(frame_idx % 4 AS DOUBLE) AS fix
  FROM frames)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    i = F.col("frame_idx")
    nine = (F.col("session_id") % 3 == 0) & (i % 5 != 0)
    lat = F.when(i % 13 == 0, 0.0).otherwise(F.col("lat"))
    base = [lat, F.col("lon"), F.lit(10.0), F.col("speed"), F.col("speed")]
    more = [F.lit(0.0), F.lit(0.0), (i % 6 + 1).cast("double"), (i % 4).cast("double")]
    gps = f.select(
        "session_id", F.when(nine, "GPS9").otherwise("GPS5").alias("stream"), i.alias("seq"), "time_sec",
        F.when(nine, F.array(*base, *more)).otherwise(F.array(*base)).alias("data"),
    )
    grav = f.select(
        "session_id", F.lit("GRAV").alias("stream"), i.alias("seq"), "time_sec",
        F.array(F.col("value") / 1000.0, F.lit(0.9), F.lit(0.1)).alias("data"),
    )
    return gps.unionByName(grav)


# Points of a cloud from the embedding vectors.
POINTS_SQL = """points AS (
  SELECT vec_id AS idx, vec_id % 5 AS frame_id, embedding[1]::DOUBLE * 10.0::DOUBLE AS x, embedding[2]::DOUBLE AS y,
         embedding[3]::DOUBLE * 10.0::DOUBLE AS z, label AS class, abs(embedding[4]::DOUBLE) AS severity,
         abs(embedding[5]::DOUBLE) AS confidence
  FROM embeddings)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), (F.col("vec_id") % 5).alias("frame_id"), (e(0) * 10.0).alias("x"), e(1).alias("y"),
        (e(2) * 10.0).alias("z"), F.col("label").alias("class"), F.abs(e(3)).alias("severity"),
        F.abs(e(4)).alias("confidence"),
    )


# Evaluation pixels from lineitem.
PIXELS_SQL = """pixels AS (
  SELECT l_orderkey % 50 AS image_id, CAST(l_partkey % 8 AS INTEGER) AS target_class,
         CAST((l_partkey + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END) % 8 AS INTEGER) AS pred_class,
         l_quantity AS target_depth, l_quantity * (1 + l_discount) AS pred_depth,
         l_tax AS target_severity, l_discount AS pred_severity
  FROM lineitem)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        (c("l_orderkey") % 50).alias("image_id"), (c("l_partkey") % 8).cast("int").alias("target_class"),
        ((c("l_partkey") + F.when(c("l_suppkey") % 10 == 0, 1).otherwise(0)) % 8).cast("int").alias("pred_class"),
        c("l_quantity").alias("target_depth"), (c("l_quantity") * (1 + c("l_discount"))).alias("pred_depth"),
        c("l_tax").alias("target_severity"), c("l_discount").alias("pred_severity"),
    )


# Boxes of detections from lineitem. det_key is not unique on purpose: the table has no row key.
BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS frame_id, l_returnflag AS class, 1 - l_discount AS confidence,
         CAST(l_partkey % 400 AS INTEGER) AS x, CAST(l_suppkey % 300 AS INTEGER) AS y,
         CAST(l_quantity AS INTEGER) AS w, CAST(l_linenumber * 5 AS INTEGER) AS h,
         l_extendedprice AS price, l_tax AS tax
  FROM lineitem)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("frame_id"), c("l_returnflag").alias("class"), (1 - c("l_discount")).alias("confidence"),
        (c("l_partkey") % 400).cast("int").alias("x"), (c("l_suppkey") % 300).cast("int").alias("y"),
        c("l_quantity").cast("int").alias("w"), (c("l_linenumber") * 5).cast("int").alias("h"),
        c("l_extendedprice").alias("price"), c("l_tax").alias("tax"),
    )


# Mask cells from orders: a small raster per customer.
CELLS_SQL = """cells AS (
  SELECT DISTINCT o_custkey AS det, CAST(o_orderkey % 12 AS INTEGER) AS row,
         CAST((o_orderkey // 12) % 12 AS INTEGER) AS col
  FROM orders)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "orders").select(
        c("o_custkey").alias("det"), (c("o_orderkey") % 12).cast("int").alias("row"),
        (F.floor(c("o_orderkey") / 12) % 12).cast("int").alias("col"),
    ).distinct()
