"""Streams over events written as files, compared with the same question in batch SQL."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import folds, results
from ..operators import telemetry as tl
from . import feeds
from .registry import query, r, rnd, sql_hav, table
from .telemetry import W


def _dir(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _live(spark, sf):
    """JSON files of live events made from the events table, as a stream."""
    i = F.col("event_id")
    defect = F.struct(F.col("event_type").alias("class"), F.lit(0.9).alias("conf"), F.col("value").alias("area_sqm"), F.when(i % 3 == 0, "minor").otherwise("severe").alias("severity"))
    ev = table(spark, sf, "events").select(
        F.when(i % 7 == 0, "item_error").otherwise("update").alias("type"), F.col("user_id").cast("string").alias("source"),
        F.concat(F.lit("f"), (i % 4000).cast("string")).alias("filename"), F.col("ts").cast("timestamp").alias("event_time"),
        F.when(i % 5 == 0, F.array(defect, defect)).otherwise(F.array(defect)).alias("defects"), F.col("value").alias("lat"))
    folder = _dir(spark, "live")
    ev.repartitionByRange(4, "event_time").write.json(folder)
    return results.stream_results(spark, folder, 2)


@query("stream_results", "SELECT 'f' || (event_id % 4000) AS filename, CASE WHEN event_id % 7 = 0 THEN 'item_error' ELSE 'update' END AS type, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS defects FROM events")
def stream_results(spark, sf):
    out = _live(spark, sf).select("filename", "type", F.size("defects").alias("defects"))
    return results.run_available(out, _dir(spark, "w1"), "append")


@query("stream_batch_summary", "SELECT event_type AS class, CASE WHEN event_id % 3 = 0 THEN 'minor' ELSE 'severe' END AS severity, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS defects FROM events WHERE event_id % 7 <> 0 GROUP BY 1, 2")
def stream_batch_summary(spark, sf):
    return results.run_available(results.stream_batch_summary(_live(spark, sf)), _dir(spark, "w2"), "complete")


@query("stream_dedupe", "SELECT DISTINCT 'f' || (event_id % 4000) AS filename FROM events")
def stream_dedupe(spark, sf):
    # a watermark longer than the data keeps the first result of every frame
    return results.run_available(results.stream_dedupe(_live(spark, sf), "60 days").select("filename"), _dir(spark, "w5"), "append")


@query("stream_latest_results", "SELECT 'f' || (event_id % 4000) AS filename, arg_max(value, ts) AS lat FROM events GROUP BY 1")
def stream_latest_results(spark, sf):
    out = results.latest_results(_live(spark, sf).select("filename", "event_time", "lat")).select("filename", "lat")
    return results.run_available(out, _dir(spark, "w5b"), "complete")


@query("stream_progress", "WITH a AS (SELECT count(*) AS done, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 1e3::DOUBLE AS e FROM events) SELECT done, 2000000 - done AS left, round(e, 3) AS elapsed_sec, CAST(ceil((2000000 - done) * (e / done)) AS BIGINT) AS eta_sec FROM a")
def stream_progress(spark, sf):
    out = results.run_available(results.stream_progress(_live(spark, sf), 2_000_000), _dir(spark, "w7"), "complete")
    return out.select("done", F.col("left").cast("long").alias("left"), F.round("elapsed_sec", 3).alias("elapsed_sec"), "eta_sec")


def _event_stream(spark, sf, build, parts=3):
    """A table as a stream of files in event order: an empty stream, and after each step that is taken the files of one more piece are there, all of them for one batch."""
    folder = _dir(spark, "feed")
    df = build(spark, sf)
    schema = df.drop("_piece").schema
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)

    def pieces():
        for k in range(parts):
            df.where(F.col("_piece") == k).drop("_piece").write.mode("append").parquet(folder)
            yield k

    return stream, pieces()


def _events(spark, sf):
    return table(spark, sf, "events").agg(F.max("event_id") + 1).first()[0]


def _piece(spark, sf, col):
    n = _events(spark, sf)
    own = F.least(F.floor(F.col(col) * 3 / n), F.lit(2))
    return F.least(own + F.when(F.col(col) % 7 == 0, 1).otherwise(0), F.lit(2))


FAIL_SQL = """WITH n AS (SELECT event_type AS source, event_id AS seq, value % 10 < 8 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
g AS (SELECT *, coalesce(max(CASE WHEN NOT failed THEN i END) OVER (PARTITION BY source ORDER BY seq), 0) AS ok FROM n)
SELECT source, seq, i - ok AS failures FROM g WHERE failed AND i - ok = 6"""


def _failures(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("seq"), (F.col("value") % 10 < 8).alias("failed"), _piece(spark, sf, "event_id").alias("_piece"))


@query("failure_breaches", FAIL_SQL)
def failure_breaches(spark, sf):
    return folds.failure_breaches(_failures(spark, sf).drop("_piece"), 5)


@query("stream_failures", FAIL_SQL)
def stream_failures(spark, sf):
    folder = _dir(spark, "w3")
    return _folded(spark, _event_stream(spark, sf, _failures), folder, folds.failure_fold(5).lasting(_events(spark, sf) / 3 + 1))


def _folded(spark, feed, folder, fold):
    """Output of a fold over all available rows, piece by piece, and of its end. Pieces hand every 7th row on to the next one, so rows come up to a piece late."""
    rows, pieces = feed
    for _ in pieces:
        q = folds.run_fold(rows, folder, fold)
        q.awaitTermination()
    folds.close_fold(spark, folder, fold, q, rows.schema)
    return folds.fold_output(spark, folder)


HEALTH_SQL = "WITH " + feeds.SAMPLES_SQL + f""", flagged AS (SELECT *, max(CASE WHEN stream = 'GPS9' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS has9 FROM gps_raw),
used AS (SELECT * FROM flagged WHERE (stream = 'GPS9') = (has9 = 1)),
step AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, time_sec - lag(time_sec) OVER w AS dt FROM used WINDOW w AS ({W.replace('frame_idx', 'seq')})),
err AS (SELECT *, {sql_hav('plat','plon','lat','lon')} / dt AS v FROM step),
agg AS (SELECT session_id, count(*) AS samples, coalesce(avg(CASE WHEN dt > 0 AND (speed > 1 OR v > 1) THEN abs(v - speed) END), 0) AS ae,
  coalesce(max(CASE WHEN dt > 0 AND (speed > 1 OR v > 1) THEN abs(v - speed) END), 0) AS me,
  count(CASE WHEN dt > 0 AND stream = 'GPS9' AND fix < 3 THEN 1 END) AS bf, count(CASE WHEN dt > 0 AND stream = 'GPS9' AND dop > 3 THEN 1 END) AS bd FROM err GROUP BY session_id),
imu AS (SELECT session_id, avg(abs(1 - sqrt(pow(value / 1000.0, 2) + 0.9 * 0.9 + 0.1 * 0.1))) AS ge FROM frames GROUP BY 1)
SELECT session_id, samples, {r('ae', 3)} AS avg_gps_speed_error_ms, {r('CASE WHEN samples > 1 THEN bf::DOUBLE / samples ELSE 0.0 END', 3)} AS bad_fix_ratio, {r('me', 2)} AS max_speed_error,
  {r('CASE WHEN samples > 1 THEN greatest(0.0, least(100.0, 100.0 - (ae * 5 + bf::DOUBLE / samples * 40 + bd::DOUBLE / samples * 15 + CASE WHEN me > 15 THEN 15 ELSE 0 END))) ELSE 100.0 END', 4)} AS gps_score,
  {r('ge', 4)} AS avg_grav_mag_error, {r('greatest(0.0, least(100.0, 100.0 - 200 * ge))', 4)} AS imu_score FROM agg JOIN imu USING (session_id)"""


@query("stream_telemetry_health", HEALTH_SQL)
def stream_telemetry_health(spark, sf):
    build = lambda spark, sf: feeds.samples(spark, sf).withColumn("_piece", _piece(spark, sf, "seq"))
    out = _folded(spark, _event_stream(spark, sf, build), _dir(spark, "w4"), folds.health_fold().lasting(_events(spark, sf) / 6 + 1))
    return out.select("session_id", "samples", "avg_gps_speed_error_ms", "bad_fix_ratio", "max_speed_error", rnd("gps_score", 4).alias("gps_score"), "avg_grav_mag_error", rnd("imu_score", 4).alias("imu_score"))


@query("stream_outlier_filter", "WITH RECURSIVE " + feeds.FRAMES_SQL + f""", numbered AS MATERIALIZED (
  SELECT session_id, frame_idx, time_sec, lat, lon, speed, row_number() OVER ({W}) AS rn FROM frames),
walk AS (
  SELECT session_id, rn, frame_idx, time_sec AS kt, lat AS kla, lon AS klo, true AS kept FROM numbered WHERE rn = 1
  UNION ALL
  SELECT session_id, rn, frame_idx, CASE WHEN keep THEN time_sec ELSE kt END, CASE WHEN keep THEN lat ELSE kla END, CASE WHEN keep THEN lon ELSE klo END, keep
  FROM (SELECT b.session_id, b.rn, b.frame_idx, b.time_sec, b.lat, b.lon, w.kt, w.kla, w.klo,
               NOT ({sql_hav('w.kla','w.klo','b.lat','b.lon')} / (b.time_sec - w.kt) > 1.0 AND abs({sql_hav('w.kla','w.klo','b.lat','b.lon')} / (b.time_sec - w.kt) - b.speed) > 8.0) AS keep
        FROM walk w JOIN numbered b ON b.session_id = w.session_id AND b.rn = w.rn + 1))
SELECT session_id, frame_idx AS seq FROM walk WHERE kept""")
def stream_outlier_filter(spark, sf):
    def build(spark, sf):
        f = feeds.frames(spark, sf)
        return f.select("session_id", F.col("frame_idx").alias("seq"), "time_sec", "lat", "lon", "speed", _piece(spark, sf, "frame_idx").alias("_piece"))
    folder = _dir(spark, "w6")
    return _folded(spark, _event_stream(spark, sf, build), folder, folds.outlier_fold().lasting(_events(spark, sf) / 6 + 1)).select("session_id", "seq")
