"""Path queries over the events table."""

from pyspark.sql import functions as F

from ..operators import trajectory as tr
from ..operators.blocks import scan, series
from ..operators.manifest import carry_heading as carry
from . import feeds
from .registry import query, r, rnd, sql_bearing, sql_hav, table

W = "PARTITION BY session_id ORDER BY frame_idx"
# blocks of a few hundred positions, so that sessions cross many borders
S = lambda width=700: series("session_id", "frame_idx", width)


@query("arc_length", "WITH " + feeds.FRAMES_SQL + f""", d AS (
  SELECT *, {sql_hav(f'lag(lat) OVER ({W})', f'lag(lon) OVER ({W})', 'lat', 'lon')} AS d FROM frames)
SELECT session_id, frame_idx, {r(f'sum(coalesce(d, 0)) OVER ({W})', 4)} AS arc_m FROM d""")
def arc_length(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", "lat", "lon")
    return tr.arc_length(f, S(), geodesic=True).select("session_id", "frame_idx", rnd("arc_m", 4).alias("arc_m"))


@query("local_xy", "WITH " + feeds.FRAMES_SQL + f""", o AS (
  SELECT *, first_value(lat) OVER ({W}) AS la0, first_value(lon) OVER ({W}) AS lo0 FROM frames)
SELECT session_id, frame_idx, {r('radians(lon - lo0) * cos(radians(la0)) * 6378137.0', 4)} AS x, {r('radians(lat - la0) * 6378137.0', 4)} AS y FROM o""")
def local_xy(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", "lat", "lon")
    return tr.local_xy(f, S()).select("session_id", "frame_idx", rnd("x", 4).alias("x"), rnd("y", 4).alias("y"))


@query("baseline_heading", "WITH " + feeds.FRAMES_SQL + f""", p AS (
  SELECT session_id, frame_idx, value AS x, speed * speed AS y,
         sum(floor(frame_idx % 4) * 1.5::DOUBLE) OVER ({W}) AS arc FROM frames),
b AS (SELECT *, coalesce(last_value(frame_idx) OVER back, first_value(frame_idx) OVER ({W})) AS ib,
   coalesce(first_value(frame_idx) OVER fwd, last_value(frame_idx) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS jf
   FROM p WINDOW back AS (PARTITION BY session_id ORDER BY arc RANGE BETWEEN UNBOUNDED PRECEDING AND 6.0 PRECEDING),
   fwd AS (PARTITION BY session_id ORDER BY arc RANGE BETWEEN 6.0 FOLLOWING AND UNBOUNDED FOLLOWING)),
ids AS (SELECT a.session_id, a.frame_idx,
   coalesce((SELECT max(q.frame_idx) FROM p q WHERE q.session_id = a.session_id AND q.arc <= a.arc - 6.0), (SELECT min(q.frame_idx) FROM p q WHERE q.session_id = a.session_id)) AS i,
   coalesce((SELECT min(q.frame_idx) FROM p q WHERE q.session_id = a.session_id AND q.arc >= a.arc + 6.0), (SELECT max(q.frame_idx) FROM p q WHERE q.session_id = a.session_id)) AS j FROM p a),
h AS (SELECT d.session_id, d.frame_idx, degrees(atan2(f.x - e.x, f.y - e.y)) AS g FROM ids d
   JOIN p e ON e.session_id = d.session_id AND e.frame_idx = d.i JOIN p f ON f.session_id = d.session_id AND f.frame_idx = d.j)
SELECT session_id, frame_idx, {r('g - 360.0 * floor(g / 360.0)', 5)} AS heading FROM h""".replace(
    """b AS (SELECT *, coalesce(last_value(frame_idx) OVER back, first_value(frame_idx) OVER (PARTITION BY session_id ORDER BY frame_idx)) AS ib,
   coalesce(first_value(frame_idx) OVER fwd, last_value(frame_idx) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS jf
   FROM p WINDOW back AS (PARTITION BY session_id ORDER BY arc RANGE BETWEEN UNBOUNDED PRECEDING AND 6.0 PRECEDING),
   fwd AS (PARTITION BY session_id ORDER BY arc RANGE BETWEEN 6.0 FOLLOWING AND UNBOUNDED FOLLOWING)),
""", ""))
def baseline_heading(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", F.col("value").alias("x"), (F.col("speed") * F.col("speed")).alias("y"),
                                       ((F.col("frame_idx") % 4) * 1.5).alias("d"))
    p = scan(f, S(), sums={"arc_m": F.col("d")})
    return tr.baseline_heading(p, S()).select("session_id", "frame_idx", rnd("heading", 5).alias("heading"))


@query("sample_by_distance", "WITH " + feeds.FRAMES_SQL + f""", d AS (
  SELECT session_id, frame_idx, coalesce(greatest(speed - 1, 0) * (time_sec - lag(time_sec) OVER ({W})), 0) AS d FROM frames),
c AS (SELECT *, sum(d) OVER ({W}) AS s FROM d),
f AS (SELECT *, floor(s / 1500.0) AS k, lag(floor(s / 1500.0)) OVER ({W}) AS pk FROM c)
SELECT session_id, frame_idx, {r('s', 4)} AS driven_m FROM f WHERE pk IS NULL OR k > pk""")
def sample_by_distance(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", "time_sec", (F.col("speed") - 1).alias("speed"))
    return tr.sample_by_distance(f, S(), 1500.0).select("session_id", "frame_idx", rnd("driven_m", 4).alias("driven_m"))


@query("sample_by_time", f"""SELECT user_id AS session_id, event_id AS frame_idx,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS saved_index FROM events WHERE event_id % 3 = 0""")
def sample_by_time(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx")
    return tr.sample_by_time(f, S(), "frame_idx", 3).select("session_id", "frame_idx", "saved_index")


@query("sample_by_rate", "WITH RECURSIVE " + feeds.FRAMES_SQL + f""", num AS (
  SELECT session_id, frame_idx, row_number() OVER ({W}) AS rn FROM frames),
walk AS (
  SELECT session_id, frame_idx, rn, 0::BIGINT AS c, frame_idx >= 0 AS hit FROM num WHERE rn = 1
  UNION ALL
  SELECT n.session_id, n.frame_idx, n.rn, w.c + CASE WHEN w.hit THEN 1 ELSE 0 END,
         n.frame_idx >= CAST(floor((w.c + CASE WHEN w.hit THEN 1 ELSE 0 END) * 137.5) AS BIGINT)
  FROM walk w JOIN num n ON n.session_id = w.session_id AND n.rn = w.rn + 1)
SELECT session_id, frame_idx, c AS extract_index FROM walk WHERE hit""")
def sample_by_rate(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx")
    return tr.sample_by_rate(f, S(), "frame_idx", 137.5).select("session_id", "frame_idx", "extract_index")


@query("sample_n", "WITH " + feeds.FRAMES_SQL + f""", n AS (
  SELECT session_id, frame_idx, row_number() OVER ({W}) - 1 AS j, count(*) OVER (PARTITION BY session_id) AS n FROM frames),
k AS (SELECT *, row_number() OVER ({W}) AS q FROM n WHERE j % greatest(1, n // 20) = 0)
SELECT session_id, frame_idx FROM k WHERE q <= 20""")
def sample_n(spark, sf):
    return tr.sample_n(feeds.frames(spark, sf).select("session_id", "frame_idx"), S(), 20)


@query("snap_to_gps", "WITH " + feeds.FRAMES_SQL + """
SELECT session_id, frame_idx FROM frames f WHERE EXISTS (
  SELECT 1 FROM frames g WHERE g.session_id = f.session_id AND g.speed > 20 AND CAST(round_even(g.time_sec * 2.0, 0) AS BIGINT) = f.frame_idx)""")
def snap_to_gps(spark, sf):
    f = feeds.frames(spark, sf)
    return tr.snap_to_gps(f.select("session_id", "frame_idx"), f.where("speed > 20"), ["session_id"], "frame_idx", "time_sec", 2.0)


@query("photo_heading", "WITH RECURSIVE " + feeds.FRAMES_SQL + f""", a AS (
  SELECT session_id, frame_idx, event_type <> 'view' AS ph, fix_lat AS la, fix_lon AS lo FROM frames),
n AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(ph) OVER w, false) AS pp, lag(la) OVER w AS pla, lag(lo) OVER w AS plo,
      coalesce(lead(ph) OVER w, false) AS np, lead(la) OVER w AS nla, lead(lo) OVER w AS nlo FROM a WINDOW w AS ({W})),
o AS (SELECT *, CASE WHEN la IS NOT NULL AND pp AND pla IS NOT NULL AND np AND nla IS NOT NULL THEN {sql_bearing('pla','plo','nla','nlo')}
   WHEN la IS NOT NULL AND np AND nla IS NOT NULL THEN {sql_bearing('la','lo','nla','nlo')}
   WHEN la IS NOT NULL AND pp AND pla IS NOT NULL THEN {sql_bearing('pla','plo','la','lo')}
   WHEN NOT pp THEN 0.0 END AS own FROM n)
SELECT session_id, frame_idx, {r('h', 5)} AS heading FROM (
  SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM o) WHERE ph""")
def photo_heading(spark, sf):
    a = feeds.frames(spark, sf).select(
        "session_id", "frame_idx", (F.col("event_type") != "view").alias("is_photo"), F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"))
    return tr.photo_heading(a, S()).select("session_id", "frame_idx", rnd("heading", 5).alias("heading"))


@query("carry_heading", "WITH " + feeds.FRAMES_SQL + f""", p AS (
  SELECT *, last_value(fix_lat IGNORE NULLS) OVER b AS pla, last_value(fix_lon IGNORE NULLS) OVER b AS plo FROM frames
  WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE WHEN fix_lat IS NOT NULL AND pla IS NOT NULL THEN {sql_bearing('pla','plo','fix_lat','fix_lon')} END AS own FROM p)
SELECT session_id, frame_idx, {r(f'coalesce(last_value(own IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)', 5)} AS heading FROM o""")
def carry_heading(spark, sf):
    return carry(feeds.frames(spark, sf), S(), "fix_lat", "fix_lon").select("session_id", "frame_idx", rnd("heading", 5).alias("heading"))


@query("location_segments", "WITH " + feeds.FRAMES_SQL + f""", p AS (
  SELECT *, last_value(fix_lat IGNORE NULLS) OVER b AS pla, last_value(fix_lon IGNORE NULLS) OVER b AS plo FROM frames
  WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, frame_idx, 'Location ' || CAST(1 + sum(CASE WHEN {sql_hav('pla','plo','fix_lat','fix_lon')} > 50 THEN 1 ELSE 0 END) OVER ({W}) AS BIGINT) AS location FROM p""")
def location_segments(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"))
    return tr.location_segments(f, S()).select("session_id", "frame_idx", "location")


@query("resume_location", f"""
SELECT user_id AS session_id, {r("arg_max(CAST(event_id % 1000 AS DOUBLE) * 1e-5::DOUBLE - 32.4::DOUBLE, event_id)")} AS last_lat,
  {r("arg_max(CAST(event_id % 7 AS DOUBLE) * 1e-5::DOUBLE + 151.75::DOUBLE, event_id)")} AS last_lon,
  CAST(CASE WHEN max(event_id) % 9 = 0 THEN 1 ELSE max(event_id) % 9 END AS INTEGER) AS last_loc_id FROM events GROUP BY 1""")
def resume_location(spark, sf):
    f = feeds.frames(spark, sf).withColumn("location", F.concat(F.lit("Location "), F.col("frame_idx") % 9))
    out = tr.resume_location(f, ["session_id"], "frame_idx")
    return out.select("session_id", rnd("last_lat").alias("last_lat"), rnd("last_lon").alias("last_lon"), "last_loc_id")


@query("distinct_locations", "SELECT DISTINCT event_type AS location FROM events")
def distinct_locations(spark, sf):
    return tr.distinct_locations(table(spark, sf, "events").select(F.col("event_type").alias("location")))


@query("frames_at", "SELECT event_id, event_type AS location FROM events WHERE event_type = 'click'")
def frames_at(spark, sf):
    return tr.frames_at(table(spark, sf, "events").select("event_id", F.col("event_type").alias("location")), "click")


@query("order_frames", "SELECT event_id, user_id, ts FROM events ORDER BY user_id, ts, event_id")
def order_frames(spark, sf):
    return tr.order_frames(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id", "ts", "event_id"])


@query("position_frames", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY printf('f%08d', event_id * 7919 % 100003), event_id) - 1 AS frame_idx FROM events""")
def position_frames(spark, sf):
    f = table(spark, sf, "events").select("event_id", "event_type", F.format_string("f%08d", F.col("event_id") * 7919 % 100003).alias("filename"))
    return tr.position_frames(f, ["event_type"], ["filename", "event_id"]).drop("filename")


@query("extent", "WITH " + feeds.FRAMES_SQL + f"""
SELECT event_type, {r('min(fix_lon)')} AS west, {r('min(fix_lat)')} AS south, {r('max(fix_lon)')} AS east, {r('max(fix_lat)')} AS north
FROM frames WHERE fix_lat IS NOT NULL GROUP BY event_type""")
def extent(spark, sf):
    f = feeds.frames(spark, sf).select("event_type", F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"))
    return tr.extent(f, ["event_type"]).select("event_type", *[rnd(c).alias(c) for c in ("west", "south", "east", "north")])


@query("trail", "WITH " + feeds.FRAMES_SQL + """
SELECT session_id, count(*) AS points, string_agg(printf('%.5f', fix_lon) || ' ' || printf('%.5f', fix_lat), ',' ORDER BY frame_idx) AS line
FROM frames WHERE fix_lat IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def trail(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"))
    out = tr.trail(f, ["session_id"], "frame_idx")
    text = F.array_join(F.transform("coordinates", lambda p: F.format_string("%.5f %.5f", p[0], p[1])), ",")
    return out.select("session_id", F.size("coordinates").cast("long").alias("points"), text.alias("line"))
