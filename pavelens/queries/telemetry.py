"""Telemetry queries over the events table."""

from pyspark.sql import functions as F

from ..operators import resample, smoothing, telemetry
from ..operators.blocks import series
from . import feeds
from .registry import query, r, rnd, sql_hav, table

W = "PARTITION BY session_id ORDER BY frame_idx"


@query("payload_timeline", f"""
SELECT user_id AS session_id, event_id, i, {r('event_id * 0.5::DOUBLE + i::DOUBLE / n * 1.5::DOUBLE')} AS time_sec,
       {r('value * (i + 1)')} AS v
FROM (SELECT *, 1 + CAST(event_id % 3 AS INTEGER) AS n FROM events), LATERAL (SELECT unnest(range(n)) AS i)
""")
def payload_timeline(spark, sf):
    ev = table(spark, sf, "events")
    n = (F.col("event_id") % 3 + 1).cast("int")
    vals = F.transform(F.sequence(F.lit(1), n), lambda k: F.array(F.col("value") * k, F.col("event_id").cast("double")))
    pay = ev.select(
        F.col("user_id").alias("session_id"), F.lit("GPS5").alias("stream"), (F.col("event_id") * 0.5).alias("t_start"),
        F.lit(1.5).alias("t_dur"), vals.alias("values"),
    )
    return telemetry.payload_timeline(pay).select(
        "session_id", F.col("data")[1].cast("long").alias("event_id"), F.col("i").cast("long").alias("i"),
        rnd("time_sec").alias("time_sec"), rnd(F.col("data")[0]).alias("v"),
    )


@query("apply_scale", """
SELECT event_id, round(value / 4.0::DOUBLE, 6) AS a,
       round(value / (CASE WHEN event_id % 2 = 0 THEN (CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END) ELSE event_id % 2 END)::DOUBLE, 6) AS b,
       round(value / (CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END)::DOUBLE, 6) AS c,
       round(value / (CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END)::DOUBLE, 6) AS d
FROM events
""")
def apply_scale(spark, sf):
    i = F.col("event_id")
    scale = F.array(F.lit(4.0), (i % 2).cast("double"), (i % 3).cast("double"))
    vals = F.array(*[F.col("value")] * 4)
    out = telemetry.apply_scale(vals, scale)
    return table(spark, sf, "events").select("event_id", *[rnd(out[k]).alias("abcd"[k]) for k in range(4)])


@query("select_gps", "WITH " + feeds.SAMPLES_SQL + f""", flagged AS (
  SELECT *, max(CASE WHEN stream = 'GPS9' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS has9 FROM gps_raw)
SELECT session_id, seq, time_sec, {r('lat')} AS lat, {r('lon')} AS lon, {r('speed')} AS speed FROM flagged
WHERE (stream = 'GPS9' AND fix >= 2 AND dop <= 5) OR (has9 = 0 AND stream = 'GPS5' AND lat <> 0 AND lon <> 0)
""")
def select_gps(spark, sf):
    out = telemetry.select_gps(feeds.samples(spark, sf))
    return out.select("session_id", "seq", "time_sec", *[rnd(c).alias(c) for c in ("lat", "lon", "speed")])


def _gps(spark, sf):
    f = feeds.frames(spark, sf)
    return f.select("session_id", F.col("frame_idx").alias("seq"), "time_sec", "lat", "lon", "speed")


# The fold as a list reduction: state is the last kept row followed by all kept ids.
@query("drop_speed_outliers", "WITH RECURSIVE " + feeds.FRAMES_SQL + f""", numbered AS (
  SELECT session_id, frame_idx, time_sec, lat, lon, speed, row_number() OVER ({W}) AS rn,
         count(*) OVER (PARTITION BY session_id) AS n FROM frames),
walk AS (
  SELECT session_id, rn, n, frame_idx, time_sec AS kt, lat AS kla, lon AS klo, true AS kept FROM numbered WHERE rn = 1
  UNION ALL
  SELECT session_id, rn, n, frame_idx, CASE WHEN keep THEN time_sec ELSE kt END, CASE WHEN keep THEN lat ELSE kla END,
         CASE WHEN keep THEN lon ELSE klo END, keep
  FROM (SELECT b.session_id, b.rn, b.n, b.frame_idx, b.time_sec, b.lat, b.lon, w.kt, w.kla, w.klo,
               NOT ({sql_hav('w.kla','w.klo','b.lat','b.lon')} / (b.time_sec - w.kt) > 1.0
                    AND abs({sql_hav('w.kla','w.klo','b.lat','b.lon')} / (b.time_sec - w.kt) - b.speed) > 8.0) AS keep
        FROM walk w JOIN numbered b ON b.session_id = w.session_id AND b.rn = w.rn + 1)),
tot AS (SELECT session_id, count(*) FILTER (WHERE kept) AS k FROM walk GROUP BY 1)
SELECT w.session_id, w.frame_idx AS seq FROM walk w JOIN tot t USING (session_id) WHERE w.kept OR w.n < 3 OR t.k < 2
""")
def drop_speed_outliers(spark, sf):
    out = telemetry.drop_speed_outliers(_gps(spark, sf), 8.0)
    return out.select("session_id", "seq")


@query("gps_health", "WITH " + feeds.SAMPLES_SQL + f""", flagged AS (
  SELECT *, max(CASE WHEN stream = 'GPS9' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS has9 FROM gps_raw),
used AS (SELECT * FROM flagged WHERE (stream = 'GPS9') = (has9 = 1)),
step AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, time_sec - lag(time_sec) OVER w AS dt FROM used
         WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
err AS (SELECT *, {sql_hav('plat','plon','lat','lon')} / dt AS v FROM step),
agg AS (SELECT session_id, count(*) AS samples,
  coalesce(avg(CASE WHEN dt > 0 AND (speed > 1 OR v > 1) THEN abs(v - speed) END), 0) AS ae,
  coalesce(max(CASE WHEN dt > 0 AND (speed > 1 OR v > 1) THEN abs(v - speed) END), 0) AS me,
  count(CASE WHEN dt > 0 AND stream = 'GPS9' AND fix < 3 THEN 1 END) AS bf,
  count(CASE WHEN dt > 0 AND stream = 'GPS9' AND dop > 3 THEN 1 END) AS bd
  FROM err GROUP BY session_id)
SELECT session_id, samples, {r('ae', 3)} AS avg_gps_speed_error_ms,
  {r('CASE WHEN samples > 1 THEN bf::DOUBLE / samples ELSE 0.0 END', 3)} AS bad_fix_ratio, {r('me', 2)} AS max_speed_error,
  {r('CASE WHEN samples > 1 THEN greatest(0.0, least(100.0, 100.0 - (ae * 5 + bf::DOUBLE / samples * 40 + bd::DOUBLE / samples * 15 + CASE WHEN me > 15 THEN 15 ELSE 0 END))) ELSE 100.0 END', 4)} AS gps_score
FROM agg
""")
def gps_health(spark, sf):
    return telemetry.gps_health(feeds.samples(spark, sf)).drop("max_speed_error_exact").withColumn("gps_score", rnd("gps_score", 4))


@query("imu_health", f"""
SELECT user_id AS session_id, {r('avg(abs(1 - sqrt(pow(value / 1000.0, 2) + 0.9 * 0.9 + 0.1 * 0.1)))', 4)} AS avg_grav_mag_error,
  {r('greatest(0.0, least(100.0, 100.0 - 200 * avg(abs(1 - sqrt(pow(value / 1000.0, 2) + 0.9 * 0.9 + 0.1 * 0.1)))))', 4)} AS imu_score
FROM events GROUP BY user_id
""")
def imu_health(spark, sf):
    return telemetry.imu_health(feeds.samples(spark, sf)).withColumn("imu_score", rnd("imu_score", 4))


@query("health_warnings", """
WITH s AS (SELECT user_id AS session_id, max(value) / 10 AS m, greatest(0.0, 100.0 - avg(value) / 10) AS g,
                  greatest(0.0, 100.0 - min(value) * 4) AS i FROM events GROUP BY user_id)
SELECT session_id, concat_ws('|',
  CASE WHEN m > 15 THEN 'Kinematic Anomaly: GPS coordinate jumped violently (Speed delta: ' || printf('%.1f', m) || ' m/s).' END,
  CASE WHEN g < 80 THEN 'GPS Quality Degraded (Score: ' || printf('%.1f', g) || '%). High spatial drift.' END,
  CASE WHEN i < 90 THEN 'IMU Calibration/Vibration Issue (Score: ' || printf('%.1f', i) || '%). Gravity vector unstable.' END) AS warnings
FROM s
""")
def health_warnings(spark, sf):
    rep = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(
        (F.max("value") / 10).alias("max_speed_error_exact"),
        F.greatest(F.lit(0.0), 100.0 - F.avg("value") / 10).alias("gps_score"),
        F.greatest(F.lit(0.0), 100.0 - F.min("value") * 4).alias("imu_score"),
    )
    return telemetry.health_warnings(rep).select("session_id", F.array_join("warnings", "|").alias("warnings"))


@query("session_rate", "WITH " + feeds.FRAMES_SQL + f""", a AS (
  SELECT session_id, count(*) AS samples, avg(speed) AS ms, max(time_sec) - min(time_sec) AS d FROM frames GROUP BY 1),
b AS (SELECT *, CASE WHEN d > 0.1 THEN samples / d ELSE 18.0 END AS hz FROM a)
SELECT session_id, samples, {r('ms')} AS mean_speed, {r('hz')} AS hz,
       {r('greatest(1.0, 2.0 / greatest(ms, 1.0) * hz)')} AS sigma_samples FROM b
""")
def session_rate(spark, sf):
    return telemetry.session_rate(_gps(spark, sf)).select(
        "session_id", "samples", *[rnd(c).alias(c) for c in ("mean_speed", "hz", "sigma_samples")]
    )


def _smooth_sql(mode: str, sigma: float) -> str:
    radius = int(4 * sigma + 0.5)
    idx = "least(greatest(a.pos + k, 0), a.n - 1)" if mode == "nearest" else (
        "(CASE WHEN (((a.pos + k) % (2 * a.n)) + 2 * a.n) % (2 * a.n) < a.n THEN (((a.pos + k) % (2 * a.n)) + 2 * a.n) % (2 * a.n) "
        "ELSE 2 * a.n - 1 - (((a.pos + k) % (2 * a.n)) + 2 * a.n) % (2 * a.n) END)")
    return "WITH " + feeds.FRAMES_SQL + f""", num AS (
  SELECT session_id, frame_idx, speed, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM frames),
ker AS (SELECT k, exp(-0.5 * pow(k / {sigma}::DOUBLE, 2)) AS w FROM (SELECT unnest(range(-{radius}, {radius} + 1)) AS k))
SELECT a.session_id, a.frame_idx, {r('sum(b.speed * w) / sum(w)')} AS speed
FROM num a CROSS JOIN ker JOIN num b ON b.session_id = a.session_id AND b.pos = {idx} GROUP BY 1, 2"""


@query("gaussian_smooth_nearest", _smooth_sql("nearest", 3.0))
def gaussian_smooth_nearest(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", "speed")
    out = smoothing.gaussian_smooth(f, series("session_id", "frame_idx", 700), ["speed"], 3.0, "nearest")
    return out.withColumn("speed", rnd("speed"))


@query("gaussian_smooth_reflect", _smooth_sql("reflect", 15.0))
def gaussian_smooth_reflect(spark, sf):
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", "speed")
    out = smoothing.gaussian_smooth(f, series("session_id", "frame_idx", 700), ["speed"], 15.0, "reflect")
    return out.withColumn("speed", rnd("speed"))


UNWRAP_SQL = """ang AS (SELECT session_id, frame_idx, radians(value * 7 - 360 * floor(value * 7 / 360)) AS a FROM frames),
d AS (SELECT *, a - lag(a) OVER (PARTITION BY session_id ORDER BY frame_idx) AS d FROM ang),
f AS (SELECT *, (d + pi()) - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi() AS m FROM d),
g AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < pi() THEN 0.0 ELSE (CASE WHEN m = -pi() AND d > 0 THEN pi() ELSE m END) - d END AS fix FROM f),
un AS (SELECT session_id, frame_idx, a + sum(fix) OVER (PARTITION BY session_id ORDER BY frame_idx) AS u FROM g)"""


def _angles(spark, sf):
    f = feeds.frames(spark, sf)
    return f.select("session_id", "frame_idx", F.pmod(F.col("value") * 7, F.lit(360.0)).alias("heading"))


@query("unwrap", "WITH " + feeds.FRAMES_SQL + ", " + UNWRAP_SQL + f" SELECT session_id, frame_idx, {r('u')} AS u FROM un")
def unwrap(spark, sf):
    a = _angles(spark, sf).withColumn("a", F.radians("heading"))
    return smoothing.unwrap(a, series("session_id", "frame_idx", 700), "a", "u").select("session_id", "frame_idx", rnd("u").alias("u"))


@query("smooth_heading", "WITH " + feeds.FRAMES_SQL + ", " + UNWRAP_SQL + f""", num AS (
  SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM un),
h AS (SELECT *, (CASE WHEN n >= 5 THEN 2 WHEN n >= 3 THEN 1 ELSE 0 END) AS half FROM num),
k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k)
SELECT a.session_id, a.frame_idx,
  {r('degrees(avg(b.u)) - 360.0 * floor(degrees(avg(b.u)) / 360.0)', 5)} AS heading
FROM h a JOIN k ON abs(k) <= a.half JOIN h b ON b.session_id = a.session_id AND b.pos = least(greatest(a.pos + k, 0), a.n - 1)
GROUP BY 1, 2
""")
def smooth_heading(spark, sf):
    return smoothing.smooth_heading(_angles(spark, sf), series("session_id", "frame_idx", 700)).withColumn("heading", rnd("heading", 5))


@query("interpolate_index", "WITH " + feeds.FRAMES_SQL + f""", num AS (
  SELECT session_id, frame_idx, row_number() OVER ({W}) - 1 AS pos, CASE WHEN frame_idx % 4 = 0 THEN speed END AS v FROM frames),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) AS pa,
      min(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM num)
SELECT k.session_id, k.frame_idx, {r('coalesce(a.v + (b.v - a.v) * ((k.pos - k.pa)::DOUBLE / CASE WHEN k.pb <> k.pa THEN k.pb - k.pa ELSE 1 END), 0.0)')} AS v
FROM k LEFT JOIN num a ON a.session_id = k.session_id AND a.pos = k.pa LEFT JOIN num b ON b.session_id = k.session_id AND b.pos = k.pb
""")
def interpolate_index(spark, sf):
    from ..operators.blocks import scan
    f = feeds.frames(spark, sf).select("session_id", "frame_idx", F.when(F.col("frame_idx") % 4 == 0, F.col("speed")).alias("v"))
    pos = scan(f, series("session_id", "frame_idx", 700), number="pos")
    out = smoothing.interpolate_index(pos, series("session_id", "pos", 9), "pos", ["v"])
    return out.select("session_id", "frame_idx", rnd("v").alias("v"))


# Resampling: samples are even ids, targets are odd ids shifted by a quarter second.
RES_SQL = feeds.FRAMES_SQL + """, smp AS (
  SELECT session_id, time_sec AS t, speed AS y FROM frames WHERE frame_idx % 2 = 0),
tgt AS (SELECT session_id, frame_idx, time_sec + 0.25::DOUBLE AS t FROM frames WHERE frame_idx % 2 = 1),
seg0 AS (SELECT *, lead(t) OVER w - t AS h, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS m, row_number() OVER w AS i,
         count(*) OVER (PARTITION BY session_id) AS n FROM smp WINDOW w AS (PARTITION BY session_id ORDER BY t)),
seg AS (SELECT *, lag(h) OVER w AS hl, lag(m) OVER w AS ml, lead(h) OVER w AS hr, lead(m) OVER w AS mr FROM seg0
        WINDOW w AS (PARTITION BY session_id ORDER BY t)),
pick AS (SELECT g.session_id, g.frame_idx, g.t AS tt, coalesce(
    (SELECT max(s.i) FROM seg s WHERE s.session_id = g.session_id AND s.h IS NOT NULL AND s.t <= g.t),
    (SELECT min(s.i) FROM seg s WHERE s.session_id = g.session_id AND s.h IS NOT NULL)) AS i FROM tgt g)"""


def _res(spark, sf):
    f = feeds.frames(spark, sf)
    smp = f.where(F.col("frame_idx") % 2 == 0).select("session_id", F.col("time_sec").alias("t"), F.col("speed").alias("y"))
    tgt = f.where(F.col("frame_idx") % 2 == 1).select("session_id", "frame_idx", (F.col("time_sec") + 0.25).alias("t"))
    return smp, tgt


def _inner(h0, h1, m0, m1):
    return f"(CASE WHEN {m0} * {m1} <= 0 THEN 0.0 ELSE (3 * {h0} + 3 * {h1}) / ((2 * {h1} + {h0}) / {m0} + ({h1} + 2 * {h0}) / {m1}) END)"


def _end(h0, h1, m0, m1):
    d = f"(((2 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}))"
    return (f"(CASE WHEN sign({d}) <> sign({m0}) THEN 0.0 WHEN sign({m0}) <> sign({m1}) AND abs({d}) > 3 * abs({m0}) "
            f"THEN 3 * {m0} ELSE {d} END)")


@query("pchip_resample", "WITH " + RES_SQL + f""", der AS (
  SELECT *, CASE WHEN n < 4 THEN m WHEN ml IS NULL THEN {_end('h','hr','m','mr')} ELSE {_inner('hl','h','ml','m')} END AS a,
            CASE WHEN n < 4 THEN m WHEN mr IS NULL THEN {_end('h','hl','m','ml')} ELSE {_inner('h','hr','m','mr')} END AS b
  FROM seg WHERE h IS NOT NULL),
ev AS (SELECT p.session_id, p.frame_idx, p.tt - d.t AS s, d.* EXCLUDE (session_id) FROM pick p LEFT JOIN der d ON d.session_id = p.session_id AND d.i = p.i)
SELECT session_id, frame_idx, {r('y + a * s + ((m - a) / h - (a + b - 2 * m) / h) * s * s + (a + b - 2 * m) / (h * h) * s * s * s', 5)} AS y FROM ev
""")
def pchip_resample(spark, sf):
    smp, tgt = _res(spark, sf)
    return resample.pchip_resample(smp, tgt, ["session_id"], "t", ["y"]).select(
        "session_id", "frame_idx", rnd("y", 5).alias("y"))


def _linear_sql(clamp: bool) -> str:
    s = "greatest(0.0, least(h, tt - t))" if clamp else "(tt - t)"
    return "WITH " + RES_SQL + f"""
SELECT p.session_id, p.frame_idx, {r(f'y + m * {s}')} AS y FROM pick p LEFT JOIN seg d ON d.session_id = p.session_id AND d.i = p.i"""


@query("linear_resample", _linear_sql(False))
def linear_resample(spark, sf):
    smp, tgt = _res(spark, sf)
    return resample.linear_resample(smp, tgt, ["session_id"], "t", ["y"]).select("session_id", "frame_idx", rnd("y").alias("y"))


@query("linear_resample_clamp", _linear_sql(True))
def linear_resample_clamp(spark, sf):
    smp, tgt = _res(spark, sf)
    return resample.linear_resample(smp, tgt, ["session_id"], "t", ["y"], "clamp").select("session_id", "frame_idx", rnd("y").alias("y"))


@query("asof_bracket", "WITH " + RES_SQL + """
SELECT g.session_id, g.frame_idx, (SELECT max(s.t) FROM smp s WHERE s.session_id = g.session_id AND s.t <= g.t) AS prev_t,
       (SELECT min(s.t) FROM smp s WHERE s.session_id = g.session_id AND s.t > g.t) AS next_t FROM tgt g""")
def asof_bracket(spark, sf):
    smp, tgt = _res(spark, sf)
    out = resample.asof_bracket(tgt, smp, ["session_id"], "t", ["y"])
    return out.select("session_id", "frame_idx", F.col("prev.t").alias("prev_t"), F.col("next.t").alias("next_t"))


Q = {"w": "cos(value / 2)", "x": "sin(value / 2) * 0.6::DOUBLE", "y": "sin(value / 2) * 0.8::DOUBLE", "z": "0.0::DOUBLE"}


@query("slerp_resample", "WITH " + feeds.FRAMES_SQL + f""", qs AS (
  SELECT session_id, time_sec AS t, {', '.join(f'{e} AS {k}' for k, e in Q.items())} FROM frames WHERE frame_idx % 2 = 0),
tgt AS (SELECT session_id, frame_idx, time_sec + 0.25::DOUBLE AS t FROM frames WHERE frame_idx % 2 = 1),
br AS (SELECT g.*, (SELECT max(s.t) FROM qs s WHERE s.session_id = g.session_id AND s.t <= g.t) AS a,
       (SELECT min(s.t) FROM qs s WHERE s.session_id = g.session_id AND s.t > g.t) AS b FROM tgt g),
j AS (SELECT br.session_id, br.frame_idx, br.t, coalesce(a, b) AS ta, coalesce(b, a) AS tb FROM br),
k AS (SELECT j.*, p.w AS pw, p.x AS px, p.y AS py, p.z AS pz, q.w AS qw, q.x AS qx, q.y AS qy, q.z AS qz,
      p.w * q.w + p.x * q.x + p.y * q.y + p.z * q.z AS dot FROM j
      LEFT JOIN qs p ON p.session_id = j.session_id AND p.t = j.ta LEFT JOIN qs q ON q.session_id = j.session_id AND q.t = j.tb),
l AS (SELECT *, acos(least(1.0, abs(dot))) AS th, CASE WHEN dot < 0 THEN -1.0 ELSE 1.0 END AS sg,
      CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0.0 END AS al FROM k),
m AS (SELECT *, CASE WHEN th < 1e-9 THEN 1 - al ELSE sin(th * (1 - al)) / sin(th) END AS wp,
      sg * CASE WHEN th < 1e-9 THEN al ELSE sin(th * al) / sin(th) END AS wq FROM l)
SELECT session_id, frame_idx, {r('wp * px + wq * qx', 5)} AS qx, {r('wp * py + wq * qy', 5)} AS qy,
       {r('wp * pz + wq * qz', 5)} AS qz, {r('wp * pw + wq * qw', 5)} AS qw FROM m
""")
def slerp_resample(spark, sf):
    f = feeds.frames(spark, sf)
    v = F.col("value") / 2
    qs = f.where(F.col("frame_idx") % 2 == 0).select(
        "session_id", F.col("time_sec").alias("t"), F.cos(v).alias("w"), (F.sin(v) * 0.6).alias("x"),
        (F.sin(v) * 0.8).alias("y"), F.lit(0.0).alias("z"))
    _, tgt = _res(spark, sf)
    out = resample.slerp_resample(qs, tgt, ["session_id"], "t")
    return out.select("session_id", "frame_idx", *[rnd(c, 5).alias(c) for c in ("qx", "qy", "qz", "qw")])


@query("nearest_by_position", "WITH " + feeds.FRAMES_SQL + f""", st AS (
  SELECT session_id, frame_idx AS sid, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM frames WHERE frame_idx % 2 = 0),
c AS (SELECT DISTINCT session_id, n FROM st),
w AS (SELECT f.session_id, f.frame_idx, greatest(0.0, least(1.0, f.time_sec / 4000.0)) * (c.n - 1) AS p FROM frames f LEFT JOIN c USING (session_id))
SELECT w.session_id, w.frame_idx, st.sid FROM w LEFT JOIN st ON st.session_id = w.session_id AND st.pos = CAST(round_even(w.p, 0) AS BIGINT)
""")
def nearest_by_position(spark, sf):
    f = feeds.frames(spark, sf)
    st = f.where(F.col("frame_idx") % 2 == 0).select("session_id", F.col("frame_idx").alias("sid"))
    fr = f.select("session_id", "frame_idx", "time_sec", F.lit(4000.0).alias("dur"))
    out = resample.nearest_by_position(st, fr, ["session_id"], ["sid"], "time_sec", "dur")
    return out.select("session_id", "frame_idx", F.col("nearest.sid").alias("sid"))


@query("missing_streams", """
WITH s AS (SELECT DISTINCT user_id AS session_id, event_type FROM events)
SELECT session_id, coalesce(string_agg(e, ',' ORDER BY e), '') AS missing FROM (
  SELECT u.session_id, CASE WHEN s.event_type IS NULL THEN q.e END AS e FROM (SELECT DISTINCT session_id FROM s) u
  CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'gravity']) AS e) q
  LEFT JOIN s ON s.session_id = u.session_id AND s.event_type = q.e) GROUP BY 1
""")
def missing_streams(spark, sf):
    s = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("stream"))
    out = telemetry.missing_streams(s, ["click", "error", "purchase", "signup", "gravity"])
    return out.select("session_id", F.array_join("missing", ",").alias("missing"))
