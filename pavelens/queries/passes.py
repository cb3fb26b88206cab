"""Repeat-pass and defect-group queries."""

from pyspark.sql import functions as F

from ..functions import polygons as pg
from ..operators import grouping as gp, passes as ps
from ..operators.joins import tasks
from . import feeds
from .registry import query, r, rnd, rnd_fast, sql_bearing, sql_hav, table

# Passes: one project per event type; the fix is a place that many ids share, moved a little.
PASS_SQL = """pf AS (SELECT event_type AS project, event_id AS frame_idx, 'f' || event_id AS filename,
  CASE WHEN event_id % 10 <> 0 THEN (event_id * 37 % 4001) * 1e-5::DOUBLE - 32.4::DOUBLE + value * 2e-8::DOUBLE END AS lat,
  CASE WHEN event_id % 10 <> 0 THEN (event_id % 3) * 1e-4::DOUBLE + 151.75::DOUBLE END AS lon, value FROM events)"""


def _pf(spark, sf):
    i = F.col("event_id")
    ok = i % 10 != 0
    return table(spark, sf, "events").select(
        F.col("event_type").alias("project"), i.alias("frame_idx"), F.concat(F.lit("f"), i.cast("string")).alias("filename"),
        F.when(ok, (i * 37 % 4001) * F.lit(1e-5) - 32.4 + F.col("value") * 2e-8).alias("lat"), F.when(ok, (i % 3) * F.lit(1e-4) + 151.75).alias("lon"), "value")


PAIR_SQL = PASS_SQL + f""", cand AS (SELECT a.project, a.frame_idx AS a, b.frame_idx AS b, {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist FROM pf a JOIN pf b ON b.project = a.project AND b.frame_idx - a.frame_idx >= 15 AND abs(a.lat - b.lat) < 1e-4 AND abs(a.lon - b.lon) < 1e-4
  WHERE {sql_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 4)"""


@query("repeat_pass_candidates", "WITH " + PAIR_SQL + f" SELECT project, a, b, {r('dist', 5)} AS dist FROM cand")
def repeat_pass_candidates(spark, sf):
    return ps.repeat_pass_candidates(_pf(spark, sf), ["project"]).withColumn("dist", rnd_fast("dist", 5))


# A greedy scan over whole projects is too long for recursive SQL; tests compare it with a plain scan.
@query("greedy_match")
def greedy_match(spark, sf):
    return ps.find_repeat_passes(_pf(spark, sf), ["project"], digits=4).select("project", "a", "b", "dist")


META_SQL = PAIR_SQL + """, meta AS (SELECT filename, lat + 1e-6::DOUBLE AS lat, lon AS lon, CASE WHEN frame_idx % 4 <> 0 THEN lat + 2e-6::DOUBLE END AS raw_lat, CASE WHEN frame_idx % 4 <> 0 THEN lon END AS raw_lon, CASE WHEN frame_idx % 6 <> 0 THEN value * 0.7 END AS heading, value / 10 AS speed_ms FROM pf WHERE frame_idx % 7 <> 0),
side AS (SELECT pf.project, pf.frame_idx, pf.lat, pf.lon, coalesce(m.raw_lat, m.lat) AS rla, coalesce(m.raw_lon, m.lon) AS rlo, coalesce(m.heading, 0.0) AS h FROM pf JOIN meta m ON m.filename = pf.filename),
tele AS (SELECT c.*, s.lat AS lat_a, s.lon AS lon_a, s.rla AS rla_a, s.rlo AS rlo_a, s.h AS h_a, t.lat AS lat_b, t.lon AS lon_b, t.rla AS rla_b, t.rlo AS rlo_b, t.h AS h_b FROM cand c JOIN side s ON s.project = c.project AND s.frame_idx = c.a JOIN side t ON t.project = c.project AND t.frame_idx = c.b)"""


def _tele(spark, sf):
    f = _pf(spark, sf)
    i = F.col("frame_idx")
    meta = f.where(i % 7 != 0).select(
        "filename", (F.col("lat") + 1e-6).alias("lat"), "lon", F.when(i % 4 != 0, F.col("lat") + 2e-6).alias("raw_lat"), F.when(i % 4 != 0, F.col("lon")).alias("raw_lon"),
        F.when(i % 6 != 0, F.col("value") * 0.7).alias("heading"), (F.col("value") / 10).alias("speed_ms"))
    pairs = ps.repeat_pass_candidates(ps.telemetry_rows(f, meta, ["project"]), ["project"], carry=ps.CARRIED)
    return ps.attach_telemetry(pairs, f, meta, ["project"])


@query("attach_telemetry", "WITH " + META_SQL + f" SELECT project, a, b, {r('rla_a', 8)} AS raw_lat_a, {r('rla_b', 8)} AS raw_lat_b, {r('h_a')} AS heading_a, {r('h_b')} AS heading_b FROM tele")
def attach_telemetry(spark, sf):
    return _tele(spark, sf).select("project", "a", "b", *[rnd_fast(f"{c}_{s}", n).alias(f"{c}_{s}") for c, n in (("raw_lat", 8), ("heading", 6)) for s in ("a", "b")])


_off = lambda p, fn: f"(CASE WHEN {sql_hav(f'{p}_a'.replace('Q', 'lat'), f'{p}_a'.replace('Q', 'lon'), f'{p}_b'.replace('Q', 'lat'), f'{p}_b'.replace('Q', 'lon'))} < 1e-9 THEN 0.0 ELSE {sql_hav('lat_a', 'lon_a', 'lat_b', 'lon_b')} * {fn}(radians({sql_bearing('lat_a', 'lon_a', 'lat_b', 'lon_b')} - h_a)) END)"
_dh = "((h_b - h_a + 180) - 360 * floor((h_b - h_a + 180) / 360) - 180)"
REP_SQL = META_SQL + f""", rep AS (SELECT project, a, b, round({_off('Q', 'cos')}, 3) AS lo, round({_off('Q', 'sin')}, 3) AS la, round({_dh}, 1) AS dh FROM tele)"""


@query("pass_report", "WITH " + REP_SQL + f" SELECT project, a, b, {r('lo', 3)} AS corrected_longitudinal_m, {r('la', 3)} AS corrected_lateral_m, {r('dh', 1)} AS delta_heading FROM rep")
def pass_report(spark, sf):
    return ps.pass_report(_tele(spark, sf)).select("project", "a", "b", "corrected_longitudinal_m", "corrected_lateral_m", "delta_heading")


@query("pass_summary", "WITH " + REP_SQL + """ SELECT project, count(*) AS pair_count, round(avg(abs(la)), 2) AS mean_lateral_m, max(abs(la)) AS max_lateral_m, round(avg(abs(lo)), 2) AS mean_longitudinal_m, max(abs(lo)) AS max_longitudinal_m, round(avg(abs(dh)), 1) AS mean_delta_heading, max(abs(dh)) AS max_delta_heading FROM rep GROUP BY 1""")
def pass_summary(spark, sf):
    out = ps.pass_summary(ps.pass_report(_tele(spark, sf)), ["project"])
    return out.withColumn("mean_lateral_m", F.round("mean_lateral_m", 2)).withColumn("mean_longitudinal_m", F.round("mean_longitudinal_m", 2)).withColumn("mean_delta_heading", F.round("mean_delta_heading", 1))


@query("nearest_earlier", "WITH " + PASS_SQL + f""", p AS (SELECT project, frame_idx, frame_idx * 37 % 401 + value / 500 AS x, CAST(frame_idx % 3 AS DOUBLE) AS y FROM pf),
c AS (SELECT a.project, a.frame_idx, b.frame_idx AS t, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON b.project = a.project AND b.frame_idx < a.frame_idx - 15 AND abs(a.x - b.x) <= 4)
SELECT project, frame_idx, {r('min(d)')} AS d FROM c WHERE d <= 4 GROUP BY 1, 2""")
def nearest_earlier(spark, sf):
    f = _pf(spark, sf).select("project", "frame_idx", (F.col("frame_idx") * 37 % 401 + F.col("value") / 500).alias("x"), (F.col("frame_idx") % 3).cast("double").alias("y"))
    return ps.nearest_earlier(f, ["project"], 15, 4.0).select("project", "frame_idx", rnd("_d").alias("d"))


@query("align_passes")
def align_passes(spark, sf):
    from ..operators.blocks import scan, series
    f = scan(_pf(spark, sf).select("project", F.col("frame_idx").alias("at"), "lat", "lon"), series("project", "at"), number="frame_idx")
    out = ps.align_passes(f, ["project"])
    return out.select("project", "frame_idx", rnd("lat", 8).alias("lat"), rnd("lon", 8).alias("lon"))


# Defects: rectangles in metres; three projects; frames are supplier keys.
DET_SQL = """det AS (SELECT o_orderkey AS det_id, o_custkey % 3 AS project, o_orderstatus AS class, o_orderkey // 40 AS frame_idx,
  (o_orderkey * 13 % 701) * 0.5::DOUBLE AS x, (o_orderkey * 7 % 97) * 0.25::DOUBLE AS y, 0.3::DOUBLE + (o_orderkey % 4) * 0.2::DOUBLE AS w, 0.4::DOUBLE + (o_orderkey % 3) * 0.3::DOUBLE AS h FROM orders),
pr AS (SELECT a.project, a.class, a.det_id AS a, b.det_id AS b, a.frame_idx AS fa, b.frame_idx AS fb, a.w AS aw, a.h AS ah, b.w AS bw, b.h AS bh,
  sqrt(pow(greatest(0, a.x - b.x - b.w, b.x - a.x - a.w), 2) + pow(greatest(0, a.y - b.y - b.h, b.y - a.y - a.h), 2)) AS gap FROM det a JOIN det b ON a.project = b.project AND a.class = b.class AND a.det_id < b.det_id AND b.x BETWEEN a.x - 3.1 AND a.x + 3.1 AND abs(a.frame_idx - b.frame_idx) <= 10),
sm AS (SELECT *, least(aw, bw) * least(ah, bh) / (aw * ah + bw * bh - least(aw, bw) * least(ah, bh)) AS sim FROM pr WHERE gap < 2)"""


def _det(spark, sf):
    k = F.col("o_orderkey")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    o = table(spark, sf, "orders").select(
        k.alias("det_id"), (F.col("o_custkey") % 3).alias("project"), F.col("o_orderstatus").alias("class"), F.floor(k / 40).alias("frame_idx"),
        ((k * 13 % 701) * F.lit(0.5)).alias("x"), ((k * 7 % 97) * F.lit(0.25)).alias("y"), ((k % 4) * F.lit(0.2) + 0.3).alias("w"), ((k % 3) * F.lit(0.3) + 0.4).alias("h"))
    ring, cam = F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)), p(x * 0.9, y + 3.0)
    return o.select("det_id", "project", "class", "frame_idx", ring.alias("points"), cam.alias("cam"))


@query("polygon_distance", "WITH " + DET_SQL + f" SELECT a, b, {r('gap')} AS gap FROM pr WHERE gap < 2")
def polygon_distance(spark, sf):
    return gp.polygon_pairs(_det(spark, sf), ["project", "class"], 2.0, 10).select("a", "b", rnd("gap").alias("gap"))


@query("shape_similarity", f"WITH d AS (SELECT o_orderkey AS k, 0.3::DOUBLE + (o_orderkey % 4) * 0.2::DOUBLE AS w, 0.4::DOUBLE + (o_orderkey % 3) * 0.3::DOUBLE AS h, 0.2::DOUBLE + (o_custkey % 5) * 0.2::DOUBLE AS v FROM orders) SELECT k, {r('least(w, v) * least(h, 1.0) / (w * h + v - least(w, v) * least(h, 1.0))')} AS similarity FROM d")
def shape_similarity(spark, sf):
    d = _det(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("det_id"), ((F.col("o_custkey") % 5) * F.lit(0.2) + 0.2).alias("v")), "det_id")
    z, v = F.lit(0.0), F.col("v")
    bx, by = F.array(z, v, v, z), F.array(z, z, z + 1.0, z + 1.0)
    d = d.repartition(tasks(d), "det_id")
    sim = pg.shape_similarity(pg.xs(F.col("points")), pg.ys(F.col("points")), bx, by)
    return d.select(F.col("det_id").alias("k"), rnd(sim).alias("similarity"))


@query("defect_pairs", "WITH " + DET_SQL + " SELECT a, b FROM sm WHERE gap < 0.2 - 1e-9 OR sim > 0.5 + 1e-9")
def defect_pairs(spark, sf):
    return gp.defect_pairs(_det(spark, sf), ["project"]).select("a", "b")


@query("defect_groups", "WITH RECURSIVE " + DET_SQL + """, e AS MATERIALIZED (SELECT a AS u, b AS v FROM sm WHERE gap < 0.2 - 1e-9 OR sim > 0.5 + 1e-9), s AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT det_id AS n, det_id AS c FROM det UNION SELECT s.v, r.c FROM reach r JOIN s ON s.u = r.n WHERE r.c < s.v)
SELECT n AS det_id, min(c) AS group_id FROM reach GROUP BY 1""")
def defect_groups(spark, sf):
    return gp.defect_groups(_det(spark, sf), ["project"]).select("det_id", "group_id")


@query("dedupe_group")
def dedupe_group(spark, sf):
    g = gp.defect_groups(_det(spark, sf), ["project"])
    return gp.dedupe_group(g, ["project"]).select("det_id", "group_id", rnd("dist_to_cam").alias("dist_to_cam"))


@query("choose_representative")
def choose_representative(spark, sf):
    from ..session import cut
    g = cut(gp.defect_groups(_det(spark, sf), ["project"]))
    out = gp.choose_representative(g, gp.dedupe_group(g, ["project"]))
    return out.select("det_id", "group_id", "group_size", "hidden", "is_grouped", "is_stitched")


@query("spanned_frames")
def spanned_frames(spark, sf):
    from ..session import cut
    g = cut(gp.defect_groups(_det(spark, sf), ["project"]))
    return gp.spanned_frames(gp.choose_representative(g, gp.dedupe_group(g, ["project"])))


@query("merge_polygons")
def merge_polygons(spark, sf):
    from ..session import cut
    g = cut(gp.defect_groups(_det(spark, sf), ["project"]))
    left = cut(gp.dedupe_group(g, ["project"]))
    out = gp.merge_polygons(left, ["project"])
    return out.select("group_id", "part", rnd("area_sqm", 4).alias("area_sqm"))


# Touching boxes only, so that the union is one part; edges sit on the grid, so cells are exact.
@query("merge_polygons_touching", """WITH d AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderkey % 5 AS x, o_orderkey % 3 AS y FROM orders),
c AS (SELECT DISTINCT g, x + i AS cx, y + j AS cy FROM d, range(6) a(i), range(6) b(j))
SELECT g AS group_id, count(*)::DOUBLE AS area_sqm FROM c GROUP BY 1""")
def merge_polygons_touching(spark, sf):
    k = F.col("o_orderkey")
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    x, y = k % 5, k % 3
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), k.alias("det_id"), F.lit(0).alias("frame_idx"),
                                          F.array(p(x, y), p(x + 6, y), p(x + 6, y + 6), p(x, y + 6)).alias("points"))
    return gp.merge_polygons(d, [], 1.0).select("group_id", F.round("area_sqm", 4).alias("area_sqm"))


@query("merged_outline", """WITH d AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderkey % 5 AS x, o_orderkey % 3 AS y FROM orders),
c AS (SELECT DISTINCT g, x + i AS cx, y + j AS cy FROM d, range(6) a(i), range(6) b(j))
SELECT g AS group_id, cy AS row, cx AS col FROM c WHERE (SELECT count(*) FROM c n WHERE n.g = c.g AND abs(n.cx - c.cx) + abs(n.cy - c.cy) = 1) < 4""")
def merged_outline(spark, sf):
    k = F.col("o_orderkey")
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    x, y = k % 5, k % 3
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), k.alias("det_id"), F.lit(0).alias("frame_idx"),
                                          F.array(p(x, y), p(x + 6, y), p(x + 6, y + 6), p(x, y + 6)).alias("points"))
    return gp.merged_outline(d, [], 1.0).select("group_id", "row", "col")


@query("overlapping_defects", """WITH d AS (SELECT o_orderkey AS k, o_custkey % 40 AS scene, (o_orderkey * 13 % 701) * 0.05::DOUBLE AS x, (o_orderkey * 7 % 97) * 0.05::DOUBLE AS y, 0.5::DOUBLE + (o_orderkey % 4) * 0.25::DOUBLE AS w, 0.5::DOUBLE + (o_orderkey % 3) * 0.25::DOUBLE AS h FROM orders),
o AS (SELECT a.scene, a.k AS a, b.k AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) AS s FROM d a JOIN d b ON a.scene = b.scene AND a.k < b.k AND b.x BETWEEN a.x - 2 AND a.x + 2)
SELECT scene, a, b, """ + r("s") + " AS overlap FROM o WHERE s > 0.2503")
def overlapping_defects(spark, sf):
    k = F.col("o_orderkey")
    x, y = (k * 13 % 701) * F.lit(0.05), (k * 7 % 97) * F.lit(0.05)
    w, h = (k % 4) * F.lit(0.25) + 0.5, (k % 3) * F.lit(0.25) + 0.5
    b = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("scene"), k.alias("det_id"), x.alias("x_min"), y.alias("y_min"), (x + w).alias("x_max"), (y + h).alias("y_max"), (w * h).alias("area"))
    return gp.overlapping_defects(b, ["scene"], 0.2503).withColumn("overlap", rnd_fast("overlap"))


@query("local_polygons", f"""WITH o AS (SELECT user_id, arg_min((event_id % 1000) * 1e-5::DOUBLE - 32.4::DOUBLE, event_id) FILTER (WHERE event_id % 11 <> 0) AS la0, arg_min((event_id % 7) * 1e-5::DOUBLE + 151.75::DOUBLE, event_id) FILTER (WHERE event_id % 11 <> 0) AS lo0 FROM events GROUP BY 1),
f AS (SELECT e.event_id, (event_id % 900) * 1e-5::DOUBLE - 32.39::DOUBLE AS la, (event_id % 5) * 1e-5::DOUBLE + 151.76::DOUBLE AS lo, la0, lo0 FROM events e JOIN o ON o.user_id = e.user_id)
SELECT event_id AS det_id, {r(f"{sql_hav('la0', 'lo0', 'la', 'lo')} * sin(radians({sql_bearing('la0', 'lo0', 'la', 'lo')}))", 3)} AS x, {r(f"{sql_hav('la0', 'lo0', 'la', 'lo')} * cos(radians({sql_bearing('la0', 'lo0', 'la', 'lo')}))", 3)} AS y FROM f""")
def local_polygons(spark, sf):
    i = F.col("frame_idx")
    ring = F.array(F.struct(((i % 5) * F.lit(1e-5) + 151.76).alias("x"), ((i % 900) * F.lit(1e-5) - 32.39).alias("y")))
    d = feeds.frames(spark, sf).select("session_id", "frame_idx", i.alias("det_id"), F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"), ring.alias("ring"))
    out = gp.local_polygons(d, ["session_id"])
    return out.select("det_id", rnd(F.col("points")[0]["x"], 3).alias("x"), rnd(F.col("points")[0]["y"], 3).alias("y"))
