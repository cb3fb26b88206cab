"""Corridor, vanishing point and edit queries."""

from pyspark.sql import functions as F

from ..operators import corridor as co
from ..operators import edits as ed
from ..operators import vanishing as vp
from . import feeds
from .registry import query, r, rnd, sql_bearing, sql_hav, table

FR = feeds.FRAMES_SQL + f""", b AS (SELECT session_id AS s, arg_min(lat, frame_idx) AS la0, arg_min(lon, frame_idx) AS lo0, arg_min(value, frame_idx) AS h0 FROM frames GROUP BY 1),
m AS (SELECT f.session_id, frame_idx, la0, lo0, h0, {sql_hav('la0', 'lo0', 'lat', 'lon')} AS d, radians({sql_bearing('la0', 'lo0', 'lat', 'lon')} - h0) AS a FROM frames f JOIN b ON b.s = f.session_id),
ex AS (SELECT session_id, min(d * sin(a)) - 10 AS x0, max(d * sin(a)) + 10 AS x1, min(d * cos(a)) - 10 AS y0, max(d * cos(a)) + 10 AS y1 FROM m GROUP BY 1),
cv AS (SELECT *, CASE WHEN greatest(floor((x1 - x0) * 50), floor((y1 - y0) * 50)) > 8192 THEN 50 * (8192 / greatest(floor((x1 - x0) * 50), floor((y1 - y0) * 50))) ELSE 50.0 END AS ppm FROM ex)"""


def _frames(spark, sf):
    return feeds.frames(spark, sf).select("session_id", "frame_idx", "lat", "lon", F.col("value").alias("heading"))


@query("canvas", "WITH " + FR + f" SELECT session_id, {r('x0', 4)} AS min_x_m, {r('y1', 4)} AS max_y_m, {r('ppm', 5)} AS ppm, CAST(floor((x1 - x0) * ppm + 1e-6) AS INTEGER) AS w_canvas, CAST(floor((y1 - y0) * ppm + 1e-6) AS INTEGER) AS h_canvas FROM cv")
def canvas(spark, sf):
    out = co.canvas(_frames(spark, sf), ["session_id"])
    # the capped side is 8192 up to rounding noise
    side = lambda lo, hi: F.floor((F.col(hi) - F.col(lo)) * F.col("ppm") + 1e-6).cast("int")
    return out.select("session_id", rnd("min_x_m", 4).alias("min_x_m"), rnd("max_y_m", 4).alias("max_y_m"), rnd("ppm", 5).alias("ppm"),
                      side("min_x_m", "max_x_m").alias("w_canvas"), side("min_y_m", "max_y_m").alias("h_canvas"))


@query("canvas_centers", "WITH " + FR + f" SELECT m.session_id, frame_idx, {r('(d * sin(a) - x0) * ppm', 3)} AS cx, {r('(y1 - d * cos(a)) * ppm', 3)} AS cy FROM m JOIN cv ON cv.session_id = m.session_id")
def canvas_centers(spark, sf):
    out = co.canvas_centers(_frames(spark, sf), ["session_id"])
    return out.select("session_id", "frame_idx", rnd("cx", 3).alias("cx"), rnd("cy", 3).alias("cy"))


# Cells: every line of an order is a canvas cell of the frame; corridors are customers.
SEAM_SQL = """ctr AS (SELECT o_custkey AS c, o_orderkey AS f, CAST(o_orderkey % 40 AS DOUBLE) * 10 AS cx, CAST(o_orderkey % 7 AS DOUBLE) * 4 AS cy FROM orders),
cel AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS f, CAST(o_orderkey % 40 AS DOUBLE) * 10 + l_quantity - 25 AS x, CAST(o_orderkey % 7 AS DOUBLE) * 4 + l_linenumber * 3 - 10 AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
d AS (SELECT cel.*, sqrt(pow(x - a.cx, 2) + pow(y - a.cy, 2)) AS own, (SELECT min(sqrt(pow(x - b.cx, 2) + pow(y - b.cy, 2))) FROM ctr b WHERE b.c = cel.c AND b.f <> cel.f) AS other FROM cel JOIN ctr a ON a.c = cel.c AND a.f = cel.f),
al AS (SELECT *, coalesce(greatest(0.0, least(1.0, (other - own + 10) / 20)), 1.0) AS alpha FROM d)"""


def _seam(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), k.alias("frame_idx"), ((k % 40).cast("double") * 10).alias("cx"), ((k % 7).cast("double") * 4).alias("cy"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_idx"), "l_quantity", "l_linenumber")
    cells = o.join(li, "frame_idx").select("c", "frame_idx", (F.col("cx") + F.col("l_quantity") - 25).alias("x"), (F.col("cy") + F.col("l_linenumber") * 3 - 10).alias("y")).distinct()
    return cells, o


@query("nearest_center", "WITH " + SEAM_SQL + f" SELECT c, f AS frame_idx, x, y, {r('own')} AS own, CASE WHEN other IS NOT NULL THEN {r('other')} END AS other, {r('alpha')} AS alpha FROM al")
def nearest_center(spark, sf):
    out = co.nearest_center(*_seam(spark, sf), ["c"])
    return out.select("c", "frame_idx", "x", "y", rnd("own").alias("own"), rnd("other").alias("other"), rnd("alpha").alias("alpha"))


@query("composite_corridor", "WITH " + SEAM_SQL + """, v AS (SELECT c, x, y, f, CAST(f % 256 AS INTEGER) AS r, CAST(f % 100 AS INTEGER) AS g, 7 AS b, alpha FROM al),
u AS (SELECT * FROM v WHERE round_even(r * 0.299 + g * 0.587 + b * 0.114, 0) > 10 AND alpha > 0)
SELECT c, x, y, max(f) AS frame_idx, CAST(arg_max(CASE WHEN alpha < 1 THEN floor(r * alpha + 1e-9) ELSE r END, f) AS INTEGER) AS r FROM u GROUP BY 1, 2, 3""")
def composite_corridor(spark, sf):
    cells = co.nearest_center(*_seam(spark, sf), ["c"])
    f = F.col("frame_idx")
    # weights at rounding noise below a whole colour step count as on it, as in the SQL
    cells = cells.withColumn("r", (f % 256).cast("int")).withColumn("g", (f % 100).cast("int")).withColumn("b", F.lit(7))
    cells = cells.withColumn("alpha", F.when((F.col("alpha") < 1) & (F.col("alpha") > 0) & (F.col("r") > 0), F.col("alpha") + F.lit(1e-9) / F.col("r")).otherwise(F.col("alpha")))
    return co.composite_corridor(cells, ["c"]).select("c", "x", "y", "frame_idx", "r")


# Segments: an image per customer.
SEG_SQL = """sg AS (SELECT o_custkey AS image, o_orderkey AS seg_id, o_orderkey % 320 AS x1, o_orderkey % 211 AS y1, (o_orderkey * 7) % 320 AS x2, (o_orderkey * 11) % 211 AS y2, 320 AS w, 240 AS h FROM orders)"""


def _segments(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("image"), k.alias("seg_id"), (k % 320).alias("x1"), (k % 211).alias("y1"), (k * 7 % 320).alias("x2"), (k * 11 % 211).alias("y2"), F.lit(320).alias("w"), F.lit(240).alias("h"))


@query("filter_segments", "WITH " + SEG_SQL + """, a AS (SELECT *, CASE WHEN x1 = x2 THEN 90.0 ELSE degrees(atan2(abs(y2 - y1), abs(x2 - x1))) END AS a, CASE WHEN x1 = x2 THEN true ELSE y1 + (y2 - y1)::DOUBLE / (x2 - x1) * (w / 2.0 - x1) BETWEEN h * 0.15 AND h * 0.45 END AS ok FROM sg),
n AS (SELECT *, count(*) FILTER (WHERE ok AND a BETWEEN 30 AND 85) OVER (PARTITION BY image) AS n FROM a)
SELECT image, seg_id FROM n WHERE ok AND a BETWEEN CASE WHEN n < 8 THEN 15 ELSE 30 END AND 85""")
def filter_segments(spark, sf):
    return vp.filter_segments(_segments(spark, sf)).select("image", "seg_id")


@query("vanishing_point", "WITH " + SEG_SQL + """, l AS (SELECT image, seg_id, (y2 - y1)::DOUBLE / (x2 - x1) AS m, y1 - (y2 - y1)::DOUBLE / (x2 - x1) * x1 AS c, w, h FROM sg WHERE x1 <> x2 AND abs((y2 - y1)::DOUBLE / (x2 - x1)) BETWEEN 0.3 AND 5),
p AS (SELECT a.image, a.w, a.h, CAST(trunc((b.c - a.c) / (a.m - b.m)) AS BIGINT) AS ix, CAST(trunc(a.m * ((b.c - a.c) / (a.m - b.m)) + a.c) AS BIGINT) AS iy FROM l a JOIN l b ON a.image = b.image AND a.seg_id < b.seg_id AND abs(a.m - b.m) >= 0.3),
q AS (SELECT * FROM p WHERE ix >= -0.5 * w AND ix <= 1.5 * w AND iy >= 0 AND iy < h), md AS (SELECT image, median(ix) AS mx, median(iy) AS my FROM q GROUP BY 1)
SELECT q.image, CAST(trunc(coalesce(avg(ix) FILTER (WHERE abs(ix - mx) < w * 0.15 AND abs(iy - my) < h * 0.15), any_value(mx))) AS BIGINT) AS u, CAST(trunc(coalesce(avg(iy) FILTER (WHERE abs(ix - mx) < w * 0.15 AND abs(iy - my) < h * 0.15), any_value(my))) AS BIGINT) AS v
FROM q JOIN md ON md.image = q.image GROUP BY 1""")
def vanishing_point(spark, sf):
    return vp.vanishing_point(_segments(spark, sf))


@query("vanishing_point_ransac", "WITH " + SEG_SQL + f""", n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY seg_id) - 1 AS i, count(*) OVER (PARTITION BY image) AS n, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM sg),
l AS (SELECT *, (y1 - y2)::DOUBLE AS la, (x2 - x1)::DOUBLE AS lb, (x1 * y2 - x2 * y1)::DOUBLE AS lc, len / max(len) OVER (PARTITION BY image) AS wt, (x1 + x2) / 2.0 >= w / 2.0 AS rt FROM n),
v AS (SELECT a.image, a.w, a.h, a.i * (2 * a.n - a.i - 1) / 2 + b.i - a.i - 1 AS k, (a.lb * b.lc - a.lc * b.lb) / (a.la * b.lb - a.lb * b.la) AS vx, (a.lc * b.la - a.la * b.lc) / (a.la * b.lb - a.lb * b.la) AS vy FROM l a JOIN l b ON a.image = b.image AND a.i < b.i WHERE abs(a.la * b.lb - a.lb * b.la) >= 1e-10),
z AS (SELECT * FROM v WHERE vy <= h * 0.5 AND abs(vx - w / 2.0) <= w),
t AS (SELECT z.image, z.k, z.vx, z.vy, z.h, l.wt, l.rt, abs(la * vx + lb * vy + lc) / (sqrt(la * la + lb * lb) + 1e-9) AS gap, abs((vx - (x1 + x2) / 2.0) * (x2 - x1) + (vy - (y1 + y2) / 2.0) * (y2 - y1)) / ((sqrt(pow(vx - (x1 + x2) / 2.0, 2) + pow(vy - (y1 + y2) / 2.0, 2)) + 1e-9) * (len + 1e-9)) AS cs FROM z JOIN l ON l.image = z.image),
s AS (SELECT image, k, vx, vy, count(*) AS n, sum(wt) * (1 + greatest(0, (any_value(h) * 0.5 - vy) / (any_value(h) * 0.5)) * 0.3) AS sc FROM t WHERE gap < 15 AND cs >= 0.7 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4 AND bool_or(rt) AND bool_or(NOT rt)),
best AS (SELECT image, max(sc) AS sc FROM s GROUP BY 1), im AS (SELECT DISTINCT image FROM sg)
SELECT im.image, {r('coalesce(best.sc, 0)', 4)} AS score FROM im LEFT JOIN best ON best.image = im.image""")
def vanishing_point_ransac(spark, sf):
    seg = _segments(spark, sf)
    return vp.vanishing_point_ransac(seg).select("image", rnd("score", 4).alias("score"))


EDIT_SQL = """base AS (SELECT l_orderkey AS f, list({'p': l_extendedprice, 'c': l_returnflag} ORDER BY l_extendedprice, l_returnflag) AS d FROM (SELECT DISTINCT l_orderkey, l_extendedprice, l_returnflag FROM lineitem) GROUP BY 1)"""


def _edit_tables(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag").distinct()
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_returnflag"))).alias("d"))
    det = lists.select(F.col("l_orderkey").cast("string").alias("filename"), F.lit("front").alias("view"), F.posexplode("d").alias("det_idx", "x"))
    pt = lambda v: F.array(F.struct(v.alias("x"), F.lit(0.0).alias("y")))
    det = det.select("filename", "view", "det_idx", F.col("x.l_returnflag").alias("class_name"), pt(F.col("x.l_extendedprice")).alias("points"))
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    key = [F.col("o_orderkey").cast("string").alias("filename"), F.lit("front").alias("view")]
    step = lambda seq, action, idx, cls, at: o.select(
        *key, F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(idx).cast("int").alias("det_idx"), F.lit(cls).cast("string").alias("class_name"),
        (pt(F.lit(float(at))) if at is not None else F.lit(None).cast("array<struct<x:double,y:double>>")).alias("points"))
    log = step(1, "add", None, "new", 1).unionByName(step(2, "delete", 0, None, None)).unionByName(step(3, "update", 0, "upd", None))
    log = log.unionByName(step(4, "re-outline", 1, None, 2)).unionByName(step(5, "add_corridor", 0, "corr", 3)).unionByName(step(6, "delete", 99, None, None))
    return det, log


# add 'new', drop the first, rename the new first, redraw the second, replace the first by a corridor item.
@query("replay_edits", "WITH " + EDIT_SQL + """, o AS (SELECT o_orderkey AS f FROM orders WHERE o_orderkey % 3 = 0),
s1 AS (SELECT o.f, coalesce(d, []) || [{'p': 1.0, 'c': 'new'}] AS d FROM o LEFT JOIN base ON base.f = o.f), s2 AS (SELECT f, d[2:] AS d FROM s1),
s4 AS (SELECT f, list_transform(d, lambda x, i: CASE WHEN i = 2 THEN {'p': 2.0, 'c': x.c} ELSE x END) AS d FROM s2),
s5 AS (SELECT f, CASE WHEN len(d) > 0 THEN [{'p': 3.0, 'c': 'corr'}] || d[2:] ELSE [{'p': 3.0, 'c': 'corr'}] END AS d FROM s4),
al AS (SELECT f, d FROM s5 UNION ALL SELECT base.f, d FROM base WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.f = base.f)),
x AS (SELECT f, unnest(d) AS e, generate_subscripts(d, 1) - 1 AS i FROM al)
SELECT f::VARCHAR AS filename, i::BIGINT AS det_idx, e.c AS class_name, e.p AS x FROM x""")
def replay_edits(spark, sf):
    out = ed.replay_edits(*_edit_tables(spark, sf))
    return out.select("filename", "det_idx", "class_name", F.col("points")[0]["x"].alias("x"))
