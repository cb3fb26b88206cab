"""Point cloud and evaluation queries."""

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import points as pt
from . import feeds
from .registry import query, r, rnd, table


@query("filter_points", "WITH " + feeds.POINTS_SQL + " SELECT idx FROM points WHERE confidence >= 0.05 AND y >= -0.1 AND y <= 0.2")
def filter_points(spark, sf):
    return pt.filter_points(feeds.points(spark, sf), 0.05, -0.1, 0.2).select("idx")


@query("union_frames", "WITH " + feeds.POINTS_SQL + f" SELECT idx, {r('CASE WHEN frame_id < 2 THEN confidence ELSE 1.0 END')} AS confidence, 128 AS r, 128 AS g, 128 AS b FROM points")
def union_frames(spark, sf):
    p = feeds.points(spark, sf)
    out = pt.union_frames([p.where("frame_id < 2"), p.where("frame_id >= 2").drop("confidence")])
    return out.select("idx", rnd("confidence").alias("confidence"), "r", "g", "b")


BEV_SQL = feeds.POINTS_SQL + """, hd AS (SELECT frame_id, min(x) AS x0, min(z) AS z0, greatest(1, CAST(ceil((max(x) - min(x)) / 0.5) AS INTEGER)) AS w, greatest(1, CAST(ceil((max(z) - min(z)) / 0.5) AS INTEGER)) AS h FROM points GROUP BY 1)"""


@query("bev_grid", "WITH " + BEV_SQL + f""", c AS (SELECT p.frame_id, idx, class, severity, CAST(greatest(0, least(floor((x - x0) / 0.5), w - 1)) AS INTEGER) AS xi, CAST(greatest(0, least(floor((z - z0) / 0.5), h - 1)) AS INTEGER) AS zi FROM points p JOIN hd ON hd.frame_id = p.frame_id),
v AS (SELECT frame_id, zi, xi, class, count(*) AS n, min(idx) AS f, max(severity) AS s FROM c GROUP BY 1, 2, 3, 4)
SELECT frame_id, zi, xi, arg_max(class, (n, -f)) AS class, {r('max(s)')} AS severity, CAST(sum(n) AS BIGINT) AS points FROM v GROUP BY 1, 2, 3""")
def bev_grid(spark, sf):
    return pt.bev_grid(feeds.points(spark, sf), 0.5, ["frame_id"]).withColumn("severity", rnd("severity"))


@query("bev_header", "WITH " + BEV_SQL + f" SELECT frame_id, {r('x0')} AS x_min, {r('z0')} AS z_min, w, h FROM hd")
def bev_header(spark, sf):
    return pt.bev_header(feeds.points(spark, sf), 0.5, ["frame_id"]).select("frame_id", rnd("x_min").alias("x_min"), rnd("z_min").alias("z_min"), "w", "h")


@query("road_candidates", "WITH " + feeds.POINTS_SQL + " SELECT p.idx FROM points p JOIN (SELECT frame_id, quantile_cont(y, 0.4) AS q FROM points GROUP BY 1) t ON t.frame_id = p.frame_id WHERE y < q")
def road_candidates(spark, sf):
    return pt.road_candidates(feeds.points(spark, sf), ["frame_id"]).select("idx")


@query("median_center", "WITH " + feeds.POINTS_SQL + f", m AS (SELECT frame_id, median(x) AS mx, median(y) AS my, median(z) AS mz FROM points GROUP BY 1) SELECT idx, {r('x - mx')} AS x, {r('y - my')} AS y, {r('z - mz')} AS z FROM points p JOIN m ON m.frame_id = p.frame_id")
def median_center(spark, sf):
    return pt.median_center(feeds.points(spark, sf), ["frame_id"]).select("idx", *[rnd(a).alias(a) for a in "xyz"])


@query("exact_percentiles", f"SELECT user_id, {r('quantile_cont(value, 0.02)')} AS p2, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.98)')} AS p98 FROM events GROUP BY 1")
def exact_percentiles(spark, sf):
    out = pt.exact_percentiles(table(spark, sf, "events"), ["user_id"], "value", [0.02, 0.5, 0.98])
    return out.select("user_id", *[rnd(F.col("p")[i]).alias(n) for i, n in enumerate(("p2", "p50", "p98"))])


@query("min_max_normalize", f"SELECT event_id, {r('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END')} AS value FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)")
def min_max_normalize(spark, sf):
    return pt.min_max_normalize(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", rnd("value").alias("value"))


@query("percentile_normalize", f"""WITH d AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value END AS depth FROM events), i AS (SELECT *, CASE WHEN depth > 0 THEN 1 / depth ELSE 0.0 END AS inv FROM d),
q AS (SELECT user_id, quantile_cont(inv, 0.02) FILTER (WHERE depth > 0) AS a, quantile_cont(inv, 0.98) FILTER (WHERE depth > 0) AS b FROM i GROUP BY 1)
SELECT event_id, {r('1 - greatest(0.0, least(1.0, (inv - a) / (b - a)))')} AS normalized FROM i JOIN q ON q.user_id = i.user_id""")
def percentile_normalize(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value")).alias("depth"))
    return pt.percentile_normalize(d, ["user_id"], "depth").select("event_id", rnd("normalized").alias("normalized"))


@query("relative_depth", f"""SELECT event_id, {r('1 / greatest(value - q, 1e-5)', 3)} AS rel_depth FROM events e JOIN (SELECT user_id, quantile_cont(value, 0.01) AS q FROM events GROUP BY 1) t ON t.user_id = e.user_id""")
def relative_depth(spark, sf):
    return pt.relative_depth(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", rnd("rel_depth", 3).alias("rel_depth"))


@query("stride_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE j % (CASE WHEN n > 12 THEN n // 12 ELSE 1 END) = 0")
def stride_sample(spark, sf):
    return pt.stride_sample(table(spark, sf, "events").select("event_id", "user_id"), ["user_id"], "event_id", 12).select("event_id")


PLANE_SQL = feeds.POINTS_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY md5(idx::VARCHAR), idx) AS r FROM points),
t AS (SELECT frame_id, (r - 1) // 3 AS k, list({'x': x, 'y': y, 'z': z} ORDER BY r) AS t FROM rk WHERE r <= 300 GROUP BY 1, 2 HAVING count(*) = 3),
n AS (SELECT frame_id, k, t[1] AS p, (t[2].y - t[1].y) * (t[3].z - t[1].z) - (t[2].z - t[1].z) * (t[3].y - t[1].y) AS a, (t[2].z - t[1].z) * (t[3].x - t[1].x) - (t[2].x - t[1].x) * (t[3].z - t[1].z) AS b,
  (t[2].x - t[1].x) * (t[3].y - t[1].y) - (t[2].y - t[1].y) * (t[3].x - t[1].x) AS c FROM t),
u AS (SELECT frame_id, k, p, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM n WHERE sqrt(a * a + b * b + c * c) >= 1e-6),
w AS (SELECT *, -(a * p.x + b * p.y + c * p.z) AS d FROM u),
sc AS (SELECT w.frame_id, k, a, b, c, d, count(*) FILTER (WHERE abs(a * x + b * y + c * z + d) < 0.05) AS inliers FROM w JOIN points q ON q.frame_id = w.frame_id GROUP BY ALL),
plane AS (SELECT frame_id, arg_max({'a': a, 'b': b, 'c': c, 'd': d, 'n': inliers}, (inliers, -k)) AS m FROM sc GROUP BY 1)"""


@query("fit_plane", "WITH " + PLANE_SQL + f" SELECT frame_id, {r('m.a', 5)} AS a, {r('m.b', 5)} AS b, {r('m.c', 5)} AS c, {r('m.d', 5)} AS d, m.n AS inliers FROM plane")
def fit_plane(spark, sf):
    out = pt.fit_plane(feeds.points(spark, sf), ["frame_id"])
    return out.select("frame_id", *[rnd(c, 5).alias(c) for c in "abcd"], "inliers")


@query("plane_depth", "WITH " + PLANE_SQL + f""", s AS (SELECT frame_id, m, CASE WHEN m.b < 0 THEN -1.0 ELSE 1.0 END AS up, 1.6 / abs(m.d) AS f FROM plane WHERE m.d <> 0)
SELECT idx, {r('up * f * (m.a * x + m.b * y + m.c * z + m.d)', 4)} AS signed_m, up * f * (m.a * x + m.b * y + m.c * z + m.d) < -0.05 AS is_pothole FROM points p JOIN s ON s.frame_id = p.frame_id""")
def plane_depth(spark, sf):
    p = feeds.points(spark, sf)
    out = pt.plane_depth(p, pt.fit_plane(p, ["frame_id"]), ["frame_id"], 1.6)
    return out.select("idx", rnd("signed_m", 4).alias("signed_m"), "is_pothole")


@query("depth_stats", "WITH " + PLANE_SQL + f""", d AS (SELECT p.frame_id, sign(m.c) * (m.a * x + m.b * y + m.c * z + m.d) / sqrt(m.a * m.a + m.b * m.b + m.c * m.c) AS raw FROM points p JOIN plane USING (frame_id)),
e AS (SELECT frame_id, CASE WHEN raw < 0.005 THEN 0.0 ELSE least(raw, 0.4) END AS m FROM d)
SELECT frame_id, {r('coalesce(quantile_cont(m, 0.98) FILTER (WHERE m > 0), 0)')} AS max_depth_m, {r('coalesce(avg(m) FILTER (WHERE m > 0), 0)')} AS mean_depth_m, {r('count(*) FILTER (WHERE m > 0)::DOUBLE / count(*)')} AS quality FROM e GROUP BY 1""")
def depth_stats(spark, sf):
    p = feeds.points(spark, sf)
    return pt.depth_stats(p, pt.fit_plane(p, ["frame_id"]), ["frame_id"]).select("frame_id", *[rnd(n).alias(n) for n in ("max_depth_m", "mean_depth_m", "quality")])


@query("refit_plane", "WITH " + PLANE_SQL + f""", g AS (SELECT p.frame_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz
  FROM points p JOIN plane USING (frame_id) WHERE abs(m.a * x + m.b * y + m.c * z + m.d) < 0.05 GROUP BY 1 HAVING xx * yy - xy * xy > 1e-12 * xx * yy),
f AS (SELECT frame_id, mx, my, mz, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS u, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS v FROM g)
SELECT p.frame_id, {r('coalesce(-u / sqrt(u * u + v * v + 1), m.a)', 5)} AS a, {r('coalesce(-v / sqrt(u * u + v * v + 1), m.b)', 5)} AS b, {r('coalesce(1 / sqrt(u * u + v * v + 1), m.c)', 5)} AS c,
  {r('coalesce(-(mz - u * mx - v * my) / sqrt(u * u + v * v + 1), m.d)', 5)} AS d FROM plane p LEFT JOIN f USING (frame_id)""")
def refit_plane(spark, sf):
    p = feeds.points(spark, sf)
    return pt.refit_plane(p, pt.fit_plane(p, ["frame_id"]), ["frame_id"]).select("frame_id", *[rnd(c, 5).alias(c) for c in "abcd"])


# Triangles: v(row, col) is the deepest order on the cell; tl-bl-tr and tr-bl-br.
_TRI = lambda a, b, c: f"greatest(abs({a}.d - {b}.d), abs({b}.d - {c}.d), abs({c}.d - {a}.d)) / (least({a}.d, {b}.d, {c}.d) + 1e-6) < 1.5 AND NOT ({a}.sky OR {b}.sky OR {c}.sky)"


@query("depth_faces", f"""WITH g AS (SELECT o_custkey % 50 AS img, o_orderkey % 16 AS row, (o_orderkey // 16) % 16 AS col, max(o_totalprice) AS d, max(o_totalprice) > 480000 AS sky FROM orders GROUP BY 1, 2, 3),
q AS (SELECT a.img, a.row, a.col, ({_TRI('a', 'c', 'b')}) AS f0, ({_TRI('b', 'c', 'e')}) AS f1 FROM g a JOIN g b ON b.img = a.img AND b.row = a.row AND b.col = a.col + 1
  JOIN g c ON c.img = a.img AND c.row = a.row + 1 AND c.col = a.col JOIN g e ON e.img = a.img AND e.row = a.row + 1 AND e.col = a.col + 1)
SELECT img, row, col, 0 AS half FROM q WHERE f0 UNION ALL SELECT img, row, col + 1, 1 FROM q WHERE f1""")
def depth_faces(spark, sf):
    k = F.col("o_orderkey")
    g = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("img"), (k % 16).alias("row"), (F.floor(k / 16) % 16).alias("col")).agg(F.max("o_totalprice").alias("depth"))
    out = pt.depth_faces(g.withColumn("sky", F.col("depth") > 480000), ["img"])
    return out.select("img", F.col("a.row").alias("row"), F.col("a.col").alias("col"), "half")


# Metrics ----------------------------------------------------------------------


@query("confusion_matrix", "WITH " + feeds.PIXELS_SQL + " SELECT CAST(a.i AS INTEGER) AS target_class, CAST(b.i AS INTEGER) AS pred_class, count(p.image_id) AS pixels FROM range(9) a(i) CROSS JOIN range(9) b(i) LEFT JOIN pixels p ON p.target_class = a.i AND p.pred_class = b.i GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(feeds.pixels(spark, sf), 9)


CM = feeds.PIXELS_SQL + """, cls AS (SELECT CAST(i AS INTEGER) AS c FROM range(9) t(i)), k AS (SELECT c, (SELECT count(*) FROM pixels WHERE target_class = c AND pred_class = c) AS tp, (SELECT count(*) FROM pixels WHERE target_class = c) AS t, (SELECT count(*) FROM pixels WHERE pred_class = c) AS p FROM cls)"""


@query("class_metrics", "WITH " + CM + f" SELECT c AS class, {r('CASE WHEN t + p - tp > 0 THEN tp::DOUBLE / (t + p - tp) ELSE 0.0 END')} AS iou, {r('CASE WHEN t > 0 THEN tp::DOUBLE / t ELSE 0.0 END')} AS accuracy FROM k")
def class_metrics(spark, sf):
    return mt.class_metrics(mt.confusion_matrix(feeds.pixels(spark, sf), 9)).select("class", rnd("iou").alias("iou"), rnd("accuracy").alias("accuracy"))


@query("seg_metrics", "WITH " + CM + f" SELECT {r('sum(tp)::DOUBLE / sum(t)')} AS pixel_accuracy, {r('avg(CASE WHEN t + p - tp > 0 THEN tp::DOUBLE / (t + p - tp) ELSE 0.0 END)')} AS miou, {r('avg(CASE WHEN t > 0 THEN tp::DOUBLE / t ELSE 0.0 END)')} AS mean_class_accuracy FROM k")
def seg_metrics(spark, sf):
    out = mt.seg_metrics(mt.confusion_matrix(feeds.pixels(spark, sf), 9))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("depth_metrics", "WITH " + feeds.PIXELS_SQL + f""", e AS (SELECT image_id, avg(pow(pred_depth - target_depth, 2)) AS mse, avg(abs(pred_depth - target_depth) / target_depth) AS rel FROM pixels WHERE target_depth > 0 GROUP BY 1),
q AS (SELECT greatest(pred_depth / target_depth, target_depth / pred_depth) AS q FROM pixels WHERE target_depth > 0)
SELECT {r('(SELECT sqrt(avg(mse)) FROM e)')} AS rmse, {r('(SELECT avg(rel) FROM e)')} AS abs_rel, {r('avg(CASE WHEN q < 1.25 THEN 1.0 ELSE 0.0 END)')} AS delta_1, {r('avg(CASE WHEN q < pow(1.25, 2) THEN 1.0 ELSE 0.0 END)')} AS delta_2, {r('avg(CASE WHEN q < pow(1.25, 3) THEN 1.0 ELSE 0.0 END)')} AS delta_3 FROM q""")
def depth_metrics(spark, sf):
    out = mt.depth_metrics(feeds.pixels(spark, sf))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


# Rotations about y only, so the geodesic angle is the folded difference.
@query("camera_metrics", f"""WITH p AS (SELECT value AS v, value / 200 AS a, value / 400 AS b FROM events)
SELECT {r('avg((abs(v * 0.01) + abs(v * 0.02) + 1 + 2) / 4)')} AS intrinsic_mae, {r('avg(acos(greatest(-1.0, least(1.0, cos(a - b)))))')} AS rotation_geodesic, {r('avg(sqrt(v * v + 9 + 16))', 4)} AS translation_error FROM p""")
def camera_metrics(spark, sf):
    v, z = F.col("value"), F.lit(0.0)
    p = table(spark, sf, "events").select(
        (v * 1.01).alias("p_fx"), v.alias("t_fx"), (v * 1.02).alias("p_fy"), v.alias("t_fy"), F.lit(1.0).alias("p_cx"), z.alias("t_cx"), F.lit(2.0).alias("p_cy"), z.alias("t_cy"),
        z.alias("p_r1"), (v / 200).alias("p_r2"), z.alias("p_r3"), z.alias("t_r1"), (v / 400).alias("t_r2"), z.alias("t_r3"),
        v.alias("p_t1"), z.alias("t_t1"), F.lit(3.0).alias("p_t2"), z.alias("t_t2"), F.lit(4.0).alias("p_t3"), z.alias("t_t3"))
    out = mt.camera_metrics(p)
    return out.select(rnd("intrinsic_mae").alias("intrinsic_mae"), rnd("rotation_geodesic").alias("rotation_geodesic"), rnd("translation_error", 4).alias("translation_error"))


@query("severity_metrics", "WITH " + feeds.PIXELS_SQL + f", e AS (SELECT image_id, avg(abs(pred_severity - target_severity)) AS m FROM pixels WHERE target_class > 0 GROUP BY 1) SELECT {r('(SELECT avg(m) FROM e)')} AS mae, {r('corr(pred_severity, target_severity)')} AS pearson_correlation FROM pixels WHERE target_class > 0")
def severity_metrics(spark, sf):
    out = mt.severity_metrics(feeds.pixels(spark, sf))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("masked_l1", "WITH " + feeds.PIXELS_SQL + f" SELECT {r('sum(abs(pred_depth - target_depth)) / count(*)')} AS masked_l1 FROM pixels WHERE target_class > 1")
def masked_l1(spark, sf):
    px = feeds.pixels(spark, sf).withColumn("m", (F.col("target_class") > 1).cast("int"))
    return mt.masked_l1(px, "target_depth", "pred_depth", "m").select(rnd("masked_l1").alias("masked_l1"))


@query("binary_confusion", "WITH " + feeds.PIXELS_SQL + f""" SELECT image_id, count(*) FILTER (WHERE target_class > 1 AND pred_class > 1) AS tp, count(*) FILTER (WHERE target_class <= 1 AND pred_class > 1) AS fp, count(*) FILTER (WHERE target_class > 1 AND pred_class <= 1) AS fn,
  {r('avg(abs(target_depth - pred_depth))')} AS depth_error, {r('avg(abs(target_severity - pred_severity))')} AS severity_error FROM pixels GROUP BY 1""")
def binary_confusion(spark, sf):
    out = mt.binary_confusion(feeds.pixels(spark, sf))
    return out.select("image_id", "tp", "fp", "fn", rnd("depth_error").alias("depth_error"), rnd("severity_error").alias("severity_error"))


# Dents: an order's frame looks straight down from relative height 2; every line is a cell, deeper by its discount.
DENT_SQL = """cells AS (SELECT DISTINCT o_custkey % 20 AS frame_id, l_orderkey % 300 AS row, l_partkey % 300 AS col, CASE WHEN (l_orderkey + l_partkey) % 3 = 0 THEN 2 + CAST((l_orderkey % 300 + l_partkey % 7) % 20 AS DOUBLE) / 100 ELSE 2 END AS depth
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT *, least((depth - 2) * 0.75, 0.4) AS d FROM cells)"""


@query("physical_depth", "WITH " + DENT_SQL + f"""
SELECT frame_id, {r('quantile_cont(d, 0.98) FILTER (WHERE d >= 0.005)')} AS max_depth_m, {r('avg(d) FILTER (WHERE d >= 0.005)')} AS mean_depth_m, {r('count(*) FILTER (WHERE d >= 0.005) * pow(1.5 / 500, 2)', 9)} AS area_sqm,
  {r('sum(d) FILTER (WHERE d >= 0.005) * pow(1.5 / 500, 2)', 9)} AS volume_m3, {r('count(*) FILTER (WHERE d >= 0.005)::DOUBLE / count(*)')} AS quality FROM m GROUP BY 1""")
def physical_depth(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 20).alias("frame_id"))
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    deep = F.when((k + p) % 3 == 0, F.lit(2.0) + ((k % 300 + p % 7) % 20).cast("double") / 100).otherwise(2.0)
    cells = table(spark, sf, "lineitem").join(o, "l_orderkey").select("frame_id", (k % 300).alias("row"), (p % 300).alias("col"), deep.alias("depth")).distinct().withColumn("mask", F.lit(True))
    frames = o.select("frame_id").distinct()
    cams = frames.withColumn("k", F.array(*[F.lit(float(x)) for x in (500, 0, 150, 0, 500, 150, 0, 0, 1)]))
    road = frames.select("frame_id", *[F.lit(float(x)).alias(n) for n, x in zip("abcd", (0, 0, 1, -2))])
    out = pt.physical_depth(cells, cams, road, ["frame_id"], 1.5)
    return out.select("frame_id", *[rnd(c, 9 if c in ("area_sqm", "volume_m3") else 6).alias(c) for c in ("max_depth_m", "mean_depth_m", "area_sqm", "volume_m3", "quality")])
