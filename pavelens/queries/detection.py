"""Detection, mask and report queries."""

from pyspark.sql import functions as F

from ..functions.scalar import severity as grade
from ..operators import detection as dt
from ..operators import raster
from . import feeds
from .registry import query, r, rnd, table


def _frames_defects(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"))
    d = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_returnflag").alias("class"),
        F.when(F.col("l_linenumber") > 1, grade(F.col("l_quantity") * 50)).alias("severity"))
    return o, d


@query("batch_summary", """SELECT (SELECT count(*) FROM orders) AS total_frames_processed, count(*) AS total_defects_detected,
  (SELECT string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)) AS by_class,
  (SELECT string_agg(g || '=' || n, ',' ORDER BY g) FROM (SELECT CASE WHEN l_quantity * 50 < 500 THEN 'minor' WHEN l_quantity * 50 <= 2000 THEN 'moderate' ELSE 'severe' END AS g, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)) AS by_severity,
  842.5::DOUBLE AS processing_time_seconds, round(842.5::DOUBLE / (SELECT count(*) FROM orders), 3) AS average_time_per_frame_seconds FROM lineitem""")
def batch_summary(spark, sf):
    o, d = _frames_defects(spark, sf)
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    out = dt.batch_summary(o, d, 842.5)
    return out.withColumn("by_class", text("defects_by_class")).withColumn("by_severity", text("defects_by_severity")).drop("defects_by_class", "defects_by_severity")


@query("batch_outcomes", "SELECT o_custkey AS batch, count(*) FILTER (WHERE o_orderstatus <> 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def batch_outcomes(spark, sf):
    return dt.batch_outcomes(_results(spark, sf), ["batch"])


def _results(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").cast("string").alias("filename"),
                                             F.when(F.col("o_orderstatus") != "F", "success").otherwise("error").alias("status"))


@query("failed_files", "SELECT o_custkey AS batch, o_orderkey::VARCHAR AS filename FROM orders WHERE o_orderstatus = 'F'")
def failed_files(spark, sf):
    return dt.failed_files(_results(spark, sf), ["batch"])


@query("scale_lookup", "SELECT p_name || '.jpg' AS image_name, p_partkey, s_acctbal AS real_width_m FROM part JOIN supplier ON s_suppkey = p_partkey % 300")
def scale_lookup(spark, sf):
    img = table(spark, sf, "part").select((F.col("p_partkey") % 300).alias("image_name"), "p_partkey", F.concat("p_name", F.lit(".jpg")).alias("n"))
    sc = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_name"), F.col("s_acctbal").alias("real_width_m"))
    return dt.scale_lookup(img, sc).select(F.col("n").alias("image_name"), "p_partkey", "real_width_m")


def _contours(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey", F.lit(".jpg")).alias("image_name"), F.col("o_orderkey").alias("contour_id"), F.col("o_totalprice").alias("area_px"))
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey", F.lit(".jpg")).alias("image_name"), F.lit(1920).alias("width_px"), F.lit(1080).alias("height_px"),
        (F.col("c_custkey") % 9 + 1.0).alias("real_width_m"), F.lit(2.5).alias("real_length_m"))
    return c, o


_A = "((c_custkey % 9 + 1.0::DOUBLE) / 1920) * (2.5::DOUBLE / 1080)"


@query("area_report", f"""WITH v AS (SELECT c_custkey, o_orderkey, o_totalprice AS a FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 150000),
t AS (SELECT c_custkey, sum(a) AS a FROM v GROUP BY 1)
SELECT 'c' || c_custkey || '.jpg' AS image_name, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY a DESC, o_orderkey) AS VARCHAR) AS pothole_id, {r('a', 2)} AS area_px, {r(f'a * {_A}', 5)} AS area_m2,
  'c' || c_custkey || '_' || row_number() OVER (PARTITION BY c_custkey ORDER BY a DESC, o_orderkey) AS unique_pothole_id FROM v
UNION ALL SELECT 'c' || c.c_custkey || '.jpg', CASE WHEN a IS NULL THEN 'none' ELSE 'total' END, {r('coalesce(a, 0)', 2)}, {r(f'coalesce(a * ((c.c_custkey % 9 + 1.0::DOUBLE) / 1920) * (2.5::DOUBLE / 1080), 0)', 5)}, 'c' || c.c_custkey || CASE WHEN a IS NULL THEN '_none' ELSE '_total' END
FROM customer c LEFT JOIN t ON t.c_custkey = c.c_custkey""")
def area_report(spark, sf):
    out = dt.area_report(*_contours(spark, sf), 150000.0)
    return out.select("image_name", "pothole_id", rnd("area_px", 2).alias("area_px"), rnd("area_m2", 5).alias("area_m2"), "unique_pothole_id")


@query("largest_n", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def largest_n(spark, sf):
    return dt.largest_n(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("mask_measure", "WITH " + feeds.CELLS_SQL + """ SELECT c_custkey AS det, count(row) AS area_pixels, coalesce(max(row) - min(row), 0) AS length_pixels, coalesce(max(col) - min(col), 0) AS width_pixels
FROM customer LEFT JOIN cells ON det = c_custkey GROUP BY 1""")
def mask_measure(spark, sf):
    return dt.mask_measure(feeds.cells(spark, sf), ["det"], table(spark, sf, "customer").select(F.col("c_custkey").alias("det")))


@query("metric_measure", "WITH " + feeds.CELLS_SQL + """, m AS (SELECT det, count(*) AS a, max(row) - min(row) AS l, max(col) - min(col) AS w, CASE det % 4 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE 150.0 + det % 97 END::DOUBLE AS h FROM cells GROUP BY 1),
n AS (SELECT *, CASE WHEN h > 0 THEN round_even(a * (h / 13.7::DOUBLE * (h / 13.7::DOUBLE)), 1) END AS cm2 FROM m)
SELECT det, cm2 AS area_cm2, CASE WHEN h > 0 THEN round_even(w * (h / 13.7::DOUBLE), 1) END AS width_cm, CASE WHEN h > 0 THEN round_even(l * (h / 13.7::DOUBLE), 1) END AS length_cm,
  CASE WHEN cm2 < 500 THEN 'minor' WHEN cm2 <= 2000 THEN 'moderate' WHEN cm2 IS NOT NULL THEN 'severe' END AS severity FROM n""")
def metric_measure(spark, sf):
    m = dt.mask_measure(feeds.cells(spark, sf), ["det"])
    k = F.col("det") % 4
    h = F.when(k == 1, -1.0).when(k != 0, 150.0 + F.col("det") % 97)
    return dt.metric_measure(m, h, F.lit(13.7)).select("det", "area_cm2", "width_cm", "length_cm", "severity")


@query("area_ratio", "WITH " + feeds.CELLS_SQL + """, b AS (SELECT c_custkey AS det, c_custkey % 5 AS x, c_custkey % 3 AS y, c_custkey % 7 AS w, 8 AS h FROM customer),
q AS (SELECT b.det, b.w * b.h AS a, count(cells.det) FILTER (WHERE row >= y AND row < y + h AND col >= x AND col < x + w) AS n FROM b LEFT JOIN cells ON cells.det = b.det GROUP BY ALL),
s AS (SELECT det, CASE WHEN a > 0 THEN n::DOUBLE / a ELSE 0.0 END AS ratio FROM q)
SELECT det, round(ratio, 6) AS area_ratio, ratio > 0.09 AS review_flag FROM s WHERE ratio >= 0.03""")
def area_ratio(spark, sf):
    k = F.col("c_custkey")
    b = table(spark, sf, "customer").select(k.alias("det"), (k % 5).alias("x"), (k % 3).alias("y"), (k % 7).alias("w"), F.lit(8).alias("h"))
    return dt.area_ratio(feeds.cells(spark, sf), b, ["det"], 0.03, 0.09).select("det", F.round("area_ratio", 6).alias("area_ratio"), "review_flag")


@query("lane_scaled_area", f"""SELECT o_orderkey, {r('o_totalprice / 100 * (3500.0 / 1200) * (3500.0 / 1200) / 1e6', 6)} AS area_m2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS defect_id FROM orders WHERE o_totalprice / 100 >= 350""")
def lane_scaled_area(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100).alias("area_px"))
    out = dt.lane_scaled_area(o, 3500.0, 1200, ["o_custkey"], "o_orderkey")
    return out.select("o_orderkey", rnd("area_m2").alias("area_m2"), "defect_id")


@query("known_area_error", "WITH " + feeds.BOXES_SQL + f""" SELECT frame_id, {r('w * h / 2.0 * 0.0004')} AS area_m2, {r('abs(w * h / 2.0 * 0.0004 - 0.2)')} AS error_m2, {r('abs(w * h / 2.0 * 0.0004 - 0.2) / 0.2 * 100', 4)} AS error_pct, {r('w * 0.02')} AS aabb_w_m, {r('h * 0.02')} AS aabb_h_m FROM boxes""")
def known_area_error(spark, sf):
    d = lambda c: F.col(c).cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = feeds.boxes(spark, sf).select("frame_id", F.lit(0.2).alias("known_m2"), F.array(p(d("x"), d("y")), p(d("x") + d("w"), d("y")), p(d("x"), d("y") + d("h"))).alias("points"))
    out = dt.known_area_error(b, 0.02)
    return out.select("frame_id", *[rnd(c, 4 if c == "error_pct" else 6).alias(c) for c in ("area_m2", "error_m2", "error_pct", "aabb_w_m", "aabb_h_m")])


@query("smallest_rectangle", "WITH " + feeds.BOXES_SQL + f""" SELECT frame_id, {r('w * h * 0.0004')} AS area_m2, {r('greatest(w, h) * 0.02')} AS rect_long_m, {r('least(w, h) * 0.02')} AS rect_short_m, {r('(w * 0.6 + h * 0.8) * 0.02')} AS aabb_w_m FROM boxes""")
def smallest_rectangle(spark, sf):
    d = lambda c: F.col(c).cast("double")
    at = lambda a, b: F.struct((d("x") + a * 0.6 - b * 0.8).alias("x"), (d("y") + a * 0.8 + b * 0.6).alias("y"))
    w, h, o = d("w"), d("h"), F.lit(0.0)
    b = feeds.boxes(spark, sf).select("frame_id", F.lit(0.2).alias("known_m2"), F.array(at(o, o), at(w, o), at(w, h), at(w / 2, h), at(o, h)).alias("points"))
    return dt.known_area_error(b, 0.02).select("frame_id", *[rnd(c).alias(c) for c in ("area_m2", "rect_long_m", "rect_short_m", "aabb_w_m")])


@query("geometry_depth", f"SELECT event_id, {r('CASE WHEN value / 1000 - 0.1 > 0.001 THEN 2 * sqrt((value / 1000 - 0.1) / pi()) * 0.28 ELSE 0.0 END')} AS depth_m FROM events")
def geometry_depth(spark, sf):
    return table(spark, sf, "events").select("event_id", rnd(dt.geometry_depth(F.col("value") / 1000 - 0.1)).alias("depth_m"))


@query("union_predictions", """WITH a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS model FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY model, o_orderkey) AS defect_id FROM a""")
def union_predictions(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.where(c).select("o_custkey", "o_orderkey") for c in ("o_orderstatus = 'O'", "o_orderstatus <> 'O'"))
    return dt.union_predictions(a, b, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "defect_id")


@query("best_mask", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS mask, max(o_totalprice) AS score FROM orders GROUP BY 1")
def best_mask(spark, sf):
    c = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("mask"), F.col("o_totalprice").alias("score"))
    return dt.best_mask(c, ["o_custkey"], "mask")


@query("confident_masks", "SELECT o_orderkey AS mask FROM orders WHERE o_totalprice / 400000 >= 0.5")
def confident_masks(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mask"), (F.col("o_totalprice") / 400000).alias("score"))
    return dt.confident_masks(c).select("mask")


# Greedy suppression in SQL: a recursive walk down the ranking that keeps the list of survivors.
@query("nms", """WITH RECURSIVE b AS (SELECT o_orderkey AS det_idx, o_custkey % 64 AS frame_id, o_orderstatus AS class, CAST(o_orderkey % 37 AS INTEGER) AS x, CAST(o_orderkey % 23 AS INTEGER) AS y, 20 + CAST(o_orderkey % 5 AS INTEGER) AS w,
  16 + CAST(o_orderkey % 3 AS INTEGER) AS h, o_totalprice / 450000 AS confidence FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class ORDER BY confidence DESC, det_idx) AS rn FROM b WHERE confidence >= 0.5),
walk AS (SELECT frame_id, class, rn, [{'x': x, 'y': y, 'w': w, 'h': h}] AS kept, det_idx, confidence, true AS ok FROM k WHERE rn = 1
  UNION ALL
  SELECT frame_id, class, rn, CASE WHEN ok THEN list_append(kept, {'x': x, 'y': y, 'w': w, 'h': h}) ELSE kept END, det_idx, confidence, ok FROM (
    SELECT n.*, p.kept, len(list_filter(p.kept, lambda t: greatest(0, least(t.x + t.w, n.x + n.w) - greatest(t.x, n.x)) * greatest(0, least(t.y + t.h, n.y + n.h) - greatest(t.y, n.y))::DOUBLE
      / (t.w * t.h + n.w * n.h - greatest(0, least(t.x + t.w, n.x + n.w) - greatest(t.x, n.x)) * greatest(0, least(t.y + t.h, n.y + n.h) - greatest(t.y, n.y))) > 0.45)) = 0 AS ok
    FROM walk p JOIN k n ON n.frame_id = p.frame_id AND n.class = p.class AND n.rn = p.rn + 1))
SELECT frame_id, class, det_idx FROM walk WHERE ok""")
def nms(spark, sf):
    k = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(
        k.alias("det_idx"), (F.col("o_custkey") % 64).alias("frame_id"), F.col("o_orderstatus").alias("class"), (k % 37).cast("int").alias("x"), (k % 23).cast("int").alias("y"),
        ((k % 5) + 20).cast("int").alias("w"), ((k % 3) + 16).cast("int").alias("h"), (F.col("o_totalprice") / 450000).alias("confidence"))
    return dt.nms(b, ["frame_id"]).select("frame_id", "class", "det_idx")


# Masks ------------------------------------------------------------------------

COMP_SQL = feeds.CELLS_SQL + """, edge AS (SELECT a.det, a.row * 100 + a.col AS u, b.row * 100 + b.col AS v FROM cells a JOIN cells b ON a.det = b.det AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT det, u, v FROM edge UNION SELECT r.det, r.u, e.v FROM reach r JOIN edge e ON e.det = r.det AND e.u = r.v),
comp AS (SELECT det, u, min(v) AS c FROM reach GROUP BY 1, 2)"""


@query("connected_components", "WITH RECURSIVE " + COMP_SQL + " SELECT det, u AS node, c AS component FROM comp WHERE EXISTS (SELECT 1 FROM edge e WHERE e.det = comp.det AND e.u = comp.u AND e.v <> comp.u)")
def connected_components(spark, sf):
    from ..operators.graph import connected_components as cc
    c = feeds.cells(spark, sf).withColumn("u", F.col("row") * 100 + F.col("col"))
    around = F.array(*[F.lit(d) for d in (1, 99, 100, 101)])
    to = c.select("det", F.col("u").alias("v"))
    edges = c.select("det", "u", "col", F.explode(around).alias("d")).withColumn("v", F.col("u") + F.col("d"))
    edges = edges.where(F.abs(F.col("v") % 100 - F.col("col")) <= 1).join(to, ["det", "v"], "left_semi").select("det", "u", "v")
    return cc(edges, ["det"])


@query("largest_component", "WITH RECURSIVE " + COMP_SQL + """, s AS (SELECT det, c, count(*) AS n FROM comp GROUP BY 1, 2), best AS (SELECT det, arg_max(c, (n, -c)) AS c FROM s GROUP BY 1)
SELECT comp.det, CAST(u // 100 AS INTEGER) AS row, CAST(u % 100 AS INTEGER) AS col FROM comp JOIN best ON best.det = comp.det AND best.c = comp.c""")
def largest_component(spark, sf):
    return raster.largest_component(feeds.cells(spark, sf), ["det"])


@query("mask_rle", "WITH " + feeds.CELLS_SQL + """, p AS (SELECT det, col * 12 + row AS p FROM cells), g AS (SELECT det, p, p - row_number() OVER (PARTITION BY det ORDER BY p) AS g FROM p),
s AS (SELECT det, min(p) AS a, max(p) AS b FROM g GROUP BY det, g), z AS (SELECT *, a - coalesce(lag(b) OVER w + 1, 0) AS z, b - a + 1 AS o FROM s WINDOW w AS (PARTITION BY det ORDER BY a))
SELECT det, string_agg(z || ' ' || o, ' ' ORDER BY a) || CASE WHEN max(b) < 143 THEN ' ' || (143 - max(b)) ELSE '' END AS counts FROM z GROUP BY det""")
def mask_rle(spark, sf):
    return raster.mask_rle(feeds.cells(spark, sf), ["det"], 12, 12).select("det", F.array_join("counts", " ").alias("counts"))


DIST_SQL = """solid AS (SELECT o_custkey % 200 AS det, CAST(o_orderkey % 12 AS INTEGER) AS row, CAST((o_orderkey // 12) % 12 AS INTEGER) AS col FROM orders GROUP BY ALL),
grid AS (SELECT a.i - 1 AS row, b.i - 1 AS col FROM range(14) a(i), range(14) b(i)), dets AS (SELECT DISTINCT det FROM solid),
holes AS (SELECT d.det, g.row, g.col FROM dets d CROSS JOIN grid g WHERE NOT EXISTS (SELECT 1 FROM solid s WHERE s.det = d.det AND s.row = g.row AND s.col = g.col)),
dist AS (SELECT s.det, s.row, s.col, min(sqrt((s.row - h.row) * (s.row - h.row) + (s.col - h.col) * (s.col - h.col))) AS dist FROM solid s JOIN holes h ON h.det = s.det GROUP BY 1, 2, 3)"""


def _solid(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("det"), (k % 12).cast("int").alias("row"), (F.floor(k / 12) % 12).cast("int").alias("col")).distinct()


@query("boundary_distance", "WITH " + DIST_SQL + f" SELECT det, row, col, {r('dist')} AS dist FROM dist")
def boundary_distance(spark, sf):
    return raster.boundary_distance(_solid(spark, sf), ["det"]).withColumn("dist", rnd("dist"))


@query("crater_profile", "WITH " + DIST_SQL + f""", p AS (SELECT det, max(dist) AS peak, max(col) - min(col) AS w, max(row) - min(row) AS h, avg(pow(dist, 0.8)) AS m FROM dist GROUP BY det)
SELECT det, {r('m / pow(peak, 0.8) * 0.25')} AS mean_depth_m, {r('greatest(0.0, least(1.0, peak / (0.5 * (greatest(w + 2 * greatest(20, CAST(floor(w * 0.2) AS INTEGER)), h + 2 * greatest(20, CAST(floor(h * 0.2) AS INTEGER)))))))')} AS quality FROM p""")
def crater_profile(spark, sf):
    cells = _solid(spark, sf)
    depth = cells.groupBy("det").agg(F.lit(0.25).alias("max_depth_m"))
    return raster.crater_profile(cells, ["det"], depth).select("det", rnd("mean_depth_m").alias("mean_depth_m"), rnd("quality").alias("quality"))
