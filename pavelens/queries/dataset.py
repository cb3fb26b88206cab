"""Split, label and run-log queries."""

from pyspark.sql import functions as F

from ..operators import dataset as ds
from . import feeds
from .registry import query, r, rnd, table

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


# Largest remainder by hand: floors, then the biggest rests first.
@query("split_counts", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT * FROM (VALUES ('test', 0.1::DOUBLE), ('train', 0.8::DOUBLE), ('val', 0.1::DOUBLE)) t(split, share)),
f AS (SELECT lang, n, split, floor(n * share) AS k, n * share - floor(n * share) AS rest FROM n CROSS JOIN s), g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rest DESC, split) AS q, sum(k) OVER (PARTITION BY lang) AS t FROM f)
SELECT lang, split, CAST(k + CASE WHEN q <= n - t THEN 1 ELSE 0 END AS BIGINT) AS samples FROM g""")
def split_counts(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return ds.split_counts(n, ["lang"], "n", RATIOS)


ASSIGN = """n AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
c AS (SELECT any_value(n) AS n, CAST(floor(any_value(n) * 0.8::DOUBLE) AS BIGINT) AS a, CAST(floor(any_value(n) * 0.1::DOUBLE) AS BIGINT) AS b, CAST(floor(any_value(n) * 0.1::DOUBLE) AS BIGINT) AS d FROM n),
sp AS (SELECT doc_id, i, CASE WHEN i < a + (SELECT CASE WHEN n - a - b - d > 2 THEN 1 ELSE 0 END FROM c) THEN 'train' WHEN i < a + b THEN 'val' ELSE 'test' END AS split FROM n, c)"""


@query("assign_splits", "WITH " + ASSIGN + " SELECT doc_id, i AS scene_no, 'scene_' || lpad(i::VARCHAR, 6, '0') AS scene_id, split FROM sp")
def assign_splits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return ds.assign_splits(d, ["source", "doc_id"], RATIOS).select("doc_id", "scene_no", "scene_id", "split")


@query("validate_splits", """WITH d AS (SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS e, count(*) FILTER (WHERE doc_id % 10 < 7) AS tr, count(*) FILTER (WHERE doc_id % 10 = 8) AS va, count(*) FILTER (WHERE doc_id % 10 = 9) AS te FROM documents)
SELECT n AS total, concat_ws('|', CASE WHEN e <> n THEN 'dashcam proportion ' || printf('%.3f', e::DOUBLE / n) || ' is not 1' END, CASE WHEN e <> n THEN 'drone proportion ' || printf('%.3f', (n - e)::DOUBLE / n) || ' is not 0' END,
 CASE WHEN tr::DOUBLE / n NOT BETWEEN 0.8 - 0.01 AND 0.8 + 0.01 THEN 'split train share ' || printf('%.3f', tr::DOUBLE / n) || ' is not 0.8' END, CASE WHEN va::DOUBLE / n NOT BETWEEN 0.09 AND 0.11 THEN 'split val share ' || printf('%.3f', va::DOUBLE / n) || ' is not 0.1' END,
 CASE WHEN te::DOUBLE / n NOT BETWEEN 0.09 AND 0.11 THEN 'split test share ' || printf('%.3f', te::DOUBLE / n) || ' is not 0.1' END) AS issues, false AS valid FROM d""")
def validate_splits(spark, sf):
    k = F.col("doc_id") % 10
    d = table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "dashcam").otherwise("drone").alias("view_type"), F.when(k < 7, "train").when(k == 8, "val").when(k == 9, "test").alias("split"))
    out = ds.validate_splits(d, d.count(), RATIOS)
    return out.select("total", F.array_join("issues", "|").alias("issues"), "valid")


@query("defect_types_present", "SELECT l_orderkey AS scene_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS types, count(*) AS num_defects FROM lineitem GROUP BY 1")
def defect_types_present(spark, sf):
    out = ds.defect_types_present(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.col("l_returnflag").alias("defect_type")))
    return out.select("scene_id", F.array_join("defect_types_present", ",").alias("types"), "num_defects")


@query("cycle_pairs", """WITH b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
l AS (SELECT greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb), i AS (SELECT unnest(range(n)) AS idx, na, nb FROM l)
SELECT idx, a.p_partkey AS a, b.c_custkey AS b FROM i JOIN a ON a.pos = idx % na JOIN b ON b.pos = CAST(('0x' || substr(md5('7:' || idx), 1, 12)) AS BIGINT) % nb""")
def cycle_pairs(spark, sf):
    from ..operators.blocks import index_rows
    one = lambda t, k: index_rows(table(spark, sf, t).select(k, F.lit(0).alias("g")), ["g"], [k]).select("pos", F.col(k).alias("k"))
    return ds.cycle_pairs(one("part", "p_partkey"), one("customer", "c_custkey"), 7).select("idx", F.col("a.k").alias("a"), F.col("b.k").alias("b"))


@query("label_status", "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'approved' ELSE 'pending' END AS status FROM documents d")
def label_status(spark, sf):
    return ds.label_status(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("pending_work", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(spark, sf):
    return ds.pending_work(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("reuse_depth_cache", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 AND o_orderstatus <> 'F' THEN o_totalprice END AS depth, NOT (o_orderkey % 3 <> 1 AND o_orderstatus <> 'F') AS recompute FROM orders""")
def reuse_depth_cache(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    cache = o.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_totalprice").alias("depth"), F.when(k == 0, "geometry").when(k == 1, "learned").alias("depth_method"))
    return ds.reuse_depth_cache(o.select("o_orderkey"), cache, "geometry", ["o_orderkey"]).select("o_orderkey", "depth", "recompute")


@query("node_status", """WITH n AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0), q AS (SELECT o_custkey, arg_max(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END, o_orderkey) FILTER (WHERE true) AS x, max(o_orderkey) AS k FROM orders GROUP BY 1),
res AS (SELECT o_custkey, 'Location ' || (k % 5) AS loc, CASE WHEN k % 9 = 0 THEN NULL ELSE (SELECT o_totalprice FROM orders WHERE o_orderkey = k) END AS lat FROM q)
SELECT coalesce(c_custkey, o_custkey) AS original_name, o_custkey IS NOT NULL AS processed, coalesce(loc, CASE WHEN c_custkey IS NOT NULL THEN 'none' END) AS location, coalesce(lat, CASE WHEN c_custkey IS NOT NULL THEN 1.0 END) AS lat
FROM n FULL JOIN res ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL OR lat IS NOT NULL""")
def node_status(spark, sf):
    nodes = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("original_name"), F.lit("none").alias("location"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    k = F.col("o_orderkey")
    lat = F.when(k % 9 != 0, F.col("o_totalprice"))
    res = table(spark, sf, "orders").select(F.col("o_custkey").alias("original_name"), k.alias("seq"), F.concat(F.lit("Location "), (k % 5).cast("string")).alias("location"), lat.alias("lat"), lat.alias("lon"))
    return ds.node_status(nodes, res).select("original_name", "processed", "location", "lat")


@query("run_log_stats", f"""SELECT event_id, {r('(value + value * 2 + value / 2) / 3')} AS grad_mean, {r('value * 2')} AS grad_max, {r('value / 2')} AS grad_min, {r('CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END')} AS loss_latest, event_id % 5 = 0 AND event_id % 7 <> 0 AS has_nan FROM events""")
def run_log_stats(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    first = F.when(i % 5 == 0, F.lit(float("nan"))).otherwise(v)
    log = table(spark, sf, "events").select("event_id", F.array(v, v * 2, v / 2).alias("grad_norms"), F.when(i % 7 != 0, F.array(first, v)).alias("losses"))
    out = ds.run_log_stats(log)
    return out.select("event_id", *[rnd(c).alias(c) for c in ("grad_mean", "grad_max", "grad_min", "loss_latest")], "has_nan")


@query("best_metrics", """SELECT user_id, 'loss' AS metric, min(value) AS best_value, arg_min(event_id, (value, event_id)) AS best_epoch FROM events GROUP BY 1
UNION ALL SELECT user_id, 'miou', max(value % 100), arg_min(event_id, (-(value % 100), event_id)) FROM events GROUP BY 1""")
def best_metrics(spark, sf):
    log = table(spark, sf, "events").select("user_id", F.col("event_id").alias("epoch"), F.create_map(F.lit("loss"), F.col("value"), F.lit("miou"), F.col("value") % 100).alias("metrics"))
    return ds.best_metrics(log, F.col("metric") == "loss", ["user_id"])


@query("last_n", """SELECT user_id, event_id, array_to_string(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ' ') AS last_value FROM events""")
def last_n(spark, sf):
    out = ds.last_n(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 10)
    return out.select("user_id", "event_id", F.array_join(F.transform("last_value", lambda v: v.cast("string")), " ").alias("last_value"))


@query("patience", """WITH b AS (SELECT user_id, event_id, value, row_number() OVER w AS n, min(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, max(CASE WHEN value = best AND NOT coalesce(value = pb, false) THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS hit FROM (SELECT *, lag(best) OVER (PARTITION BY user_id ORDER BY event_id) AS pb FROM b))
SELECT user_id, event_id, best AS best_loss, n - hit AS epochs_without_improvement FROM f""")
def patience(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("loss"))
    return ds.patience(log, ["user_id"], "event_id").select("user_id", "event_id", "best_loss", "epochs_without_improvement")
