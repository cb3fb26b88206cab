"""Source and sink round trips over files written from the given tables."""

import uuid

from pyspark.sql import functions as F

from ..functions.geo import close_ring
from ..session import shared_dir
from ..sources import readers, sinks
from . import feeds
from .manifest import MANIFEST_SQL, manifest
from .registry import query, r, rnd, table


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("read_manifest", "WITH " + MANIFEST_SQL + " SELECT frame_id, image_path, latitude, camera_height_m, pitch, yaw, '' AS status FROM v")
def read_manifest(spark, sf):
    path = _path(spark, "manifest")
    text = manifest(spark, sf)
    cols = [F.col(c) if c in text.columns else F.lit("").alias(c) for c in readers.schemas.MANIFEST_FIELDS]
    text.select(*cols).write.csv(path, header=True, emptyValue="")
    return readers.read_manifest(spark, path).select("frame_id", "image_path", "latitude", "camera_height_m", "pitch", "yaw", "status")


@query("read_stream_csv", "WITH " + feeds.FRAMES_SQL + f""" SELECT 'clip' || (frame_idx % 4) AS session_id, 'GPS5' AS stream, {r('lat', 8)} AS d0, {r('lon', 8)} AS d1, speed AS d3, 5::BIGINT AS n FROM frames
  UNION ALL SELECT 'clip' || (frame_idx % 4), 'ISOG', {r('value')}, NULL, NULL, 1 FROM frames""")
def read_stream_csv(spark, sf):
    root = _path(spark, "streams")
    f = feeds.frames(spark, sf)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(root)
    fs = target.getFileSystem(conf)
    for k in range(4):
        part = f.where(F.col("frame_idx") % 4 == k).orderBy("frame_idx")
        for stream, cols in (("GPS5", [F.col("lat"), F.col("lon"), F.lit(10.0), F.col("speed"), F.col("speed")]), ("ISOG", [F.col("value")])):
            out = f"{root}/_parts/{k}{stream}"
            part.select(*[c.alias(str(i)) for i, c in enumerate(cols)]).coalesce(1).write.csv(out, header=True)
            written = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(out)) if s.getPath().getName().startswith("part-")]
            fs.rename(written[0], jvm.org.apache.hadoop.fs.Path(f"{root}/clip{k}_{stream}.csv"))
    df = readers.read_stream_csv(spark, f"{root}/*.csv")
    at = lambda i: F.get("data", F.lit(i))
    return df.select("session_id", "stream", rnd(at(0), 8).alias("d0"), rnd(at(1), 8).alias("d1"), at(3).alias("d3"), F.size("data").cast("long").alias("n")).withColumn(
        "d0", F.when(F.col("stream") == "ISOG", F.round(F.col("d0"), 6)).otherwise(F.col("d0")))


def _documents(spark, sf):
    """One nested frame document per order with its lines as detections."""
    c = F.col
    det = F.struct(
        c("l_returnflag").alias("class_name"), (1 - c("l_discount")).alias("conf"), c("l_quantity").alias("area_sqm"), (c("l_linenumber") == 1).alias("hidden"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_partkey", det.alias("d")))).alias("l"))
    orders = table(spark, sf, "orders").join(lines, c("l_orderkey") == c("o_orderkey"))
    views = F.create_map(F.lit("front"), F.struct(F.transform("l", lambda x: x["d"]).alias("detections")))
    return orders.select(
        c("o_orderkey").cast("string").alias("filename"), F.struct(c("o_totalprice").alias("lat"), c("o_custkey").cast("double").alias("heading")).alias("telemetry"),
        views.alias("view_meta"), c("o_orderstatus").alias("original_name"))


@query("read_process_meta", """SELECT o_orderkey AS k, o_totalprice AS lat, o_custkey::DOUBLE AS heading, o_orderstatus AS original_name, count(*) AS dets
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def read_process_meta(spark, sf):
    path = _path(spark, "meta")
    _documents(spark, sf).write.json(path)
    df = readers.read_process_meta(spark, path, one_per_file=False)
    return df.select(
        F.col("filename").cast("long").alias("k"), F.col("telemetry.lat").alias("lat"), F.col("telemetry.heading").alias("heading"), "original_name",
        F.size(F.col("view_meta")["front"]["detections"]).cast("long").alias("dets"))


@query("attach_process_meta", """SELECT o_orderkey AS k, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN o_totalprice END AS lat FROM orders""")
def attach_process_meta(spark, sf):
    frames = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("filename"))
    out = readers.attach_process_meta(frames, _documents(spark, sf))
    return out.select(F.col("filename").cast("long").alias("k"), F.col("telemetry.lat").alias("lat"))


@query("flatten_frame_results", """SELECT o_orderkey AS k, 'front' AS view, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice, l_partkey, l_returnflag, 1 - l_discount, l_quantity, l_linenumber = 1) - 1 AS det_idx,
  l_returnflag AS class_name, l_quantity AS area_sqm FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def flatten_frame_results(spark, sf):
    out = readers.flatten_frame_results(_documents(spark, sf))
    return out.select(F.col("filename").cast("long").alias("k"), "view", F.col("det_idx").cast("long").alias("det_idx"), "class_name", "area_sqm")


@query("read_dataset_manifest", "SELECT doc_id::VARCHAR AS scene_id, lang AS view_type, n_chars AS num_defects FROM documents WHERE doc_id % 10 = 8")
def read_dataset_manifest(spark, sf):
    path = _path(spark, "dataset")
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    sample = F.struct(F.col("doc_id").cast("string").alias("scene_id"), split.alias("split"), F.col("lang").alias("view_type"), F.col("n_chars").alias("num_defects"))
    docs = table(spark, sf, "documents").groupBy((F.col("doc_id") % 64).alias("shard")).agg(F.collect_list(sample).alias("samples"))
    docs.select(F.lit("/data").alias("root"), "samples").repartition("samples").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_dataset_manifest(spark, path, "val").select("scene_id", "view_type", "num_defects")


@query("portable_path", """SELECT page_id, '/mnt/set/' || array_to_string(list_slice(p, greatest(len(p) - 3, 1), len(p)), '/') AS path FROM (
  SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)""")
def portable_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", readers.portable_path(F.col("url"), "/mnt/set/").alias("path"))


def _polygons(spark, sf):
    c = F.col
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (c(n).cast("double") / 1000 for n in "xywh")
    b = feeds.boxes(spark, sf).where("h > 5").withColumn("line_no", F.xxhash64("x", "y", "w", "h", "price"))
    return b.select(
        F.concat(F.lit("img"), c("frame_id") % 20).alias("image"), "line_no", F.ascii("class").alias("class_id"),
        F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)).alias("points"))


LINE = "printf('%d %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', ascii(class), x / 1000.0::DOUBLE, y / 1000.0::DOUBLE, x / 1000.0::DOUBLE + w / 1000.0::DOUBLE, y / 1000.0::DOUBLE, x / 1000.0::DOUBLE + w / 1000.0::DOUBLE, y / 1000.0::DOUBLE + h / 1000.0::DOUBLE, x / 1000.0::DOUBLE, y / 1000.0::DOUBLE + h / 1000.0::DOUBLE)"


@query("write_labels", "WITH " + feeds.BOXES_SQL + f" SELECT 'img' || (frame_id % 20) AS image, {LINE} AS line FROM boxes WHERE h > 5")
def write_labels(spark, sf):
    path = _path(spark, "labels")
    sinks.write_labels(_polygons(spark, sf), path)
    return spark.read.text(path).select("image", F.col("value").alias("line"))


@query("read_labels", "WITH " + feeds.BOXES_SQL + f" SELECT ascii(class) AS class_id, {r('x / 1000.0::DOUBLE')} AS x0, {r('y / 1000.0::DOUBLE + h / 1000.0::DOUBLE')} AS y3, 4::BIGINT AS n FROM boxes WHERE h > 5")
def read_labels(spark, sf):
    path = _path(spark, "labels")
    sinks.write_labels(_polygons(spark, sf), path)
    out = readers.read_labels(spark, f"{path}/*/*.txt")
    return out.select("class_id", rnd(F.col("points")[0]["x"]).alias("x0"), rnd(F.col("points")[3]["y"]).alias("y3"), F.size("points").cast("long").alias("n"))


@query("read_run_log", "SELECT event_type AS type, event_id AS step, user_id AS epoch, value AS loss FROM events")
def read_run_log(spark, sf):
    path = _path(spark, "log")
    table(spark, sf, "events").select(
        F.col("event_type").alias("type"), F.col("event_id").alias("step"), F.col("user_id").alias("epoch"),
        F.create_map(F.lit("loss"), F.col("value")).alias("metrics")).write.json(path)
    return readers.read_run_log(spark, path).select("type", "step", "epoch", F.col("metrics")["loss"].alias("loss"))


@query("write_frame_json", """SELECT o_orderkey AS frame_id, count(l_orderkey) AS defects, coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def write_frame_json(spark, sf):
    path = _path(spark, "frames")
    frames = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderstatus").alias("source_file"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("det_idx"), F.col("l_returnflag").alias("class"), F.col("l_quantity").alias("area"))
    sinks.write_frame_json(frames, lines, path)
    schema = "frame_id long, source_file string, part int, defects array<struct<det_idx:int,class:string,area:double>>"
    total = F.aggregate("defects", F.lit(0).cast("long"), lambda s, d: s + d["area"].cast("long"))
    return spark.read.schema(schema).json(path).select("frame_id", F.size("defects").cast("long").alias("defects"), total.alias("total"))


@query("to_feature_collection", """WITH f AS (SELECT s_nationkey, s_suppkey, '{"type":"Feature","properties":{"name":"' || s_name || '"},"geometry":{"type":"Point","coordinates":[' || s_suppkey || ',' || s_nationkey || ']}}' AS j FROM supplier)
SELECT s_nationkey, count(*) AS features, '{"type":"FeatureCollection","features":[' || string_agg(j, ',' ORDER BY s_suppkey) || ']}' AS collection FROM f GROUP BY 1""")
def to_feature_collection(spark, sf):
    s = table(spark, sf, "supplier")
    point = sinks.feature("Point", F.array(F.col("s_suppkey"), F.col("s_nationkey").cast("long")), F.struct(F.col("s_name").alias("name")))
    return sinks.to_feature_collection(s.withColumn("feature", point), ["s_nationkey"], ["s_suppkey"])


@query("ply_vertices", "WITH " + feeds.POINTS_SQL + f" SELECT {r('x::FLOAT::DOUBLE', 4)} AS x, {r('y::FLOAT::DOUBLE', 4)} AS y, {r('z::FLOAT::DOUBLE', 4)} AS z, CAST(128 AS SMALLINT) AS red, class AS class_id, {r('severity::FLOAT::DOUBLE', 4)} AS severity FROM points")
def ply_vertices(spark, sf):
    p = feeds.points(spark, sf)
    for ch in "rgb":
        p = p.withColumn(ch, F.lit(128))
    v = sinks.ply_vertices(p)
    return v.select(*[rnd(F.col(a).cast("double"), 4).alias(a) for a in ("x", "y", "z", "severity")], "red", "class_id")


# Listing shows the survey files of a written folder: count and kinds follow from the tables.
@query("list_media", "SELECT CASE WHEN r_regionkey % 3 = 0 THEN 'image' WHEN r_regionkey % 3 = 1 THEN 'video' ELSE 'unsupported' END AS kind, count(*) AS files FROM region GROUP BY 1")
def list_media(spark, sf):
    root = _path(spark, "media")
    ext = F.element_at(F.array(F.lit("JPG"), F.lit("mp4"), F.lit("txt")), (F.col("r_regionkey") % 3 + 1).cast("int"))
    t = table(spark, sf, "region").select(F.col("r_name").alias("value"), F.concat(F.lit("f"), "r_regionkey", F.lit("."), ext).alias("name"))
    t.write.partitionBy("name").text(root)
    # partition folders carry the media names; each holds one file
    seen = readers.list_media(spark, root).select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("name"))
    return seen.groupBy(readers.media_kind(F.col("name")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query("media_kind", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'video' WHEN 4 THEN 'video' ELSE 'unsupported' END AS kind FROM events""")
def media_kind(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in ("jpg", "JPEG", "png", "MP4", "mov", "gif")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", readers.media_kind(F.concat(F.lit("a.b/c_"), "event_id", F.lit("."), ext)).alias("kind"))


@query("select_export_files", """WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fr' || event_id || '.jpg' WHEN 1 THEN 'raw_fr' || event_id || '_front.png' WHEN 2 THEN 'xfr' || event_id || '.jpg' ELSE 'meta_fr' || event_id || '9.json' END AS name FROM events),
s AS (SELECT 'fr' || event_id AS stem FROM events WHERE event_type = 'click')
SELECT DISTINCT f.event_id, f.name FROM f JOIN s ON s.stem = regexp_extract(f.name, '(^|_)(fr[0-9]+)(\\.|$|_)', 2)""")
def select_export_files(spark, sf):
    i = F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    name = (F.when(k == 0, F.concat(F.lit("fr"), i, F.lit(".jpg"))).when(k == 1, F.concat(F.lit("raw_fr"), i, F.lit("_front.png")))
            .when(k == 2, F.concat(F.lit("xfr"), i, F.lit(".jpg"))).otherwise(F.concat(F.lit("meta_fr"), i, F.lit("9.json"))))
    ev = table(spark, sf, "events")
    stems = ev.where("event_type = 'click'").select(F.concat(F.lit("fr"), i).alias("stem"))
    return sinks.select_export_files(ev.select("event_id", name.alias("name")), stems)


@query("export_layout", """WITH a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'my clip (Frame ' || event_id || ')' WHEN event_id % 3 = 1 THEN 'img ' || event_id || '.PNG' ELSE 'pic' || event_id || '.jpeg' END AS n,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Location ' || (event_id % 5) END AS loc, CASE WHEN event_id % 2 = 0 THEN 'front' ELSE 'rear' END AS v FROM events),
b AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'my_clip_Frame_' || event_id WHEN event_id % 3 = 1 THEN 'img_' || event_id ELSE 'pic' || event_id END AS base, CASE WHEN event_id % 3 = 0 THEN '.jpg' WHEN event_id % 3 = 1 THEN '.PNG' ELSE '.jpeg' END AS ext FROM a)
SELECT event_id, coalesce(loc, 'Unknown Location') || '/' || v || '/RAW_' || base || ext AS image_target, coalesce(loc, 'Unknown Location') || '/' || v || '/RAW_' || base || '.json' AS meta_target FROM b""")
def export_layout(spark, sf):
    i = F.col("event_id")
    s = i.cast("string")
    name = F.when(i % 3 == 0, F.concat(F.lit("my clip (Frame "), s, F.lit(")"))).when(i % 3 == 1, F.concat(F.lit("img "), s, F.lit(".PNG"))).otherwise(F.concat(F.lit("pic"), s, F.lit(".jpeg")))
    ev = table(spark, sf, "events").select(
        "event_id", name.alias("original_name"), F.when(i % 4 != 0, F.concat(F.lit("Location "), (i % 5).cast("string"))).alias("location"),
        F.when(i % 2 == 0, "front").otherwise("rear").alias("view"))
    return sinks.export_layout(ev, "RAW").select("event_id", "image_target", "meta_target")


@query("retention_report", """SELECT count(*) FILTER (WHERE NOT event_id * 100 > 86400 * 9 - 86400 * 2) AS deleted, count(*) FILTER (WHERE event_id * 100 > 86400 * 9 - 86400 * 2) AS kept,
  CAST(sum(CASE WHEN NOT event_id * 100 > 86400 * 9 - 86400 * 2 THEN user_id ELSE 0 END) AS BIGINT) AS bytes FROM events""")
def retention_report(spark, sf):
    files = table(spark, sf, "events").select((F.col("event_id") * 100).cast("double").alias("mtime"), F.col("user_id").alias("bytes"))
    return sinks.retention_report(files, F.lit(86400.0 * 9), 2)


@query("upsert_detections", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN true END AS hidden FROM orders""")
def upsert_detections(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    up = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("status"), F.lit(True).alias("hidden"))
    return sinks.upsert_detections(o, up, ["o_orderkey"])
