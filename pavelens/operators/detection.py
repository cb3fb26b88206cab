"""Detections: filtering, suppression, measurement and batch reports."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import severity
from ..session import cut
from .blocks import scan, series
from .joins import salted_join, tasks

# Fixed values.
CLASS_LABELS = {
    0: "Crack",
    1: "Edge Damage",
    2: "Faded Line Marking",
    3: "Patch Deformation",
    4: "Ponding Water",
    5: "Pothole",
    6: "Road Debris",
    7: "Vegetation Obstruction",
}
MIN_CONTOUR_PX = 350.0
GEOMETRY_DEPTH_RATIO = 0.28
MIN_DEPTH_AREA_SQM = 0.001

# Different boxes of a group that one task goes through in order.
BOXES_IN_ORDER = 20_000


def valid_bbox(df: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """Boxes of positive size that lie inside the frame."""
    x, y, w, h = (F.col(c) for c in "xywh")
    return df.where((w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= frame_w) & (y + h <= frame_h))


def map_class(df: DataFrame, classes: dict[int, str] | None = None) -> DataFrame:
    """Class id to label; rows with unknown ids are dropped. The lookup is a handful of constants."""
    labels = F.lit(None).cast("string")
    for cid, label in (classes or CLASS_LABELS).items():
        labels = F.when(F.col("class_id") == cid, label).otherwise(labels)
    return df.withColumn("class_label", labels).where(F.col("class_label").isNotNull())


def within_road(df: DataFrame, road_width: float, road_length: float) -> DataFrame:
    return df.where(
        (F.col("x_min") >= 0) & (F.col("y_min") >= 0) & (F.col("x_max") <= road_width) & (F.col("y_max") <= road_length)
    )


def batch_summary(frames: DataFrame, defects: DataFrame, elapsed: Column | float) -> DataFrame:
    """One row: totals, counts by class and severity, seconds per frame."""
    total = frames.agg(F.count(F.lit(1)).alias("total_frames_processed"))
    by = lambda c: defects.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda name: F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)
    classes = by("class").agg(as_map("defects_by_class"), F.coalesce(F.sum("n"), F.lit(0)).alias("_classed"))
    grades = by("severity").agg(as_map("defects_by_severity"))
    unclassed = defects.where(F.col("class").isNull()).agg(F.count(F.lit(1)).alias("_none"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(total).join(one(classes), "_one").join(one(grades), "_one").join(one(unclassed), "_one")
    secs = elapsed if isinstance(elapsed, Column) else F.lit(float(elapsed))
    mean = F.when(F.col("total_frames_processed") > 0, secs / F.col("total_frames_processed")).otherwise(0.0)
    return joined.select(
        "total_frames_processed",
        (F.col("_classed") + F.col("_none")).alias("total_defects_detected"),
        "defects_by_class",
        "defects_by_severity",
        F.round(secs, 1).alias("processing_time_seconds"),
        F.round(mean, 3).alias("average_time_per_frame_seconds"),
    )


def batch_outcomes(results: DataFrame, keys: list[str]) -> DataFrame:
    """Completed and failed counts per batch."""
    ok = F.col("status") == "success"
    return results.groupBy(*keys).agg(F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"))


def failed_files(results: DataFrame, keys: list[str]) -> DataFrame:
    """Failed files, one row each, so that a bad batch never becomes one huge list."""
    return results.where(F.col("status") != "success").select(*keys, "filename")


def scale_lookup(images: DataFrame, scales: DataFrame) -> DataFrame:
    """Attach real size per image; images without scale are skipped."""
    return images.join(scales, "image_name")


def area_report(images: DataFrame, contours: DataFrame, min_area_px: float) -> DataFrame:
    """Contours ranked by area, a total row per image, and a zero row where nothing was found.

    images: image_name, width_px, height_px, real_width_m, real_length_m.
    contours: image_name, contour_id, area_px.
    """
    valid = contours.where(F.col("area_px") > min_area_px).select("image_name", "contour_id", "area_px")
    ranked = scan(
        valid.withColumn("_desc", -F.col("area_px")), series("image_name", ("_desc", "contour_id"), 1e7), number="_k"
    )
    sq_m = (F.col("real_width_m") / F.col("width_px")) * (F.col("real_length_m") / F.col("height_px"))
    size = ["width_px", "height_px"]
    known = images.select("image_name", *size, sq_m.alias("_sqm"))
    single = salted_join(ranked, known, ["image_name"]).select(
        "image_name", (F.col("_k") + 1).cast("string").alias("pothole_id"), "area_px", (F.col("area_px") * F.col("_sqm")).alias("area_m2"), *size
    )
    totals = valid.groupBy("image_name").agg(F.sum("area_px").alias("area_px"))
    per_image = known.join(totals, "image_name", "left").select(
        "image_name",
        F.when(F.col("area_px").isNull(), "none").otherwise("total").alias("pothole_id"),
        F.coalesce("area_px", F.lit(0.0)).alias("area_px"),
        F.coalesce(F.col("area_px") * F.col("_sqm"), F.lit(0.0)).alias("area_m2"),
        *size,
    )
    return single.unionByName(per_image).withColumn(
        "unique_pothole_id", F.concat_ws("_", F.regexp_replace("image_name", r"\.[^.]+$", ""), "pothole_id")
    )


def largest_n(contours: DataFrame, keys: list[str], n: int, area: str = "area_px", tie: str = "contour_id") -> DataFrame:
    """The n largest per group. The rank filter is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(F.col(area).desc(), F.col(tie))
    return contours.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mask_measure(cells: DataFrame, keys: list[str], all_masks: DataFrame | None = None) -> DataFrame:
    """Pixel area and extents per mask. Extents are max - min, without the + 1.

    Masks of ``all_masks`` without any cell come out as zeros.
    """
    out = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area_pixels"),
        (F.max("row") - F.min("row")).alias("length_pixels"),
        (F.max("col") - F.min("col")).alias("width_pixels"),
    )
    if all_masks is None:
        return out
    return all_masks.select(*keys).distinct().join(out, keys, "left").na.fill(
        0, ["area_pixels", "length_pixels", "width_pixels"]
    )


def metric_measure(df: DataFrame, cam_h_cm: Column, focal_px: Column) -> DataFrame:
    """Metric sizes at one decimal and severity; null unless both parameters are positive."""
    ok = F.coalesce((cam_h_cm > 0) & (focal_px > 0), F.lit(False))
    px = cam_h_cm / focal_px
    area = F.bround(F.col("area_pixels") * (px * px), 1)
    return (
        df.withColumn("area_cm2", F.when(ok, area))
        .withColumn("width_cm", F.when(ok, F.bround(F.col("width_pixels") * px, 1)))
        .withColumn("length_cm", F.when(ok, F.bround(F.col("length_pixels") * px, 1)))
        .withColumn("severity", severity(F.col("area_cm2")))
    )


def area_ratio(cells: DataFrame, bboxes: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Mask share of its box: too small is dropped, too large flagged for review.

    Expects masks already reduced to their largest component.
    """
    inside = (
        (F.col("row") >= F.col("y")) & (F.col("row") < F.col("y") + F.col("h"))
        & (F.col("col") >= F.col("x")) & (F.col("col") < F.col("x") + F.col("w"))
    )
    hits = salted_join(cells, bboxes, keys).where(inside).groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    area = F.col("w") * F.col("h")
    ratio = F.when(area > 0, F.coalesce("_hits", F.lit(0)) / area).otherwise(0.0)
    return (
        bboxes.join(hits, keys, "left")
        .withColumn("area_ratio", ratio)
        .drop("_hits")
        .where(F.col("area_ratio") >= lo)
        .withColumn("review_flag", F.col("area_ratio") > hi)
    )


def lane_scaled_area(df: DataFrame, lane_mm: float, out_w: int, keys: list[str], order: str, min_px: float = MIN_CONTOUR_PX) -> DataFrame:
    """Pixel area to square metres by lane width; small contours dropped, ids per frame in order."""
    px_mm = lane_mm / out_w
    kept = df.where(F.col("area_px") >= min_px).withColumn("area_m2", F.col("area_px") * (px_mm * px_mm / 1e6))
    return scan(kept, series(keys, order), number="_k").withColumn("defect_id", F.col("_k") + 1).drop("_k")


def known_area_error(df: DataFrame, gsd: float) -> DataFrame:
    """Error of a measured polygon against its surveyed area, with the sides of the smallest rectangle around it, turned (``rect_``) and axis-aligned (``aabb_``)."""
    from ..functions.geo import polygon_area, smallest_rectangle

    px = polygon_area(F.col("points"))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    side = lambda v: (F.array_max(v) - F.array_min(v)) * gsd
    area = px * (gsd * gsd)
    error = F.abs(area - F.col("known_m2"))
    return (
        df.where(F.size("points") >= 3)
        .withColumn("area_m2", area)
        .withColumn("error_m2", error)
        .withColumn("error_pct", F.try_divide(error, "known_m2") * 100.0)
        .withColumn("aabb_w_m", side(xs))
        .withColumn("aabb_h_m", side(ys))
        .withColumn("_rect", smallest_rectangle(F.col("points")))
        .withColumn("rect_long_m", F.col("_rect.long") * gsd)
        .withColumn("rect_short_m", F.col("_rect.short") * gsd)
        .drop("_rect")
    )


def geometry_depth(area_sqm: Column) -> Column:
    """Largest depth in metres of a bowl with the given surface; zero for tiny areas."""
    diameter = F.sqrt(area_sqm / 3.141592653589793) * 2
    return F.when(area_sqm > MIN_DEPTH_AREA_SQM, diameter * GEOMETRY_DEPTH_RATIO).otherwise(0.0)


def union_predictions(first: DataFrame, second: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Outputs of two models per frame, first model first, renumbered from 1."""
    both = first.withColumn("model", F.lit(0)).unionByName(second.withColumn("model", F.lit(1)))
    at = both.withColumn("_pos", F.col(order).cast("double"))
    s = series([*keys, "model"], ("_pos",))
    num = scan(at, s, number="_k")
    ahead = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_first"))
    joined = num.join(ahead, keys, "left")
    shift = F.when(F.col("model") == 1, F.coalesce("_first", F.lit(0))).otherwise(0)
    return joined.withColumn("defect_id", F.col("_k") + 1 + shift).drop("_k", "_pos", "_first")


def best_mask(candidates: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Highest score per prompt; the lowest ``tie`` wins among equals."""
    rest = [c for c in candidates.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col(tie)))
    return candidates.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def confident_masks(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    return candidates.where(F.col("score") >= threshold)


def _iou(a: str = "", b: str = "_") -> Column:
    """Overlap of the boxes in columns x, y, w, h with prefix ``a`` and those with prefix ``b``."""
    at = lambda p, c: F.col(f"{p}{c}")
    ix = F.least(at(a, "x") + at(a, "w"), at(b, "x") + at(b, "w")) - F.greatest(at(a, "x"), at(b, "x"))
    iy = F.least(at(a, "y") + at(a, "h"), at(b, "y") + at(b, "h")) - F.greatest(at(a, "y"), at(b, "y"))
    inter = F.greatest(ix, F.lit(0)) * F.greatest(iy, F.lit(0))
    union = at(a, "w") * at(a, "h") + at(b, "w") * at(b, "h") - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def _clique_cell(width: float) -> list[Column]:
    """Cell of a box in position and size; two boxes of one cell differ by an overlap distance of at most ``width``."""
    if width <= 0:
        return [F.col(c).alias(f"_c{c}") for c in "xywh"]
    k = math.sqrt(2 * (1 - width) / (2 - width))
    g = (1 - k) / (1 + k)
    out = []
    for at, side in (("x", "w"), ("y", "h")):
        size = F.floor(F.log(F.col(side)) / math.log1p(g))
        out += [size.alias(f"_c{side}"), F.floor(F.col(at) / (F.pow(F.lit(1 + g), size) * g)).alias(f"_c{at}")]
    return out


def _grid(boxes: DataFrame, levels: int, prefix: str = "") -> DataFrame:
    """Boxes in the grid of their own size (``home``) and in those of up to ``levels`` sizes above: at most four cells each.

    Of two boxes that overlap by more than 2 ** -levels, the smaller one is also in the grid of the larger one.
    """
    col = lambda c: F.col(f"{prefix}{c}")
    own, level = f"{prefix}own", f"{prefix}level"
    out = boxes.withColumn(own, F.floor(F.log2(F.greatest(col("w"), col("h")))).cast("int"))
    out = out.withColumn(level, F.explode(F.sequence(F.col(own), F.col(own) + levels)))
    size = F.pow(F.lit(2.0), F.col(level) + 1)
    cells = lambda at, side: F.explode(F.sequence(F.floor(col(at) / size), F.floor((col(at) + col(side)) / size)))
    out = out.withColumn(f"{prefix}gx", cells("x", "w")).withColumn(f"{prefix}gy", cells("y", "h"))
    return out.withColumn(f"{prefix}home", F.col(level) == F.col(own)).drop(own)


def nms(
    det: DataFrame, keys: list[str], conf: float = 0.5, iou: float = 0.45, k: int | None = None, per_class: bool = True, in_order: int = BOXES_IN_ORDER
) -> DataFrame:
    """Greedy suppression: boxes by confidence, none overlapping a better kept one by more than ``iou``; with ``k``, the k best per frame.

    Needs x, y, w, h, confidence, class and a unique det_idx per frame. Boxes without area overlap nothing and stay. Identical boxes
    are collapsed first (the best copy stands for all: they are suppressed together or by it). Groups of up to ``in_order`` different boxes
    are gone through by one task each, box by box; larger ones in rounds.

    A round keeps every open box that no better open box may overlap, and removes what those overlap, so rounds follow the longest chain of ever better
    neighbours, not the number of boxes kept. Open boxes are represented by the best one of each cell of position and size whose boxes all overlap
    by more than ``iou``: overlap distance is a metric, so a representative that overlaps a box by less than ``iou`` minus the width of a cell speaks for its cell. Representatives meet on
    grids by size and only ask whether a better one is there; no pairs are formed, and a group of any size has a bounded number of cells around a box.
    """
    by = [*keys, "class"] if per_class else list(keys)
    rank = F.struct(F.col("confidence"), -F.col("det_idx"))
    payload = [c for c in det.columns if c not in {*by, "x", "y", "w", "h"}]
    sure = det.where(F.col("confidence") >= conf)
    kept = sure if iou >= 1 else _suppress(sure, by, payload, rank, iou, in_order)
    if k is None:
        return kept.select(*det.columns)
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col("det_idx"))
    return kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(*det.columns)


def kept_in_order(x, y, w, h, confidence, det_idx, iou: float) -> np.ndarray:
    """Positions of the boxes that greedy suppression keeps."""
    unknown = np.isnan(confidence)  # ranks highest, as in Spark
    order = np.lexsort((det_idx, -np.where(unknown, 0, confidence), ~unknown))
    x, y, w, h = (c[order] for c in (x, y, w, h))
    kept = []
    while len(order):
        kept.append(order[0])
        ix = np.minimum(x[0] + w[0], x + w) - np.maximum(x[0], x)
        iy = np.minimum(y[0] + h[0], y + h) - np.maximum(y[0], y)
        inter = np.maximum(ix, 0) * np.maximum(iy, 0)
        left = ~(inter / (w[0] * h[0] + w * h - inter) > iou)
        left[0] = False
        order, x, y, w, h = (c[left] for c in (order, x, y, w, h))
    return np.array(kept, dtype=int)


def _suppress(det: DataFrame, by: list[str], payload: list[str], rank: Column, iou: float, in_order: int) -> DataFrame:
    area = (F.col("w") > 0) & (F.col("h") > 0)
    kept = det.where(~F.coalesce(area, F.lit(False)))
    best = det.where(area).groupBy(*by, "x", "y", "w", "h").agg(F.max_by(F.struct(*payload), rank).alias("_p"))
    open_ = cut(best.select(*by, "x", "y", "w", "h", "_p.*"))
    plain = functools.reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in ("x", "y", "w", "h")]) & F.col("det_idx").isNotNull()
    sizes = open_.groupBy(*by).agg(((F.count(F.lit(1)) <= in_order) & F.every(plain)).alias("_s"))
    sizes = sizes.select(F.col("_s"), *[F.col(c).alias(f"_{c}") for c in by])
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    few = open_.join(sizes.where("_s"), same, "left_semi")

    def walk(group: pa.Table) -> pa.Table:
        col = lambda c, t: group[c].to_numpy().astype(t)
        num = lambda c: col(c, np.int64 if pa.types.is_integer(group[c].type) else np.float64)
        return group.take(pa.array(kept_in_order(*[num(c) for c in "xywh"], col("confidence", np.float64), num("det_idx"), iou)))

    kept = kept.unionByName(few.repartition(tasks(det), *by).groupBy(*by).applyInArrow(walk, open_.schema).select(*kept.columns))
    open_ = cut(open_.join(sizes.where("_s"), same, "left_anti"))
    width = min(1 - iou, iou) / 2
    near = iou - width
    if near > 0:
        levels = math.floor(-math.log2(near)) + 1
    else:  # any overlap counts, whatever the sizes
        top = F.log2(F.greatest("w", "h"))
        span = open_.agg(F.min(top).alias("a"), F.max(top).alias("b")).first()
        levels = 0 if span["a"] is None else math.floor(span["b"]) - math.floor(span["a"])
    box = ["x", "y", "w", "h", "confidence", "det_idx"]
    renamed = lambda df, columns: df.select(*[F.col(c).alias(f"_{c}") for c in columns])
    alike = lambda columns: functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    meet = alike([*by, "level", "gx", "gy"]) & (F.col("home") | F.col("_home"))
    better = (F.col("_confidence") > F.col("confidence")) | ((F.col("_confidence") == F.col("confidence")) & (F.col("_det_idx") < F.col("det_idx")))
    ids = [*by, "det_idx"]

    def given(df: DataFrame, of: DataFrame, how: str) -> DataFrame:
        return df.join(renamed(of, ids), alike(ids), how)

    while not open_.isEmpty():
        cells = open_.groupBy(*by, *_clique_cell(width)).agg(F.max_by(F.struct(*box), rank).alias("_t"))
        tops = cut(cells.select(*by, "_t.*"))
        them = _grid(renamed(tops, [*by, *box]), levels, "_")
        waiting = _grid(tops, levels).join(them, meet & better & (_iou() > near - 1e-9), "left_semi").select(*ids).distinct()
        won = cut(given(tops, waiting, "left_anti"))
        over = _grid(renamed(won, [*by, *box]), levels, "_")
        hit = _grid(open_.select(*by, *box), levels).join(over, meet & (F.col("det_idx") != F.col("_det_idx")) & (_iou() > iou), "left_semi")
        kept = kept.unionByName(given(open_, won, "left_semi").select(*kept.columns))
        open_ = cut(given(open_, hit.select(*ids).unionByName(won.select(*ids)).distinct(), "left_anti"))
    return kept
