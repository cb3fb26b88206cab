"""Stitching top-down frames into one corridor canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import global_to_local
from ..session import cut
from .blocks import scan, series
from .joins import salted_join, tasks

# Fixed values.
PIXELS_PER_METER = 50.0
MARGIN_M = 10.0
MAX_CANVAS_PX = 8192
FEATHER_PX = 10.0
DARK_GRAY = 10

CELLS_PER_TASK = 500_000


def corridor_centers(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frame centres in metres about the first frame, x right and y forward of its heading."""
    s = series(keys, "frame_idx")
    base = scan(frames, s, totals={"_b": ("first", F.struct("lat", "lon", "heading"))})
    p = global_to_local(F.col("_b.lat"), F.col("_b.lon"), F.col("_b.heading"), F.col("lat"), F.col("lon"))
    return base.withColumn("dx", p["x"]).withColumn("dy", p["z"]).withColumnRenamed("_b", "base")


def canvas(frames: DataFrame, keys: list[str], max_px: int | None = MAX_CANVAS_PX) -> DataFrame:
    """Canvas header per corridor: extents with margin, scale and pixel size.

    A longer side of over ``max_px`` pixels is brought down to that by a coarser scale, which ``ppm`` tells; None keeps the scale.
    """
    c = corridor_centers(frames, keys).groupBy(*keys).agg(
        F.min("base").alias("base"),
        (F.min("dx") - MARGIN_M).alias("min_x_m"), (F.max("dx") + MARGIN_M).alias("max_x_m"),
        (F.min("dy") - MARGIN_M).alias("min_y_m"), (F.max("dy") + MARGIN_M).alias("max_y_m"),
    )
    wide, high = F.col("max_x_m") - F.col("min_x_m"), F.col("max_y_m") - F.col("min_y_m")
    full = F.greatest(F.floor(wide * PIXELS_PER_METER), F.floor(high * PIXELS_PER_METER))
    ppm = F.lit(PIXELS_PER_METER)
    if max_px is not None:
        ppm = F.when(full > max_px, PIXELS_PER_METER * (max_px / full)).otherwise(PIXELS_PER_METER)
    return c.withColumn("ppm", ppm).select(
        *keys,
        F.col("base.lat").alias("base_lat"), F.col("base.lon").alias("base_lon"), F.col("base.heading").alias("base_heading"),
        "min_x_m", "max_x_m", "min_y_m", "max_y_m", "ppm",
        F.floor(wide * F.col("ppm")).cast("int").alias("w_canvas"),
        F.floor(high * F.col("ppm")).cast("int").alias("h_canvas"),
    )


def canvas_centers(frames: DataFrame, keys: list[str], max_px: int | None = MAX_CANVAS_PX) -> DataFrame:
    """Frame centres in canvas pixels."""
    head = canvas(frames, keys, max_px).select(*keys, "min_x_m", "max_y_m", "ppm")
    return salted_join(corridor_centers(frames, keys), head, keys).select(
        *keys, "frame_idx",
        ((F.col("dx") - F.col("min_x_m")) * F.col("ppm")).alias("cx"),
        ((F.col("max_y_m") - F.col("dy")) * F.col("ppm")).alias("cy"),
    )


def _dealt(df: DataFrame, rows: int, on: list[str]) -> DataFrame:
    """``df`` in as many tasks as ``rows`` need, if these are more than usual."""
    n = -(-rows // CELLS_PER_TASK)
    return df.repartition(n, *on) if n > tasks(df) else df


def _spot_gaps(spots: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of every spot to the nearest other one; spots that are alone in their corridor are left out.

    Spots meet the neighbours of their grid cell; those that find none within a cell's width try again with cells of twice the
    width, until a cell is as wide as the corridor.
    """
    span = lambda c: F.max(c) - F.min(c)
    head = spots.groupBy(*keys).agg(F.greatest(span("cx"), span("cy")).alias("_far"), F.count(F.lit(1)).alias("_n")).where("_far > 0")
    first = F.greatest(F.col("_far") / F.col("_n"), F.col("_far") * 1e-9)
    open_ = cut(salted_join(spots.select(*keys, "cx", "cy"), head, keys, counts=head.select(*keys, "_n")).withColumn("_size", first).drop("_n"))
    every, done = open_.select(*keys, F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.col("_size").alias("_s")), None
    width = 1.0
    while True:
        at = lambda c, of, s=width: F.floor(F.col(c) / (F.col(of) * s))
        near = lambda c: F.explode(F.sequence(at(c, "_size") - 1, at(c, "_size") + 1))
        right = every.withColumn("_gx", at("_x", "_s")).withColumn("_gy", at("_y", "_s")).drop("_s")
        left, rows = open_.withColumn("_gx", near("cx")).withColumn("_gy", near("cy")), 9 * open_.count()
        met = _dealt(left, rows, [*keys, "_gx", "_gy"]).join(_dealt(right, rows, [*keys, "_gx", "_gy"]), [*keys, "_gx", "_gy"])
        gap = F.min(F.hypot(F.col("cx") - F.col("_x"), F.col("cy") - F.col("_y"))).alias("gap")
        best = met.where((F.col("cx") != F.col("_x")) | (F.col("cy") != F.col("_y"))).groupBy(*keys, "cx", "cy").agg(gap)
        now = cut(open_.join(best, [*keys, "cx", "cy"], "left"))
        sure = F.col("gap") <= F.col("_size") * width
        ended = F.coalesce(sure, F.lit(False)) | (F.col("_size") * width > F.col("_far"))
        found = now.where(ended).select(*keys, "cx", "cy", "gap")
        done = found if done is None else done.unionByName(found)
        open_ = now.where(~ended).drop("gap")
        if open_.isEmpty():
            return done
        width *= 2


def nearest_center(cells: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of a frame's cell to its own centre (``own``) and to the nearest other one (``other``), and the seam weight ``alpha``.

    The weight is clip((other - own + 10) / 20). ``other`` is null, and the weight 1, only where the corridor has no other frame.

    Frames at one spot are looked up once. First every spot finds its nearest other spot; with g that distance, no cell of a frame whose cells lie within
    r of its centre has its nearest other centre farther than g + 2 r from its own. The centres within that distance are found once per spot on a grid
    as wide as it, go with the frame's own centre, and cells meet their frame in one join; r comes from the box around a frame's cells.
    """
    ends = [F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")]
    boxes = cut(cells.groupBy(*keys, "frame_idx").agg(F.count(F.lit(1)).alias("_n"), *ends))
    spots = cut(centers.groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("_frames")))
    far = lambda c, o: F.greatest(F.abs(F.col(f"_{c}0") - F.col(o)), F.abs(F.col(f"_{c}1") - F.col(o)))
    reach = centers.join(boxes, [*keys, "frame_idx"]).groupBy(*keys, "cx", "cy").agg(F.max(F.hypot(far("x", "cx"), far("y", "cy"))).alias("_r"))
    wide = spots.join(_spot_gaps(spots, keys), [*keys, "cx", "cy"], "left").join(reach, [*keys, "cx", "cy"])
    wide = wide.withColumn("_reach", (F.when(F.col("_frames") > 1, 0.0).otherwise(F.col("gap")) + 2 * F.col("_r")) * (1 + 1e-9) + 1e-6)
    wide = cut(wide.where("_reach is not null").withColumn("_level", F.ceil(F.log2("_reach")).cast("int")))
    levels = wide.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))  # a few sizes of cells per corridor
    size = F.pow(F.lit(2.0), F.col("_level"))
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    right = spots.join(levels, keys).select(*keys, F.col("cx").alias("_x"), F.col("cy").alias("_y"), "_frames", F.explode("_levels").alias("_level"))
    own = lambda c: F.floor(F.col(c) / size)
    right = right.withColumn("_gx", own("_x")).withColumn("_gy", own("_y")).drop("_frames")
    left = wide.withColumn("_gx", near("cx")).withColumn("_gy", near("cy")).drop("gap", "_r")
    at, rows = [*keys, "_level", "_gx", "_gy"], 9 * wide.count()
    both = _dealt(left, rows, at).join(_dealt(right, rows, at), at)
    both = both.where(F.hypot(F.col("cx") - F.col("_x"), F.col("cy") - F.col("_y")) <= F.col("_reach"))
    others = both.where((F.col("_frames") > 1) | (F.col("cx") != F.col("_x")) | (F.col("cy") != F.col("_y")))
    others = others.groupBy(*keys, "cx", "cy").agg(F.collect_list(F.struct("_x", "_y")).alias("_others"))
    frames = centers.select(*keys, "frame_idx", "cx", "cy").join(others, [*keys, "cx", "cy"], "left")
    frames = frames.withColumnsRenamed({"cx": "_ox", "cy": "_oy"})
    rows = boxes.agg(F.sum("_n")).first()[0] or 0
    met = salted_join(cells, frames, [*keys, "frame_idx"], counts=boxes.select(*keys, "frame_idx", "_n"), pieces=max(tasks(spots), -(-rows // CELLS_PER_TASK)))
    met = met.withColumn("own", F.hypot(F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy")))
    other = F.array_min(F.transform("_others", lambda c: F.hypot(F.col("x") - c["_x"], F.col("y") - c["_y"])))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("other") - F.col("own") + FEATHER_PX) / (2 * FEATHER_PX)))
    return met.withColumn("other", other).withColumn("alpha", F.coalesce(weight, F.lit(1.0))).select(*cells.columns, "own", "other", "alpha")


def composite_corridor(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Canvas colour per cell: the latest frame that covers it wins.

    Near-black cells are road-free corners and never count; cells outside their seam
    are dropped and those on it dimmed.
    """
    gray = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    used = cells.where((F.bround(gray) > DARK_GRAY) & (F.col("alpha") > 0))
    dim = lambda c: F.when(F.col("alpha") < 1.0, F.floor(F.col(c) * F.col("alpha"))).otherwise(F.col(c)).cast("int").alias(c)
    colour = F.struct("frame_idx", dim("r"), dim("g"), dim("b"))
    last = F.max(F.when(F.col("frame_idx").isNotNull(), colour)).alias("_v")
    return used.groupBy(*keys, "x", "y").agg(last).select(*keys, "x", "y", *[F.col(f"_v.{c}") for c in ("r", "g", "b", "frame_idx")])
