"""Vehicle path operators: distance, heading, frame sampling and locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing, equirect_xy, haversine
from ..session import cut
from .blocks import BLOCK, METERS_PER_BLOCK, Series, Steps, index_rows, scan, series
from .joins import salted_join

HEADING_BASELINE_M = 6.0
LOCATION_JUMP_M = 50.0


def local_xy(df: DataFrame, s: Series, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """East/north metres from the first row of the series."""
    origin = scan(df, s, totals={"_o": ("first", F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))})
    xy = equirect_xy(F.col(lat), F.col(lon), F.col("_o.lat"), F.col("_o.lon"))
    return origin.select(*df.columns, xy["x"].alias("x"), xy["y"].alias("y"))


def arc_length(df: DataFrame, s: Series, geodesic: bool = False, out: str = "arc_m") -> DataFrame:
    """Cumulative path length over x/y metres, or over lat/lon on the sphere."""
    a, b = ("lat", "lon") if geodesic else ("x", "y")

    def between(p: Column, q: Column) -> Column:
        if geodesic:
            return haversine(p["lat"], p["lon"], q["lat"], q["lon"])
        return F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))

    return scan(df, s, steps={out: Steps(F.struct(a, b), between)})


def baseline_heading(df: DataFrame, s: Series, arc: str = "arc_m", baseline: float = HEADING_BASELINE_M) -> DataFrame:
    """Heading between the last point a baseline behind and the first one a baseline ahead.

    Falls back to the ends of the series. Rows that share an arc length share the
    answer, so only distinct lengths are looked up: a parked vehicle costs one lookup.
    """
    keys = list(s.keys)
    point = F.struct(F.col("x"), F.col("y"))
    order = F.struct(*s.order)
    stops = cut(df.groupBy(*keys, F.col(arc).alias("_arc")).agg(F.min_by(point, order).alias("_first"), F.max_by(point, order).alias("_last"), F.count(F.lit(1)).alias("_n")))
    # one series of stops and of the places a baseline ahead (before stops at the same length) and behind (after them)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("t"), F.lit(baseline).alias("d")), F.struct(F.lit(2).alias("t"), F.lit(-baseline).alias("d")))).alias("_side")
    places = stops.select(*keys, "_arc", sides).select(*keys, (F.col("_arc") + F.col("_side.d")).alias("_at"), F.col("_side.t").alias("_tag"), F.col("_arc").alias("_of"))
    merged = stops.select(*keys, F.col("_arc").alias("_at"), F.lit(1).alias("_tag"), F.struct("_first", "_last").alias("_stop")).unionByName(places, allowMissingColumns=True)
    seen = scan(merged, series(keys, ("_at", "_tag", "_of"), METERS_PER_BLOCK), fills={"_back": F.col("_stop")}, next_fills={"_next": F.col("_stop")})
    seen = seen.where("_tag <> 1")
    end = F.when(F.col("_tag") == 0, F.coalesce("_next._first", "_back._last")).otherwise(F.coalesce("_back._last", "_next._first"))
    both = seen.groupBy(*keys, F.col("_of").alias(arc)).agg(F.max(F.when(F.col("_tag") == 2, end)).alias("_a"), F.max(F.when(F.col("_tag") == 0, end)).alias("_b"))
    heading = F.pmod(F.degrees(F.atan2(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"))), F.lit(360.0))
    return salted_join(df, both.select(*keys, arc, heading.alias("heading")), [*keys, arc], counts=stops.select(*keys, F.col("_arc").alias(arc), "_n"))


def sample_by_distance(frames: DataFrame, s: Series, interval: float, time: str = "time_sec", speed: str = "speed") -> DataFrame:
    """Frames at which the integrated speed crosses a multiple of the interval; the first always.

    Speed is clamped at zero and the remainder carried over, so crossings are those of
    a running sum.
    """
    driven = Steps(F.struct(time, speed), lambda p, q: F.coalesce(F.greatest(q[speed], F.lit(0.0)) * (q[time] - p[time]), F.lit(0.0)), before="_was")
    total = scan(frames, s, steps={"driven_m": driven})
    crossed = F.floor(F.col("driven_m") / interval) > F.floor(F.col("_was") / interval)
    return total.where(F.col("_was").isNull() | crossed).drop("_was")


def sample_by_time(frames: DataFrame, s: Series, frame_no: str, step: int) -> DataFrame:
    """Every step-th frame number, renumbered from 1."""
    kept = frames.where(F.col(frame_no) % step == 0)
    return scan(kept, s, number="_k").withColumn("saved_index", F.col("_k") + 1).drop("_k")


def sample_by_rate(frames: DataFrame, s: Series, frame_no: str, interval: float) -> DataFrame:
    """For k = 0, 1, ... the first unused frame at or after int(k * interval), numbered by k.

    After row j the number taken is min over m <= j of (targets due at row m + rows
    since), capped by j + 1; that is a running minimum, not a sequential pick.
    """
    due = F.ceil((F.col(frame_no) + 1) / F.lit(float(interval)))
    rows = frames.withColumn(BLOCK, s.block())
    w = s.rows()
    here = F.row_number().over(w).cast("long") - 1
    rows = rows.withColumn("_j", here).withColumn("_lead", due - F.col("_j"))
    rows = rows.withColumn("_low", F.min("_lead").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a block's positions and its smallest lead count from its start, which borders turn into positions of the series
    before = Window.partitionBy(*s.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    borders = rows.groupBy(*s.block_keys).agg(F.count(F.lit(1)).alias("_m"), F.min("_lead").alias("_least"))
    borders = borders.withColumn("_base", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    borders = borders.withColumn("_floor", F.min(F.col("_least") - F.col("_base")).over(before)).drop("_m", "_least")
    at = F.col("_base") + F.col("_j")
    took = lambda j, low: j + F.least(F.lit(1), F.col("_floor"), low)
    was = F.when(F.col("_j") > 0, took(at - 1, F.col("_was") - F.col("_base"))).when(F.col("_floor").isNotNull(), took(at - 1, F.col("_floor"))).otherwise(0)
    joined = rows.withColumn("_was", F.lag("_low").over(w)).join(borders, s.block_keys)
    joined = joined.withColumn("extract_index", was.cast("long"))
    return joined.where(took(at, F.col("_low") - F.col("_base")) > F.col("extract_index")).select(*frames.columns, "extract_index")


def sample_n(frames: DataFrame, s: Series, n: int) -> DataFrame:
    """Every (total // n)-th frame, at most n per series."""
    pos = scan(frames, s, number="_j", totals={"_n": ("count", F.lit(1))})
    skip = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return pos.where((F.col("_j") % skip == 0) & (F.col("_j") / skip < n)).drop("_j", "_n")


def snap_to_gps(frames: DataFrame, gps: DataFrame, keys: list[str], frame_no: str, time: str, fps: float) -> DataFrame:
    """Frames whose number is the rounded frame number of a GPS time."""
    hits = gps.select(*keys, F.bround(F.col(time) * fps).cast("long").alias(frame_no)).distinct()
    return frames.join(hits, [*keys, frame_no], "left_semi")


def photo_heading(assets: DataFrame, s: Series) -> DataFrame:
    """Heading of photos from adjacent assets: central, forward or backward difference, else the previous one.

    Needs is_photo, lat, lon. A video between photos breaks the difference and the carry.
    """
    here = F.struct("is_photo", "lat", "lon")
    around = scan(assets, s, lags={"_p": here}, leads={"_n": here})
    fix = F.col("lat").isNotNull()
    prev = F.coalesce(F.col("_p.is_photo") & F.col("_p.lat").isNotNull(), F.lit(False)) & fix
    nxt = F.coalesce(F.col("_n.is_photo") & F.col("_n.lat").isNotNull(), F.lit(False)) & fix
    own = (
        F.when(prev & nxt, bearing(F.col("_p.lat"), F.col("_p.lon"), F.col("_n.lat"), F.col("_n.lon")))
        .when(nxt, bearing(F.col("lat"), F.col("lon"), F.col("_n.lat"), F.col("_n.lon")))
        .when(prev, bearing(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon")))
        .when(~F.coalesce(F.col("_p.is_photo"), F.lit(False)), 0.0)
    )
    carried = scan(around.withColumn("_own", own), s, fills={"heading": F.col("_own")})
    return carried.where("is_photo").drop("_p", "_n", "_own")


def location_segments(
    frames: DataFrame, s: Series, jump_m: float = LOCATION_JUMP_M, first_id: int = 1,
    last_lat: float | None = None, last_lon: float | None = None,
) -> DataFrame:
    """Location label that advances after a jump from the last valid fix; null fixes keep the label."""
    fix = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    seeded = F.struct(F.lit(last_lat).cast("double").alias("lat"), F.lit(last_lon).cast("double").alias("lon"))
    jump = lambda p, q: (haversine(p["lat"], p["lon"], q["lat"], q["lon"]) > jump_m).cast("int")
    total = scan(frames, s, steps={"_jumps": Steps(fix, jump, seeded if last_lat is not None else None)})
    label = F.concat(F.lit("Location "), (F.col("_jumps") + first_id).cast("string"))
    return total.withColumn("location", label).drop("_jumps")


def resume_location(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last record's fix and location number per project, to seed the next batch."""
    last = F.max_by(F.struct("lat", "lon", "location"), F.col(order))
    number = F.regexp_extract("_l.location", r"(\d+)", 1).try_cast("int")
    return (
        results.groupBy(*keys)
        .agg(last.alias("_l"))
        .select(*keys, F.col("_l.lat").alias("last_lat"), F.col("_l.lon").alias("last_lon"),
                F.coalesce(F.when(number != 0, number), F.lit(1)).alias("last_loc_id"))
    )


def distinct_locations(df: DataFrame) -> DataFrame:
    return df.select("location").distinct()


def frames_at(df: DataFrame, location: str) -> DataFrame:
    return df.where(F.col("location") == location)


def order_frames(df: DataFrame, by: list[str]) -> DataFrame:
    return df.orderBy(*by)


def position_frames(df: DataFrame, keys: list[str], by: list[str], name: str = "frame_idx") -> DataFrame:
    """Dense position by file name or any other order."""
    return index_rows(df, keys, by, name)


def extent(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bounding box of finite coordinates; groups without any are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    ok = df.where(finite("lat") & finite("lon"))
    return (
        ok.groupBy(*(keys or []))
        .agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
        .where(F.col("west").isNotNull())
    )


def trail(frames: DataFrame, keys: list[str], order: str, part: int = 100_000) -> DataFrame:
    """Ordered LineString coordinates per project, in parts of consecutive positions.

    ``order`` is a numeric position. Each part repeats the first point of the next one,
    so drawn parts join up. Projects with one point have no trail.
    """
    s = series(keys, order)
    fixes = frames.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    pos = scan(fixes, s, number="_at", totals={"_n": ("count", F.lit(1))}).where(F.col("_n") > 1)
    own = F.floor(F.col("_at") / part)
    parts = F.when((F.col("_at") % part == 0) & (F.col("_at") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    spread = pos.withColumn("part", F.explode(parts))
    coords = F.array_sort(F.collect_list(F.struct("_at", "lon", "lat")))
    return spread.groupBy(*keys, "part").agg(
        F.transform(coords, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")
    ).where(F.size("coordinates") > 1)
