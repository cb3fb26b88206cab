"""Point clouds, plane fits and gridded top-down maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera
from ..session import cut
from .blocks import scan, series
from .joins import salted_join

MIN_INTRINSICS_DET = 1e-6
DEFAULT_RESOLUTION_M = 0.02
NOISE_DEPTH_M = 0.005
MAX_DEPTH_M = 0.4

#: Bins of one histogram.
BINS = 4096


def _hot_join(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with one row per key; hot keys are cut into pieces."""
    return salted_join(rows, small, keys, how)


def union_frames(parts: list[DataFrame]) -> DataFrame:
    """Append clouds; missing confidence is 1 and missing colour 128."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    fill = {"confidence": F.lit(1.0), "r": F.lit(128), "g": F.lit(128), "b": F.lit(128)}
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v) if c in out.columns else v)
    return out


def skip_degenerate(frames: DataFrame) -> DataFrame:
    """Drop frames whose intrinsic matrix k cannot be inverted."""
    return frames.where(camera.det(F.col("k")) >= MIN_INTRINSICS_DET)


def unproject_depth(cells: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Depth cells (row, col, depth) to camera-space x, y, z; cells without depth are dropped."""
    inv = cameras.select(*keys, camera.inverse(F.col("k")).alias("_ki"))
    joined = _hot_join(cells.where(F.col("depth") > 0), inv, keys)
    ray = camera.apply(F.col("_ki"), F.col("col").cast("double"), F.col("row").cast("double"), F.lit(1.0))
    return joined.select(*cells.columns, *[(F.col("depth") * c).alias(n) for c, n in zip(ray, "xyz")])


def to_world(points: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """X_world = R X + t with poses (keys..., rot ARRAY(9), tx, ty, tz)."""
    j = _hot_join(points, poses.select(*keys, "rot", "tx", "ty", "tz"), keys)
    moved = [c + F.col(t) for c, t in zip(camera.apply(F.col("rot"), F.col("x"), F.col("y"), F.col("z")), ("tx", "ty", "tz"))]
    return _replace_xyz(j, points.columns, moved)


def to_camera(points: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """X_cam = R^T (X - t)."""
    j = _hot_join(points, poses.select(*keys, "rot", "tx", "ty", "tz"), keys)
    back = camera.apply(
        camera.transpose(F.col("rot")), F.col("x") - F.col("tx"), F.col("y") - F.col("ty"), F.col("z") - F.col("tz")
    )
    return _replace_xyz(j, points.columns, back)


def _replace_xyz(df: DataFrame, columns: list[str], xyz: list[Column]) -> DataFrame:
    new = dict(zip("xyz", xyz))
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def filter_points(points: DataFrame, confidence: float = 0.5, lo: float = -0.5, hi: float = 0.5) -> DataFrame:
    return points.where((F.col("confidence") >= confidence) & F.col("y").between(lo, hi))


def bev_grid(points: DataFrame, resolution: float = DEFAULT_RESOLUTION_M, keys: list[str] | None = None) -> DataFrame:
    """Majority class and largest severity per ground cell.

    Ties go to the class seen first by point index. The cell index is clipped to the
    grid, which has max(1, ceil(range / resolution)) cells per axis.
    """
    keys = list(keys or [])
    scene = points if keys else points.withColumn("_scene", F.lit(0))
    by = keys or ["_scene"]
    head = bev_header(scene, resolution, by)
    placed = _hot_join(scene, head, by)
    cell = lambda v, v0, n: F.greatest(F.lit(0), F.least(F.floor((F.col(v) - F.col(v0)) / resolution), F.col(n) - 1)).cast("int")
    binned = placed.withColumn("zi", cell("z", "z_min", "h")).withColumn("xi", cell("x", "x_min", "w"))
    votes = binned.groupBy(*by, "zi", "xi", "class").agg(
        F.count(F.lit(1)).alias("_n"), F.min("idx").alias("_first"), F.max("severity").alias("_sev")
    )
    out = votes.groupBy(*by, "zi", "xi").agg(
        F.max_by("class", F.struct("_n", -F.col("_first"))).alias("class"),
        F.greatest(F.max("_sev"), F.lit(0.0)).alias("severity"),
        F.sum("_n").alias("points"),
    )
    return out if keys else out.drop("_scene")


def bev_header(points: DataFrame, resolution: float, keys: list[str]) -> DataFrame:
    """Origin and size of the grid per scene."""
    span = lambda c: (F.greatest(F.lit(1), F.ceil((F.max(c) - F.min(c)) / resolution))).cast("int")
    return points.groupBy(*keys).agg(
        F.min("x").alias("x_min"), F.min("z").alias("z_min"), span("x").alias("w"), span("z").alias("h")
    )


def _bin(v: Column, lo: Column, hi: Column, again: Column) -> Column:
    """Bin of ``v`` between ``lo`` and ``hi``, which never share one: even ones at first, then by sign and, where values differ by orders of magnitude, by their logarithm."""
    half = lambda x, y: x / 2 - y / 2  # noqa: E731  halves do not overflow
    top = F.lit(BINS - 1)
    even = F.least(F.floor(half(v, lo) / half(hi, lo) * BINS), top)
    span = F.abs(F.log(F.abs(hi)) - F.log(F.abs(lo)))
    wide = (lo * F.signum(hi) > 0) & (span > 7.0)
    log = F.least(F.floor(F.abs(F.log(F.abs(v)) - F.log(F.abs(lo))) / span * BINS), top)
    inf = float("inf")
    return (
        F.when(v == inf, BINS).when(v == -inf, -1).when(again & (lo <= 0) & (hi >= 0), F.signum(v) + 1)
        .when(wide, log).when(half(hi, lo) > 0, even).when(v == lo, 0).otherwise(1)
    )


def percentiles(points: DataFrame, keys: list[str], wanted: dict[str, list[float]]) -> DataFrame:
    """Exact interpolated percentiles of several columns per key: an array per column, in the order of its shares, and ``n``, the rows of the key.

    A histogram of the values between the smallest and the largest says in which bin each wanted rank lies; that bin alone is counted again in
    finer bins until it holds one value. Bins of all columns and keys are partial aggregates of one pass each, so no task holds a key's values; a bin's
    own smallest and largest value are the next limits, so a pass always splits it. Nulls and NaN count for nothing; a column without values has null.
    """
    names = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)])).alias("_e")
    rows = points.select(*keys, each).select(*keys, F.col("_e.c").alias("_c"), F.col("_e.v").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    by, inf = [*keys, "_c"], float("inf")
    finite = F.when(F.abs("_v") < inf, F.col("_v"))
    base = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")))
    # ranks: the two neighbours of every wanted position
    shares = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(i), F.array(*[F.lit(float(s)) for s in wanted[c]]))])
    place = lambda s: s * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.transform(shares[F.col("_c")], lambda s: F.array(F.floor(place(s)), F.ceil(place(s))))))
    open_ = base.select(*by, F.explode(ranks).alias("_rank"), F.lit(0).cast("bigint").alias("_skip"), F.lit(-inf).alias("_a"), F.lit(inf).alias("_b"), "_lo", "_hi")
    done = None
    while True:
        limits = open_.groupBy(*by).agg(F.collect_set(F.struct("_a", "_b", "_lo", "_hi")).alias("_limits"))
        met = salted_join(rows, limits, by, counts=base)
        inside = F.filter("_limits", lambda x: (x["_a"] <= F.col("_v")) & (F.col("_v") <= x["_b"]))
        met = met.select(*by, "_v", F.explode(inside).alias("_l"))
        bin_ = _bin(F.col("_v"), F.col("_l._lo"), F.col("_l._hi"), F.col("_l._a") > -inf)
        bins = met.groupBy(*by, F.col("_l._a").alias("_a"), bin_.cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*by, "_a").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_before", F.coalesce(F.sum("_m").over(w), F.lit(0)))
        asked = open_.select(*by, "_a", "_rank", "_skip")
        at = F.col("_rank") - F.col("_skip")
        found = asked.join(bins, [*by, "_a"]).where((F.col("_before") <= at) & (at < F.col("_before") + F.col("_m")))
        found = cut(found.select(*by, "_rank", (F.col("_skip") + F.col("_before")).alias("_skip"), "_lo", "_hi"))
        sure = found.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_value"))
        done = sure if done is None else done.unionByName(sure)
        open_ = found.where("_lo < _hi").select(*by, "_rank", "_skip", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), "_lo", "_hi")
        if open_.isEmpty():
            break
    values = done.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    value = lambda s: F.col("_at")[F.floor(place(s))] + (F.col("_at")[F.ceil(place(s))] - F.col("_at")[F.floor(place(s))]) * (place(s) - F.floor(place(s)))
    same = lambda s: F.col("_at")[F.floor(place(s))] == F.col("_at")[F.ceil(place(s))]  # noqa: E731  also infinite ones
    one = values.join(base.select(*by, "_n"), by).select(*by, "_n", F.transform(shares[F.col("_c")], lambda s: F.when(same(s), F.col("_at")[F.floor(place(s))]).otherwise(value(s))).alias("_p"))
    return cut(one.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_c") == i, F.col("_p"))).alias(c) for i, c in enumerate(names)]))


def exact_percentiles(points: DataFrame, keys: list[str], col: str, shares: list[float]) -> DataFrame:
    """Percentiles of one column per key, as the array ``p``."""
    return percentiles(points, keys, {col: shares}).select(*keys, F.col(col).alias("p"))


def road_candidates(points: DataFrame, keys: list[str], share: float = 0.4) -> DataFrame:
    """Points strictly below the given percentile of height."""
    at = percentiles(points, keys, {"y": [share]})
    j = salted_join(points, at.select(*keys, F.col("y")[0].alias("_p")), keys, counts=at.select(*keys, F.col("n").alias("_n")))
    return j.where(F.col("y") < F.col("_p")).select(*points.columns)


def median_center(points: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract the median of each axis."""
    mid = percentiles(points, keys, {a: [0.5] for a in "xyz"})
    middle = mid.select(*keys, *[F.col(a)[0].alias(f"_m{a}") for a in "xyz"])
    j = salted_join(points, middle, keys, counts=mid.select(*keys, F.col("n").alias("_n")))
    return _replace_xyz(j, points.columns, [F.col(a) - F.col(f"_m{a}") for a in "xyz"])


def min_max_normalize(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Scale to [0, 1] per image; flat images stay as they are."""
    span = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = _hot_join(df, span, keys)
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(col))
    return j.select(*[scaled.alias(c) if c == col else F.col(c) for c in df.columns])


def percentile_normalize(df: DataFrame, keys: list[str], depth: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """1 - clip-scaled inverse depth between two percentiles of the valid values."""
    valid = F.col(depth) > 0
    inv = df.withColumn("_inv", F.when(valid, 1.0 / F.col(depth)).otherwise(0.0))
    p = exact_percentiles(inv.where(valid), keys, "_inv", [lo, hi])
    j = _hot_join(inv, df.select(*keys).distinct().join(p, keys, "left"), keys)
    a, b = F.coalesce(F.col("p")[0], F.lit(0.0)), F.coalesce(F.col("p")[1], F.lit(1.0))
    flat = a == b
    a, b = F.when(flat, a - 1e-6).otherwise(a), F.when(flat, b + 1e-6).otherwise(b)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_inv") - a) / (b - a)))
    return j.select(*df.columns, (1.0 - unit).alias("normalized"))


def relative_depth(df: DataFrame, keys: list[str], disparity: str) -> DataFrame:
    """Inverse of disparity above its first percentile, floored at 1e-5."""
    at = percentiles(df, keys, {disparity: [0.01]})
    j = salted_join(df, at.select(*keys, F.col(disparity)[0].alias("_p")), keys, counts=at.select(*keys, F.col("n").alias("_n")))
    return j.select(*df.columns, (1.0 / F.greatest(F.col(disparity) - F.col("_p"), F.lit(1e-5))).alias("rel_depth"))


def stride_sample(points: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """Every (n // limit)-th point of groups above the limit. Plane fitting here scores all points and does not need it."""
    pos = scan(points, series(keys, order), number="_j", totals={"_n": ("count", F.lit(1))})
    step = F.when(F.col("_n") > limit, F.floor(F.col("_n") / limit)).otherwise(1)
    return pos.where(F.col("_j") % step == 0).drop("_j", "_n")


def fit_plane(points: DataFrame, keys: list[str], hypotheses: int = 100, tolerance: float = 0.05, idx: str = "idx") -> DataFrame:
    """Plane through three points with the most points nearby, per group.

    The triples are the points with the smallest md5 of their index, taken three at a
    time. Points are only scored: all planes of a group ride along as one array and
    inliers are counted per plane in one partial aggregate. The first best plane wins.
    """
    w = Window.partitionBy(*keys).orderBy(F.md5(F.col(idx).cast("string")), idx)
    seeds = points.select(*keys, idx, "x", "y", "z").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3 * hypotheses)
    triple = seeds.groupBy(*keys, F.floor((F.col("_r") - 1) / 3).cast("int").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("_r", "x", "y", "z"))).alias("t")
    ).where(F.size("t") == 3)
    p = [F.col("t")[i] for i in range(3)]
    u = [p[1][a] - p[0][a] for a in "xyz"]
    v = [p[2][a] - p[0][a] for a in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    planes = triple.select(*keys, "k", *[c.alias(f"n{i}") for i, c in enumerate(n)], size.alias("_s"), p[0].alias("p0")).where("_s >= 1e-6")
    planes = planes.select(*keys, "k", *[(F.col(f"n{i}") / F.col("_s")).alias(a) for i, a in enumerate("abc")], "p0")
    planes = planes.withColumn("d", -(F.col("a") * F.col("p0.x") + F.col("b") * F.col("p0.y") + F.col("c") * F.col("p0.z")))
    packed = planes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "c", "d"))).alias("_planes"))
    j = _hot_join(points.select(*keys, "x", "y", "z"), packed, keys)

    def near(i: int) -> Column:
        q = F.get("_planes", F.lit(i))
        gap = F.abs(q["a"] * F.col("x") + q["b"] * F.col("y") + q["c"] * F.col("z") + q["d"])
        return F.count_if(gap < tolerance).alias(f"_i{i}")

    counts = j.groupBy(*keys).agg(F.first("_planes").alias("_planes"), *[near(i) for i in range(hypotheses)])
    scored = F.arrays_zip(F.col("_planes").alias("plane"), F.array(*[f"_i{i}" for i in range(hypotheses)]).alias("inliers"))
    flat = counts.select(*keys, F.explode(scored).alias("s")).where(F.col("s.plane").isNotNull())
    best = flat.groupBy(*keys).agg(F.max_by("s", F.struct(F.col("s.inliers"), -F.col("s.plane.k"))).alias("s"))
    return best.where(F.col("s.inliers") > 0).select(
        *keys, *[F.col(f"s.plane.{c}").alias(c) for c in "abcd"], F.col("s.inliers").alias("inliers")
    )


def depth_below_plane(points: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Depth of camera points behind the road plane a x + b y + c z + d = 0, as ``fit_plane`` gives it: noise is zeroed, depth capped.

    Depth grows with z on either choice of the normal's sign. A plane along z (c = 0) has no side behind it and gives null.
    """
    j = _hot_join(points, planes.select(*keys, *[F.col(n).alias(f"_{n}") for n in "abcd"]), keys)
    length = F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b") + F.col("_c") * F.col("_c"))
    raw = F.signum("_c") * (F.col("_a") * F.col("x") + F.col("_b") * F.col("y") + F.col("_c") * F.col("z") + F.col("_d")) / length
    depth = F.when(F.col("_c") != 0, F.when(raw < NOISE_DEPTH_M, 0.0).otherwise(F.least(raw, F.lit(MAX_DEPTH_M))))
    return j.select(*points.columns, depth.alias("depth_m"))


def refit_plane(points: DataFrame, planes: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Least-squares plane in z through the points within ``tolerance`` of a fitted one, as a unit normal with c > 0.

    Sums around each group's mean are one partial aggregate each; a group whose inliers lie on a line in x and y keeps its plane.
    """
    old = planes.select(*keys, *[F.col(n).alias(f"_{n}") for n in "abcd"])
    near = _hot_join(points.select(*keys, "x", "y", "z"), old, keys).where(
        F.abs(F.col("_a") * F.col("x") + F.col("_b") * F.col("y") + F.col("_c") * F.col("z") + F.col("_d")) < tolerance
    )
    n = lambda a, b: F.covar_pop(a, b)
    fit = near.groupBy(*keys).agg(
        *[F.avg(a).alias(f"_m{a}") for a in "xyz"], n("x", "x").alias("_xx"), n("y", "y").alias("_yy"), n("x", "y").alias("_xy"), n("x", "z").alias("_xz"), n("y", "z").alias("_yz"),
    )
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    fit = fit.where(det > 1e-12 * F.col("_xx") * F.col("_yy")).withColumn("_det", det)
    fit = fit.withColumn("_u", (F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy")) / F.col("_det")).withColumn("_v", (F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy")) / F.col("_det"))
    length = F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v") + 1)
    level = F.col("_mz") - F.col("_u") * F.col("_mx") - F.col("_v") * F.col("_my")
    better = fit.select(*keys, F.struct((-F.col("_u") / length).alias("a"), (-F.col("_v") / length).alias("b"), (1 / length).alias("c"), (-level / length).alias("d")).alias("_new"))
    return planes.join(better, keys, "left").select(*keys, *[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in "abcd"])


def depth_stats(points: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """98th percentile and mean of the positive depths and their share of the mask, per detection."""
    deep = depth_below_plane(points, planes, keys)
    base = deep.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("depth_m") > 0).alias("_v"), F.avg(F.when(F.col("depth_m") > 0, F.col("depth_m"))).alias("_mean")
    )
    p = exact_percentiles(deep.where(F.col("depth_m") > 0), keys, "depth_m", [0.98])
    out = base.join(p, keys, "left")
    return out.select(
        *keys,
        F.coalesce(F.col("p")[0], F.lit(0.0)).alias("max_depth_m"),
        F.coalesce("_mean", F.lit(0.0)).alias("mean_depth_m"),
        F.when(F.col("_v") > 0, F.col("_v") / F.col("_n")).otherwise(0.0).alias("quality"),
    )


def physical_depth(
    cells: DataFrame, cameras: DataFrame, planes: DataFrame, keys: list[str], cam_h: float, area: str | None = None
) -> DataFrame:
    """Depth, surface and volume of a dent in metres, per detection, from relative depth.

    cells: keys..., row, col, depth (relative, along the ray), mask (true inside the dent). cameras: keys..., k. planes: keys..., a, b, c, d of the road in
    the same relative units, as ``refit_plane`` gives it; the scale is the one that puts the plane ``cam_h`` from the camera. Noise is zeroed and depth capped as in ``depth_below_plane``.
    A cell's surface is the patch of road plane between its ray and those of its right and lower neighbours, or its share of the known area in column ``area``
    of ``planes``, where that is positive. Returns ``max_depth_m`` (98th percentile of positive depths), ``mean_depth_m``, ``area_sqm``, ``volume_m3`` (depth times surface, summed) and ``quality`` (share of the mask with
    depth). Cells without depth or mask count for nothing; a plane through the camera gives no row.
    """
    given = F.coalesce(F.col(area), F.lit(0.0)) if area else F.lit(0.0)
    side = planes.where(F.abs("d") >= 1e-6).select(*keys, *[F.col(n).alias(f"_{n}") for n in "abcd"], given.cast("double").alias("_known"))
    side = side.join(cameras.select(*keys, camera.inverse(F.col("k")).alias("_ki")), keys)
    inside = cells.where(F.col("mask") & (F.col("depth") > 0)).select(*keys, F.col("row").cast("double").alias("_row"), F.col("col").cast("double").alias("_col"), "depth")
    size = F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b") + F.col("_c") * F.col("_c"))
    j = _hot_join(inside, side, keys).withColumn("_scale", cam_h * size / F.abs("_d"))
    ray = lambda dr, dc: camera.apply(F.col("_ki"), F.col("_col") + dc, F.col("_row") + dr, F.lit(1.0))

    def on_plane(dr: int, dc: int) -> list[Column]:
        x, y, z = ray(dr, dc)
        along = F.col("_a") * x + F.col("_b") * y + F.col("_c") * z
        t = -F.col("_d") * F.col("_scale") / F.when(F.abs(along) < 1e-6, 1e-6).otherwise(along)
        return [x * t, y * t, z * t]

    here, right, down = on_plane(0, 0), on_plane(0, 1), on_plane(1, 0)
    u, v = [b - a for a, b in zip(here, right)], [b - a for a, b in zip(here, down)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    x, y, z = (F.col("depth") * F.col("_scale") * c for c in ray(0, 0))
    raw = F.signum("_c") * (F.col("_a") * x + F.col("_b") * y + F.col("_c") * z + F.col("_d") * F.col("_scale")) / size
    deep = j.select(
        *keys, "_known", F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]).alias("_patch"),
        F.when(raw < NOISE_DEPTH_M, 0.0).otherwise(F.least(raw, F.lit(MAX_DEPTH_M))).alias("depth_m"),
    )
    deep = cut(deep)
    positive = F.col("depth_m") > 0
    sums = deep.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(positive).alias("_v"), F.avg(F.when(positive, F.col("depth_m"))).alias("_mean"), F.max("_known").alias("_known"),
        F.sum(F.when(positive, F.col("_patch"))).alias("_area"), F.sum(F.when(positive, F.col("depth_m"))).alias("_deep"), F.sum(F.when(positive, F.col("depth_m") * F.col("_patch"))).alias("_volume"),
    )
    top = percentiles(deep.where(positive), keys, {"depth_m": [0.98]})
    known = (F.col("_known") > 0) & (F.col("_v") > 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.join(top, keys, "left").select(
        *keys, zero(F.col("depth_m")[0]).alias("max_depth_m"), zero(F.col("_mean")).alias("mean_depth_m"),
        F.when(known, F.col("_known")).otherwise(zero(F.col("_area"))).alias("area_sqm"),
        F.when(known, F.col("_known") * F.col("_deep") / F.col("_v")).otherwise(zero(F.col("_volume"))).alias("volume_m3"),
        (F.col("_v") / F.col("_n")).alias("quality"),
    )


def plane_depth(points: DataFrame, planes: DataFrame, keys: list[str], cam_h: float, deep_m: float = 0.05) -> DataFrame:
    """Scale a cloud so that its road plane lies cam_h below the origin and flag points below it."""
    up = F.when(F.col("b") < 0, -1.0).otherwise(1.0)
    scale = cam_h / F.abs("d")
    p = planes.where(F.col("d") != 0).select(
        *keys, *[(F.col(c) * up).alias(f"_{c}") for c in "abc"], (F.col("d") * up * scale).alias("_d"), scale.alias("_scale")
    )
    j = _hot_join(points, p, keys)
    x, y, z = (F.col(a) * F.col("_scale") for a in "xyz")
    signed = x * F.col("_a") + y * F.col("_b") + z * F.col("_c") + F.col("_d")
    out = j.withColumn("signed_m", signed).withColumn("is_pothole", signed < -deep_m)
    return _replace_xyz(out, [*points.columns, "signed_m", "is_pothole"], [x, y, z])


def depth_faces(cells: DataFrame, keys: list[str], ratio: float = 1.5) -> DataFrame:
    """Grid triangles without a depth jump and without sky, as vertex (row, col) triples.

    Every cell looks right, down and diagonally; neighbours are found by equality, on
    tiles of cell positions rather than whole images.
    """
    at = F.struct("row", "col", "depth", F.coalesce("sky", F.lit(False)).alias("sky"))
    base = cells.select(*keys, "row", "col", at.alias("v"))
    shift = lambda dr, dc, n: base.select(*keys, (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("v").alias(n))
    sites = (
        base.select(*keys, "row", "col", F.lit("tl").alias("s"), "v")
        .unionByName(shift(0, 1, "v").withColumn("s", F.lit("tr")))
        .unionByName(shift(1, 0, "v").withColumn("s", F.lit("bl")))
        .unionByName(shift(1, 1, "v").withColumn("s", F.lit("br")))
    )
    pick = lambda n: F.max(F.when(F.col("s") == n, F.col("v"))).alias(n)
    quads = sites.groupBy(*keys, "row", "col").agg(*[pick(n) for n in ("tl", "tr", "bl", "br")])
    tri = lambda k, a, b, c: F.struct(F.lit(k).alias("k"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    faces = quads.where(F.col("tl").isNotNull() & F.col("tr").isNotNull() & F.col("bl").isNotNull() & F.col("br").isNotNull()).select(
        *keys, F.explode(F.array(tri(0, "tl", "bl", "tr"), tri(1, "tr", "bl", "br"))).alias("f")
    )
    d = [F.col(f"f.{n}.depth") for n in "abc"]
    gap = F.greatest(F.abs(d[0] - d[1]), F.abs(d[1] - d[2]), F.abs(d[2] - d[0]))
    sky = F.col("f.a.sky") | F.col("f.b.sky") | F.col("f.c.sky")
    ok = (gap / (F.least(*d) + 1e-6) < ratio) & ~sky
    corner = lambda n: F.struct(F.col(f"f.{n}.row").alias("row"), F.col(f"f.{n}.col").alias("col")).alias(n)
    return faces.where(ok).select(*keys, F.col("f.k").alias("half"), corner("a"), corner("b"), corner("c"))
