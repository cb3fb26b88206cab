"""Skew-aware joins: salted equi-joins, as-of lookups and 3-D grid neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M
from .blocks import Series, scan

ROWS_PER_TASK = 200_000
HOT_KEYS_KEPT = 100_000
MAX_SPLITS = 4_096


def tasks(df: DataFrame) -> int:
    """Tasks for work that makes much more of a row than its bytes tell, so that small shuffles are not joined into a few long tasks."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def hot_keys(counts: DataFrame, keys: list[str], n: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``per_task`` rows and the number of pieces to cut them into.

    Salting changes only where rows meet, so keeping the largest HOT_KEYS_KEPT keys
    bounds the broadcast without touching results.
    """
    return (
        counts.where(F.col(n) > per_task)
        .orderBy(F.col(n).desc())
        .limit(HOT_KEYS_KEPT)
        .select(*keys, F.least(F.ceil(F.col(n) / per_task), F.lit(MAX_SPLITS)).cast("int").alias("_splits"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    n: str = "_n",
    per_task: int = ROWS_PER_TASK,
    rows: int | None = None,
    pieces: int | None = None,
    counted: list[str] | None = None,
) -> DataFrame:
    """Equi-join whose hot left keys are cut into pieces that meet a copy of the right rows.

    ``counts`` may carry already known left row counts per key in column ``n``; ``rows``
    an already known upper bound of all left rows, under which no key can be hot. ``pieces`` fixes the number of tasks.
    ``counted`` names keys that all other keys decide: rows are counted and cut by those alone, which then are left behind.
    """
    counted = counted or keys
    if rows is not None and rows <= per_task:
        return left.join(right, keys, how)
    if counts is None:
        counts = left.groupBy(*counted).agg(F.count(F.lit(1)).alias(n))
    hot = F.broadcast(hot_keys(counts, counted, n, per_task))
    left_behind = set(counted) if set(counted) < set(keys) else set()
    payload = [c for c in left.columns]
    salt = F.when(F.col("_splits").isNull(), 0).otherwise(F.pmod(F.xxhash64(*payload), F.col("_splits")).cast("int"))
    cut_left = left.join(hot, counted, "left").select(*[c for c in payload if c not in left_behind], salt.alias("_salt"))
    cut_right = right.join(hot, counted, "left").select(
        *[c for c in right.columns if c not in left_behind], F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)).alias("_salt")
    )
    on = [*[k for k in keys if k not in left_behind], "_salt"]
    if pieces is not None:
        cut_left, cut_right = cut_left.repartition(pieces, *on), cut_right.repartition(pieces, *on)
    return cut_left.join(cut_right, on, how).drop("_salt")


def asof(
    targets: DataFrame,
    samples: DataFrame,
    keys: list[str],
    on: str,
    value: Column,
    width: float,
    tie: str | None = None,
    strict_next: bool = True,
    prev: str = "prev",
    next_: str = "next",
) -> DataFrame:
    """Previous and next ``value`` of ``samples`` around every target on a numeric clock.

    Targets and samples are merged into one series and scanned in blocks, so there is
    no range join. ``prev`` is the last sample at or before the target; ``next`` is the
    first after it, or at or after it with ``strict_next=False`` (``prev`` is then
    strictly before). ``tie`` orders samples that share a clock value.
    """
    tag_sample, tag_target = (0, 1) if strict_next else (1, 0)
    payload = F.struct(*[F.col(f"`{c}`") for c in targets.columns])
    t = targets.select(
        *keys, F.col(on).cast("double").alias("_on"), F.lit(tag_target).alias("_tag"),
        F.lit(None).cast("double").alias("_tie"), payload.alias("_row"),
    )
    p = samples.select(
        *keys, F.col(on).cast("double").alias("_on"), F.lit(tag_sample).alias("_tag"),
        (F.col(tie).cast("double") if tie else F.lit(None).cast("double")).alias("_tie"), value.alias("_val"),
    )
    merged = t.unionByName(p, allowMissingColumns=True)
    s = Series(tuple(keys), ("_on", "_tag", "_tie"), width)
    out = scan(merged, s, fills={prev: F.col("_val")}, next_fills={next_: F.col("_val")})
    return out.where(F.col("_tag") == tag_target).select("_row.*", prev, next_)


def sphere_position(lat: Column, lon: Column) -> list[Column]:
    """Earth-centred metres."""
    la, lo = F.radians(lat), F.radians(lon)
    return [a * EARTH_RADIUS_M for a in (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))]


def sphere_cells(lat: Column, lon: Column, radius: float, spread: bool) -> list[Column]:
    """Grid cells in earth-centred metres for a great-circle radius join.

    The chord never exceeds the arc, so points within ``radius`` on the ground are
    within ``radius`` in space: poles and the date line need no special care. With
    ``spread`` the result is, per axis, the sequence of cells the ball touches.
    """
    size = 3.0 * radius
    pad = radius * (1 + 1e-9) + 1e-6
    out = []
    for v in sphere_position(lat, lon):
        if spread:
            out.append(F.sequence(F.floor((v - pad) / size), F.floor((v + pad) / size)))
        else:
            out.append(F.floor(v / size))
    return out


def explode_cells(df: DataFrame, axes: list[Column], names: list[str]) -> DataFrame:
    for axis, name in zip(axes, names):
        df = df.withColumn(name, F.explode(axis))
    return df


def plane_cells(lo: list[Column], hi: list[Column], size: float) -> list[Column]:
    """Per axis, the sequence of square cells of ``size`` touched by [lo, hi]."""
    return [F.sequence(F.floor(a / size), F.floor(b / size)) for a, b in zip(lo, hi)]
