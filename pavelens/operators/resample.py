"""Resampling of keyed series at target times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import SECONDS_PER_BLOCK, series, scan
from .joins import asof


def asof_bracket(
    targets: DataFrame, samples: DataFrame, keys: list[str], on: str, cols: list[str], width: float = SECONDS_PER_BLOCK,
    tie: str | None = None,
) -> DataFrame:
    """Last sample at or before and first sample after every target, as structs prev and next."""
    value = F.struct(F.col(on).cast("double").alias(on), *cols)
    return asof(targets, samples, keys, on, value, width, tie)


def _segments(samples: DataFrame, keys: list[str], on: str, cols: list[str], width: float) -> DataFrame:
    """One row per pair of neighbouring samples: start, length, values and neighbour slopes."""
    s = series(keys, (on,), width)
    here = scan(
        samples, s, leads={"_nx": F.struct(on, *cols)}, totals={"_n": ("count", F.lit(1))}
    ).withColumn("_h", F.col(f"_nx.{on}") - F.col(on))
    slopes = F.when(
        F.col("_h") > 0,
        F.struct(F.col("_h").alias("h"), *[F.try_divide(F.col(f"_nx.{c}") - F.col(c), "_h").alias(c) for c in cols]),
    )
    slim = cut(here.select(*keys, on, *cols, "_n", slopes.alias("_m")))
    around = scan(slim, s, lags={"_ml": F.col("_m")}, leads={"_mr": F.col("_m")})
    return around.where(F.col("_m").isNotNull())


def _inner_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """Weighted harmonic mean of two slopes; zero at a local extremum."""
    w0, w1 = h1 * 2 + h0, h1 + h0 * 2
    mean = (w0 + w1) / (w0 / m0 + w1 / m1)
    return F.when((m0 * m1) <= 0, 0.0).otherwise(mean)


def _end_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """One-sided three-point slope, limited to keep the shape."""
    d = ((h0 * 2 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (
        F.when(F.signum(d) != F.signum(m0), 0.0)
        .when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > F.abs(m0) * 3), m0 * 3)
        .otherwise(d)
    )


def pchip_resample(
    samples: DataFrame, targets: DataFrame, keys: list[str], on: str, cols: list[str], width: float = SECONDS_PER_BLOCK
) -> DataFrame:
    """Monotone cubic values of ``cols`` at the target times, extrapolating the end pieces.

    Series under four samples are linear. Sample times must be strictly increasing.
    """
    seg = _segments(samples, keys, on, cols, width)
    m, ml, mr, linear = F.col("_m"), F.col("_ml"), F.col("_mr"), F.col("_n") < 4
    fields = [F.col(on).alias("t"), m["h"].alias("h")]
    for c in cols:
        start = F.when(linear, m[c]).when(ml.isNull(), _end_slope(m["h"], mr["h"], m[c], mr[c])).otherwise(
            _inner_slope(ml["h"], m["h"], ml[c], m[c])
        )
        stop = F.when(linear, m[c]).when(mr.isNull(), _end_slope(m["h"], ml["h"], m[c], ml[c])).otherwise(
            _inner_slope(m["h"], mr["h"], m[c], mr[c])
        )
        fields += [F.col(c).alias(f"y_{c}"), m[c].alias(f"m_{c}"), start.alias(f"a_{c}"), stop.alias(f"b_{c}")]
    got = _on_segment(targets, cut(seg.select(*keys, on, F.struct(*fields).alias("_seg"))), keys, on, width)
    out = []
    for c in cols:
        g = F.col("_s")
        s, h = F.col(on) - g["t"], g["h"]
        bend = (g[f"a_{c}"] + g[f"b_{c}"] - g[f"m_{c}"] * 2) / h
        poly = ((bend / h * s + ((g[f"m_{c}"] - g[f"a_{c}"]) / h - bend)) * s + g[f"a_{c}"]) * s + g[f"y_{c}"]
        out.append(poly.alias(c))
    return got.select(*targets.columns, *out)


def _on_segment(targets: DataFrame, seg: DataFrame, keys: list[str], on: str, width: float) -> DataFrame:
    """Targets with the segment they fall on; the first one before the series, the last one after."""
    got = asof(targets, seg, keys, on, F.col("_seg"), width)
    return got.withColumn("_s", F.coalesce("prev", "next"))


def linear_resample(
    samples: DataFrame, targets: DataFrame, keys: list[str], on: str, cols: list[str], edge: str = "extrapolate",
    width: float = SECONDS_PER_BLOCK,
) -> DataFrame:
    """Linear values at the target times; outside the series extrapolate or clamp."""
    if edge not in ("extrapolate", "clamp"):
        raise ValueError(edge)
    seg = _segments(samples, keys, on, cols, width)
    m = F.col("_m")
    fields = [F.col(on).alias("t"), m["h"].alias("h")]
    for c in cols:
        fields += [F.col(c).alias(f"y_{c}"), m[c].alias(f"m_{c}")]
    got = _on_segment(targets, cut(seg.select(*keys, on, F.struct(*fields).alias("_seg"))), keys, on, width)
    g = F.col("_s")
    s = F.col(on) - g["t"]
    if edge == "clamp":
        s = F.greatest(F.lit(0.0), F.least(g["h"], s))
    return got.select(*targets.columns, *[(g[f"y_{c}"] + g[f"m_{c}"] * s).alias(c) for c in cols])


def slerp_resample(
    quats: DataFrame, targets: DataFrame, keys: list[str], on: str, width: float = SECONDS_PER_BLOCK
) -> DataFrame:
    """Shortest-arc rotation at the target times from (w, x, y, z) samples, as (qx, qy, qz, qw).

    Targets outside the series take the end rotation.
    """
    cols = ["w", "x", "y", "z"]
    norm = F.sqrt(sum(F.col(c) * F.col(c) for c in cols[1:]) + F.col("w") * F.col("w"))
    unit = quats.select(*keys, on, *[(F.col(c) / norm).alias(c) for c in cols])
    got = asof_bracket(targets, unit, keys, on, cols, width)
    p = F.coalesce(F.col("prev"), F.col("next"))
    q = F.coalesce(F.col("next"), F.col("prev"))
    dot = p["w"] * q["w"] + p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    theta = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    span = q[on] - p[on]
    a = F.when(span > 0, (F.col(on) - p[on]) / span).otherwise(0.0)
    flat = theta < 1e-9
    wp = F.when(flat, 1.0 - a).otherwise(F.sin(theta * (1.0 - a)) / F.sin(theta))
    wq = F.when(flat, a).otherwise(F.sin(theta * a) / F.sin(theta)) * sign
    raw = {c: wp * p[c] + wq * q[c] for c in cols}
    return got.select(*targets.columns, *[raw[c].alias(f"q{c}") for c in ("x", "y", "z", "w")])


def nearest_by_position(
    stream: DataFrame, frames: DataFrame, keys: list[str], order: list[str], time: str, duration: str
) -> DataFrame:
    """Stream row at the same relative position as a frame in its clip.

    The index is round-half-even(clamp(t / duration) * (n - 1)). The stream's first
    order column must be numeric. Frames of clips without stream or duration get null.
    """
    s = series(keys, order)
    numbered = scan(stream, s, number="_at")
    counts = numbered.groupBy(*keys).agg((F.max("_at") + 1).alias("_n"))
    payload = F.struct(*[c for c in stream.columns if c not in keys]).alias("nearest")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(time) / F.col(duration)))
    wanted = frames.join(counts, keys, "left").withColumn(
        "_at", F.when(F.col(duration) > 0, F.bround(ratio * (F.col("_n") - 1)).cast("long"))
    )
    return wanted.join(numbered.select(*keys, "_at", payload), [*keys, "_at"], "left").drop("_at", "_n")
