"""Telemetry samples: timing, scaling, fix selection, outliers and health scores.

Samples are rows (session_id, stream, seq, time_sec, data ARRAY<DOUBLE>); ``seq`` is
the stored order and unique per (session_id, stream).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_RADIUS_M, haversine
from ..session import cut
from .blocks import BLOCK, NO_BLOCK, SECONDS_PER_BLOCK, Series, scan, series
from .joins import tasks

# Fixed values.
DEFAULT_GPS_HZ = 18.0
MAX_DOP = 5.0
MIN_FIX = 2.0
MOVING_MS = 1.0

# Rows that one call of the outlier rule is given, but for what one block of the clock holds.
ROWS_PER_FOLD = 50_000

# Warning texts of the health report.
SPEED_WARNING = "Kinematic Anomaly: GPS coordinate jumped violently (Speed delta: %.1f m/s)."
GPS_WARNING = "GPS Quality Degraded (Score: %.1f%%). High spatial drift."
IMU_WARNING = "IMU Calibration/Vibration Issue (Score: %.1f%%). Gravity vector unstable."


def payload_timeline(payloads: DataFrame) -> DataFrame:
    """Samples of a payload spread evenly over its duration."""
    n = F.size("values")
    return payloads.select(
        "session_id", "stream", "t_start", "t_dur", n.alias("_n"), F.posexplode("values").alias("i", "data")
    ).select(
        "session_id",
        "stream",
        (F.col("t_start") + F.col("i") / F.col("_n") * F.col("t_dur")).alias("time_sec"),
        "i",
        "data",
    )


def apply_scale(values: Column, scale: Column) -> Column:
    """Divide by the scale at the same position; zero or absent falls back to the last scale, then 1."""
    last = F.try_element_at(scale, F.lit(-1))
    fallback = F.when(last != 0, last).otherwise(1.0)
    return F.transform(values, lambda v, i: v / F.coalesce(F.when(F.get(scale, i) != 0, F.get(scale, i)), fallback))


def _by_stored_order(keys=("session_id",)) -> Series:
    return series(keys, ("seq",))


def select_gps(samples: DataFrame) -> DataFrame:
    """Valid fixes as (session_id, seq, time_sec, lat, lon, speed).

    A session that has GPS9 at all uses only GPS9; validity is checked afterwards.
    """
    flagged = scan(
        samples.where(F.col("stream").isin("GPS9", "GPS5")),
        series("session_id", ("seq", "stream")),
        totals={"_has9": ("max", (F.col("stream") == "GPS9").cast("int"))},
    )
    nine = (
        (F.col("stream") == "GPS9") & (F.size("data") >= 9) & (F.get("data", F.lit(8)) >= MIN_FIX)
        & (F.get("data", F.lit(7)) <= MAX_DOP)
    )
    five = (
        (F.col("_has9") == 0) & (F.size("data") >= 5) & (F.get("data", F.lit(0)) != 0.0) & (F.get("data", F.lit(1)) != 0.0)
    )
    return flagged.where(nine | five).select(
        "session_id",
        "seq",
        "time_sec",
        *[F.get("data", F.lit(i)).alias(n) for i, n in ((0, "lat"), (1, "lon"), (3, "speed"))],
    )


def _fold_outliers(max_err: float, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, last) -> np.ndarray:
    """Greedy speed check against the last kept sample.

    Where neighbours agree the check against the previous sample is the check against
    the last kept one, so only disagreeing stretches are walked row by row.
    """
    n = len(t)
    kept = np.zeros(n, dtype=bool)
    la, lo = np.radians(lat), np.radians(lon)

    def agrees(i0, i1):
        dt = t[i1] - t[i0]
        h = np.sin((la[i1] - la[i0]) / 2) ** 2 + np.cos(la[i0]) * np.cos(la[i1]) * np.sin((lo[i1] - lo[i0]) / 2) ** 2
        h = np.clip(h, 0.0, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            v = 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) / dt
        return (dt > 0) & ~((v > MOVING_MS) & (np.abs(v - speed[i1]) > max_err))

    start = 0
    if last is not None:
        t, lat, lon, speed = (np.concatenate(([x], a)) for x, a in zip((*last, 0.0), (t, lat, lon, speed)))
        la, lo = np.radians(lat), np.radians(lon)
        kept = np.zeros(n + 1, dtype=bool)
        start = 1
    size = len(t)
    idx = np.arange(size)
    bad = np.flatnonzero(~agrees(idx[:-1], idx[1:])) + 1
    i, kept[0] = 1, True
    while i < size:
        at = np.searchsorted(bad, i)
        stop = bad[at] if at < len(bad) else size
        kept[i:stop] = True
        anchor, i = stop - 1, stop
        while i < size and not agrees(anchor, i):
            i += 1
        if i < size:
            kept[i] = True
            i += 1
    return kept[start:]


def drop_speed_outliers(gps: DataFrame, max_err: float = 8.0, width: float = SECONDS_PER_BLOCK) -> DataFrame:
    """Drop fixes whose implied speed contradicts the measured one.

    Every sample is compared with the last *kept* sample. Sessions are cut into time
    blocks that are folded in parallel from a guessed last kept sample (the last
    sample of the previous block); blocks whose guess proves wrong are folded again
    until all guesses hold, so the result equals one pass in order. Sessions under
    three samples, or left with under two, are returned unchanged.
    """
    s = series("session_id", ("time_sec", "seq"), width)
    done = speed_outlier_flags(gps, max_err, s)
    counted = scan(done, s, totals={"_n": ("count", F.lit(1)), "_k": ("sum", F.col("_kept").cast("int"))})
    untouched = (F.col("_n") < 3) | (F.col("_k") < 2)
    return counted.where(F.col("_kept") | untouched).select(*gps.columns)


def _fold_blocks(rows: DataFrame, s: Series, most: int = ROWS_PER_FOLD) -> DataFrame:
    """Joins neighbouring blocks of a series that hold few rows: a new block begins every ``most`` rows and is named by its first old one.

    A session sampled seldom would else have more blocks than is worth a call, each with a guess.
    """
    w = Window.partitionBy(*s.keys).orderBy(BLOCK)
    sizes = rows.groupBy(*s.block_keys).agg(F.count(F.lit(1)).alias("_rows"))
    known = F.col(BLOCK) > NO_BLOCK  # rows without a time stay a block of their own
    sizes = sizes.withColumn("_at", F.when(known, F.floor((F.sum("_rows").over(w) - F.col("_rows")) / most)).otherwise(-1))
    named = cut(sizes.select(*s.block_keys, F.min(BLOCK).over(Window.partitionBy(*s.keys, "_at")).alias("_wide")))
    return rows.join(named, s.block_keys).withColumn(BLOCK, F.col("_wide")).select(*rows.columns)


def speed_outlier_flags(gps: DataFrame, max_err: float, s: Series, seed: DataFrame | None = None) -> DataFrame:
    """Rows with _kept. ``seed`` (session_id, t, la, lo) is the last kept fix before these rows."""
    fix = F.struct(
        F.col("time_sec").cast("double").alias("t"), F.col("lat").cast("double").alias("la"),
        F.col("lon").cast("double").alias("lo"),
    )
    w = Window.partitionBy(*s.keys).orderBy(BLOCK)
    rows = _fold_blocks(gps.withColumn(BLOCK, s.block()), s)
    guess = (
        rows.groupBy(*s.block_keys)
        .agg(F.max_by(fix, F.struct(*s.order)).alias("_tail"))
        .select(*s.block_keys, F.lag("_tail").over(w).alias("_in"))
    )
    begin = F.lit(None).cast(T.StructType([T.StructField(c, T.DoubleType()) for c in ("t", "la", "lo")]))
    seeds = None if seed is None else cut(seed.select("session_id", F.struct("t", "la", "lo").alias("_seed")))

    def seeded(df: DataFrame) -> DataFrame:
        return df.withColumn("_seed", begin) if seeds is None else df.join(seeds, "session_id", "left")

    guess = seeded(guess).select(*s.block_keys, F.coalesce("_in", "_seed").alias("_in"))
    schema = T.StructType(
        [*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("_t", "_la", "_lo")], T.StructField("_kept", T.BooleanType())]
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time_sec", "seq"], kind="stable")
        head = pdf[["_t", "_la", "_lo"]].iloc[0].to_numpy(dtype=float)
        args = [pdf[c].to_numpy(dtype=float) for c in ("time_sec", "lat", "lon", "speed")]
        return pdf.assign(_kept=_fold_outliers(max_err, *args, None if np.isnan(head[0]) else tuple(head)))

    def run(part: DataFrame, incoming: DataFrame) -> DataFrame:
        given = part.join(incoming, s.block_keys).select(
            *rows.columns, F.col("_in.t").alias("_t"), F.col("_in.la").alias("_la"), F.col("_in.lo").alias("_lo")
        )
        return given.repartition(tasks(gps), *s.block_keys).groupBy(*s.block_keys).applyInPandas(fold, schema)

    done = cut(run(rows, guess))
    while True:
        tail = F.max_by(fix, F.when(F.col("_kept"), F.struct(*s.order)))
        seen = done.groupBy(*s.block_keys).agg(tail.alias("_tail"), F.first("_t").alias("_t"))
        true_in = F.last("_tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        held = seeded(seen.select(*s.block_keys, "_t", true_in.alias("_in")))
        wrong = held.select(*s.block_keys, "_t", F.coalesce("_in", "_seed").alias("_in")).where(~F.col("_t").eqNullSafe(F.col("_in.t")))
        wrong = cut(wrong.drop("_t"))
        if wrong.isEmpty():
            break
        again = run(done.join(wrong, s.block_keys, "left_semi").select(*rows.columns), wrong)
        done = cut(done.join(wrong, s.block_keys, "left_anti").unionByName(again))
    return done.drop("_t", "_la", "_lo")


def gps_health(samples: DataFrame) -> DataFrame:
    """Speed error, fix quality and a 0-100 score per session.

    Walks samples in stored order. Steps with dt <= 0 are skipped before anything is
    counted; ratios divide by all samples of the session.
    """
    of = ["session_id", "stream"]
    gps = samples.where(F.col("stream").isin("GPS9", "GPS5"))
    sums = gps_sums(scan(gps, _by_stored_order(of), lags={"_p": F.struct("time_sec", "data")}), of)
    # both kinds of stream are summed; the fixes of GPS9 alone count where a session has it
    fields = F.struct(*[c for c in sums.columns if c not in of])
    return gps_score(sums.groupBy("session_id").agg(F.max_by(fields, F.col("stream")).alias("_s")).select("session_id", "_s.*"))


def gps_sums(step: DataFrame, keys=("session_id",)) -> DataFrame:
    """Per-session sums over samples that carry the previous sample as _p."""
    data, prev = F.col("data"), F.col("_p.data")
    dt = F.col("time_sec") - F.col("_p.time_sec")
    full9 = (F.col("stream") == "GPS9") & (F.size(data) >= 9)
    dop = F.when(full9, F.get(data, F.lit(7))).otherwise(1.0)
    fixq = F.when(full9, F.get(data, F.lit(8))).otherwise(3.0)
    at = lambda a, i: F.get(a, F.lit(i))
    derived = F.try_divide(haversine(at(prev, 0), at(prev, 1), at(data, 0), at(data, 1)), dt)
    measured = at(data, 3)
    error = F.when((measured > MOVING_MS) | (derived > MOVING_MS), F.abs(derived - measured))
    ok = dt > 0
    return step.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum(F.when(ok, error)), F.lit(0.0)).alias("err_sum"),
        F.count(F.when(ok, error)).alias("err_n"),
        F.coalesce(F.max(F.when(ok, error)), F.lit(0.0)).alias("max_err"),
        F.count_if(ok & (fixq < 3)).alias("bad_fix"),
        F.count_if(ok & (dop > 3.0)).alias("bad_dop"),
    )


def gps_score(sums: DataFrame) -> DataFrame:
    """Report columns from the per-session sums of gps_sums; the sums of parts add up."""
    n = F.col("samples")
    agg = sums.withColumn("avg_err", F.when(F.col("err_n") > 0, F.col("err_sum") / F.col("err_n")).otherwise(0.0))
    penalty = (
        F.col("avg_err") * 5 + F.col("bad_fix") / n * 40 + F.col("bad_dop") / n * 15
        + F.when(F.col("max_err") > 15.0, 15.0).otherwise(0.0)
    )
    score = F.when(n > 1, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty))).otherwise(100.0)
    return agg.select(
        "session_id",
        "samples",
        F.round("avg_err", 3).alias("avg_gps_speed_error_ms"),
        F.when(n > 1, F.round(F.col("bad_fix") / n, 3)).otherwise(0.0).alias("bad_fix_ratio"),
        F.round("max_err", 2).alias("max_speed_error"),
        F.col("max_err").alias("max_speed_error_exact"),
        score.alias("gps_score"),
    )


def grav_sums(samples: DataFrame, keys=("session_id",)) -> DataFrame:
    """Count of gravity samples and sum of the deviation of their magnitude from 1."""
    x, y, z = (F.get("data", F.lit(i)) for i in range(3))
    error = F.abs(1.0 - F.sqrt(x * x + y * y + z * z))
    found = samples.where(F.col("stream") == "GRAV").groupBy(*keys)
    return found.agg(F.sum(error).alias("grav_sum"), F.count(error).alias("grav_n"))


def imu_score(sums: DataFrame) -> DataFrame:
    """Mean deviation and a 0-100 score from ``grav_sums``; the sums of parts add up."""
    error = F.col("grav_sum") / F.col("grav_n")
    return sums.select(
        "session_id",
        F.round(error, 4).alias("avg_grav_mag_error"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - error * 200)).alias("imu_score"),
    )


def imu_health(samples: DataFrame) -> DataFrame:
    """Mean deviation of the gravity magnitude from 1 and a 0-100 score per session."""
    return imu_score(grav_sums(samples))


def health_warnings(report: DataFrame) -> DataFrame:
    """Add the list of triggered warnings to a joined health report."""
    msgs = F.array(
        F.when(
            F.col("max_speed_error_exact") > 15.0,
            F.format_string(SPEED_WARNING, F.col("max_speed_error_exact")),
        ),
        F.when(
            F.col("gps_score") < 80,
            F.format_string(GPS_WARNING, F.col("gps_score")),
        ),
        F.when(
            F.col("imu_score") < 90,
            F.format_string(IMU_WARNING, F.col("imu_score")),
        ),
    )
    return report.withColumn("warnings", F.array_compact(msgs))


def session_rate(gps: DataFrame) -> DataFrame:
    """Sample rate, mean speed and the smoothing width in samples per session."""
    span = F.max("time_sec") - F.min("time_sec")
    agg = gps.groupBy("session_id").agg(span.alias("_d"), F.count(F.lit(1)).alias("samples"), F.avg("speed").alias("mean_speed"))
    hz = F.when(F.col("_d") > 0.1, F.col("samples") / F.col("_d")).otherwise(DEFAULT_GPS_HZ)
    return agg.select("session_id", "samples", "mean_speed", hz.alias("hz")).withColumn(
        "sigma_samples", F.greatest(F.lit(1.0), 2.0 / F.greatest("mean_speed", F.lit(1.0)) * F.col("hz"))
    )


def missing_streams(sessions: DataFrame, required: list[str]) -> DataFrame:
    """Required streams a session lacks; sessions is (session_id, stream)."""
    have = sessions.groupBy("session_id").agg(F.collect_set(F.when(F.col("stream").isin(*required), F.col("stream"))).alias("_have"))
    return have.select(
        "session_id", F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), "_have")).alias("missing")
    )
