"""Streams that need order, with their state in tables.

Rows wait until the watermark has passed them and are then released in order of event time, so files that arrive out of
order across micro-batches give the result of one batch over all rows. Rows that come later still go to a table of their own. A ``Fold``
says what happens to released rows and the state of their keys; it reuses the batch operators, so a source that
sends a third of all rows is blocked and salted in a stream just as in a batch.

State and waiting rows lie in buckets of keys. A batch reads and writes only buckets with rows to add or to release; a small
clock table per batch names the version of every bucket. A batch that is run again after a failure starts from the clock
before it and overwrites what it wrote; versions that no restart can need are removed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import telemetry as tl
from ..operators.blocks import scan, series
from ..session import cut

BUCKET = "fold_bucket"
SEEN = "fold_seen"
CLOCK = "bucket int, state long, waiting long, low double"
FINAL = -1


@dataclass(frozen=True)
class Fold:
    """What to do with released rows.

    ``step(rows, state)`` gets rows of some keys and all their state and returns output and new state; ``close(state)`` gives the output
    that keys owe when they end. ``key`` and ``time`` are columns of the rows, ``state`` the schema of the state, which has ``key``. Rows may
    come ``delay`` (in units of ``time``) behind the latest; a key without rows for ``expire`` ends, when its bucket is next written.
    """

    key: str
    time: str
    state: str
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame | None, DataFrame]]
    close: Callable[[DataFrame], DataFrame] | None = None
    delay: float = 0.0
    expire: float = math.inf
    buckets: int = 64

    def lasting(self, delay: float, expire: float = math.inf) -> Fold:
        return replace(self, delay=delay, expire=expire)


@dataclass
class _Clock:
    """Watermark, and per bucket the batches that wrote its state and waiting rows (None: it has none) and its earliest waiting time."""

    watermark: float
    buckets: dict[int, tuple[int | None, int | None, float | None]]


def _clock(spark: SparkSession, folder: str, batch: int) -> _Clock:
    if batch < 0:
        return _Clock(-math.inf, {})
    rows = spark.read.schema(CLOCK).parquet(f"{folder}/clock/batch={batch}").collect()
    return _Clock(next(r["low"] for r in rows if r["bucket"] < 0), {r["bucket"]: (r["state"], r["waiting"], r["low"]) for r in rows if r["bucket"] >= 0})


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(BUCKET)


def _versions(spark: SparkSession, folder: str, kind: str, schema: T.StructType, at: dict[int, int | None]) -> DataFrame:
    paths = [f"{folder}/{kind}/batch={batch}/{BUCKET}={b}" for b, batch in at.items() if batch is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _keep(df: DataFrame, fold: Fold, path: str, time: str) -> dict[int, float]:
    """Writes rows by bucket; buckets that got any, with their earliest ``time``."""
    df.select("*", _bucket(fold.key, fold.buckets)).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())])
    back = df.sparkSession.read.schema(schema).parquet(path).groupBy(BUCKET).agg(F.min(F.col(time).cast("double")).alias("low"))
    return {r[BUCKET]: r["low"] for r in back.collect()}


def _advance(spark: SparkSession, folder: str, fold: Fold, rows: DataFrame, before: _Clock, now: float, touched: set[int], batch: int) -> None:
    """Release rows under the watermark ``now`` in the buckets that are touched, and write what is new."""
    state_schema = T.StructType([*T.StructType.fromDDL(fold.state).fields, T.StructField(SEEN, T.DoubleType())])
    version = lambda i: {b: before.buckets.get(b, (None, None, None))[i] for b in touched}
    waiting = _versions(spark, folder, "waiting", rows.schema, version(1)).unionByName(rows)
    held = _versions(spark, folder, "state", state_schema, version(0))
    at = F.col(fold.time).cast("double")
    ready = cut(waiting.where(at < now))
    out, state = fold.step(ready, held.drop(SEEN))
    last = ready.select(fold.key, at.alias(SEEN)).unionByName(held.select(fold.key, SEEN)).groupBy(fold.key).agg(F.max(SEEN).alias(SEEN))
    state = cut(state.join(last, fold.key, "left"))
    ended = F.lit(now == math.inf) | (F.col(SEEN) < now - fold.expire)
    owed = fold.close(state.where(ended).drop(SEEN)) if fold.close is not None else None
    parts = [p for p in (out, owed) if p is not None]
    if parts:
        (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
    states = _keep(state.where(~ended), fold, f"{folder}/state/batch={batch}", SEEN)
    rest = _keep(waiting.where(at >= now), fold, f"{folder}/waiting/batch={batch}", fold.time)
    after = dict(before.buckets) | {b: (batch if b in states else None, batch if b in rest else None, rest.get(b)) for b in touched}
    table = [(-1, None, None, now), *[(b, *v) for b, v in after.items()]]
    spark.createDataFrame(table, CLOCK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/clock/batch={batch}")


def _remove(spark: SparkSession, folder: str, batch: int) -> None:
    """Versions that only clocks older than the last two name."""
    if batch < 2:
        return
    old, last = _clock(spark, folder, batch - 2), [_clock(spark, folder, b) for b in (batch - 1, batch)]
    gone = [f"{folder}/clock/batch={batch - 2}"]
    for i, kind in enumerate(("state", "waiting")):
        needed = {(b, c.buckets[b][i]) for c in last for b in c.buckets}
        gone += [f"{folder}/{kind}/batch={v[i]}/{BUCKET}={b}" for b, v in old.buckets.items() if v[i] is not None and (b, v[i]) not in needed]
        gone += [f"{folder}/{kind}/batch={n}" for n in {v[i] for v in old.buckets.values()} - {None} - {v for _, v in needed}]
    path = spark._jvm.org.apache.hadoop.fs.Path
    for g in gone:
        p = path(g)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_fold(sdf: DataFrame, folder: str, fold: Fold, once: bool = True):
    """Start the query. Outputs go to {folder}/out, late rows and rows without key or time to {folder}/late, per batch."""
    spark = sdf.sparkSession
    folder = folder.rstrip("/")

    def each(batch: DataFrame, n: int) -> None:
        before = _clock(spark, folder, n - 1)
        rows = batch.persist()
        at = F.col(fold.time).cast("double")
        known = F.col(fold.key).isNotNull() & at.isNotNull() & ~F.isnan(at)
        why = F.when(~known, "no key or time").when(at < before.watermark, "late")
        rows.select("*", why.alias("why")).where("why is not null").write.mode("overwrite").parquet(f"{folder}/late/batch={n}")
        good = rows.where(why.isNull())
        came = {r[BUCKET]: r["top"] for r in good.groupBy(_bucket(fold.key, fold.buckets)).agg(F.max(at).alias("top")).collect()}
        now = max([before.watermark, *(t - fold.delay for t in came.values())])
        due = {b for b, (_, waiting, low) in before.buckets.items() if waiting is not None and low < now}
        _advance(spark, folder, fold, good, before, now, due | came.keys(), n)
        rows.unpersist()
        _remove(spark, folder, n)

    writer = sdf.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if once else writer).start()


def close_fold(spark: SparkSession, folder: str, fold: Fold, query, schema: T.StructType) -> None:
    """Once a stream is over: release all waiting rows and let every key end. ``schema`` is that of the stream's rows."""
    folder = folder.rstrip("/")
    before = _clock(spark, folder, query.lastProgress["batchId"] if query.lastProgress else -1)
    _advance(spark, folder, fold, spark.createDataFrame([], schema), before, math.inf, set(before.buckets), FINAL)


def fold_output(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/out").drop("batch")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came behind the watermark or had no key or time, with ``why``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/late").drop("batch")


# Consecutive failures ----------------------------------------------------------

FAILURE_STATE = "source string, failures long"


def failure_runs(events: DataFrame) -> DataFrame:
    """Running count of consecutive failures per source; rows are (source, seq, failed).

    ``open_start`` marks rows before the first success, whose count continues an
    earlier run.
    """
    s = series("source", "seq")
    pos = scan(events, s, number="_at")
    since = scan(pos, s, fills={"_ok": F.when(~F.col("failed"), F.col("_at"))})
    run = F.when(F.col("failed"), F.col("_at") - F.coalesce("_ok", F.lit(-1))).otherwise(0)
    return since.withColumn("failures", run).withColumn("open_start", F.col("_ok").isNull()).drop("_at", "_ok")


def failure_breaches(events: DataFrame, limit: int) -> DataFrame:
    """First row of each run that exceeds the limit (strictly more failures than allowed)."""
    return failure_runs(events).where(F.col("failures") == limit + 1).select("source", "seq", "failures")


def failure_fold(limit: int) -> Fold:
    """Breaches of (source, seq, failed) rows in order of ``seq``; a source that expires starts counting anew."""

    def step(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        runs = failure_runs(rows.select("source", "seq", "failed"))
        known = runs.join(state.withColumnRenamed("failures", "_held"), "source", "left")
        total = F.col("failures") + F.when(F.col("open_start") & F.col("failed"), F.coalesce("_held", F.lit(0))).otherwise(0)
        known = known.withColumn("failures", total)
        last = known.groupBy("source").agg(F.max_by("failures", "seq").alias("_now"))
        after = state.join(last, "source", "full").select("source", F.coalesce("_now", "failures").alias("failures"))
        return known.where(F.col("failures") == limit + 1).select("source", "seq", "failures"), after

    return Fold("source", "seq", FAILURE_STATE, step)


# Telemetry health ---------------------------------------------------------------

HEALTH_STATE = (
    "session_id long, stream string, samples long, err_sum double, err_n long, max_err double, bad_fix long, bad_dop long, "
    "grav_sum double, grav_n long, last struct<seq:long,time_sec:double,data:array<double>>"
)
_ADDED = ["samples", "err_sum", "err_n", "bad_fix", "bad_dop", "grav_sum", "grav_n"]


def _health_step(rows: DataFrame, state: DataFrame) -> tuple[None, DataFrame]:
    of = ["session_id", "stream"]
    used = rows.where(F.col("stream").isin("GPS9", "GPS5", "GRAV"))
    steps = scan(used, series(of, "seq"), lags={"_p": F.struct("time_sec", "data")})
    held = state.select(*of, F.struct(F.col("last.time_sec").alias("time_sec"), F.col("last.data").alias("data")).alias("_held"))
    joined = steps.join(held, of, "left").withColumn("_p", F.coalesce("_p", "_held"))
    new = tl.gps_sums(joined, of).join(tl.grav_sums(used, of), of, "left").fillna(0, ["grav_sum", "grav_n"])
    new = new.join(used.groupBy(*of).agg(F.max_by(F.struct("seq", "time_sec", "data"), "seq").alias("last")), of)
    both = state.unionByName(new)
    after = both.groupBy(*of).agg(*[F.sum(c).alias(c) for c in _ADDED], F.max("max_err").alias("max_err"), F.max_by("last", "last.seq").alias("last"))
    return None, after.select(*T.StructType.fromDDL(HEALTH_STATE).names)


def health_fold() -> Fold:
    """Health report per session from telemetry samples (session_id, stream, seq, time_sec, data) of any streams, when the session ends.

    Sums are kept per stream: whether a session has GPS9, whose fixes alone then count, is known at its end.
    """
    return Fold("session_id", "time_sec", HEALTH_STATE, _health_step, close=health_report)


def health_report(state: DataFrame) -> DataFrame:
    """The columns of ``gps_health`` and ``imu_health`` from sums per session and stream, with warnings."""
    gps = state.where(F.col("stream").isin("GPS9", "GPS5")).groupBy("session_id").agg(F.max_by(F.struct(*[c for c in [*_ADDED, "max_err"]]), F.col("stream")).alias("_g"))
    grav = state.where("stream = 'GRAV'").select("session_id", "grav_sum", "grav_n")
    every = state.select("session_id").distinct()
    joined = every.join(tl.gps_score(gps.select("session_id", "_g.*")), "session_id", "left").join(tl.imu_score(grav), "session_id", "left")
    # a session without a kind of stream has nothing against it
    fine = {"gps_score": 100.0, "imu_score": 100.0, "max_speed_error_exact": 0.0}
    return tl.health_warnings(joined.fillna(fine))


# Outlier filter -----------------------------------------------------------------

FIX_STATE = "session_id long, kept long, t double, la double, lo double, held struct<seq:long,time_sec:double,lat:double,lon:double,speed:double,agrees:boolean>"
FIX = ["session_id", "seq", "time_sec", "lat", "lon", "speed"]


def outlier_fold(max_err: float = 8.0, width: float = tl.SECONDS_PER_BLOCK) -> Fold:
    """Fixes (session_id, seq, time_sec, lat, lon, speed) that agree with the last kept one, as ``drop_speed_outliers`` keeps them.

    A session left with under two fixes is given back as it is: until it has two, its fixes are held.
    """
    s = series("session_id", ("time_sec", "seq"), width)
    fixes = F.struct(*FIX[1:], F.col("_kept").alias("agrees"))

    def step(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = state.where("held is null").select("session_id", "kept", "t", "la", "lo")
        flagged = cut(tl.speed_outlier_flags(rows.select(*FIX), max_err, s, known.where("t is not null").drop("kept")))
        last = F.max_by(F.struct(F.col("time_sec").alias("t"), F.col("lat").alias("la"), F.col("lon").alias("lo")), F.when(F.col("_kept"), F.struct("time_sec", "seq")))
        new = flagged.groupBy("session_id").agg(F.count_if("_kept").alias("_more"), last.alias("_n"))
        now = known.join(new, "session_id", "full").select(
            "session_id", (F.coalesce("kept", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("kept"), *[F.coalesce(f"_n.{c}", c).alias(c) for c in ("t", "la", "lo")])
        now = cut(now)
        owed = state.where("held is not null").select("session_id", "held").unionByName(flagged.select("session_id", fixes.alias("held")))
        owed = owed.join(now.select("session_id", F.col("kept").alias("_all")), "session_id")
        out = owed.where("_all >= 2 and held.agrees").select("session_id", *[f"held.{c}" for c in FIX[1:]])
        none = [F.lit(None).cast(t).alias(c) for c, t in (("kept", "long"), ("t", "double"), ("la", "double"), ("lo", "double"))]
        held = owed.where("_all < 2").select("session_id", *none, "held")
        return out, now.withColumn("held", F.lit(None).cast(held.schema["held"].dataType)).unionByName(held)

    def close(state: DataFrame) -> DataFrame:
        return state.where("held is not null").select("session_id", *[f"held.{c}" for c in FIX[1:]])

    return Fold("session_id", "time_sec", FIX_STATE, step, close)
