"""Frame manifest checks: which frames are fit for measurement, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing
from ..functions.scalar import safe_double
from .blocks import Series, scan

READY_FULL = "ready_for_full_homography"
READY_BASIC = "ready_for_basic_homography_needs_orientation_data"
READY = (READY_FULL, READY_BASIC)
DEFAULT_BLUR_THRESHOLD = 100.0
CHECKED_FIELDS = ("latitude", "longitude", "camera_height_m", "pitch", "roll", "yaw")


def validate_manifest(df: DataFrame, blur_threshold: float = DEFAULT_BLUR_THRESHOLD) -> DataFrame:
    """Add missing_metadata (array) and homography_status to manifest rows.

    Expects the text manifest plus the probe columns file_exists, readable and
    blur_score. Missing fields are listed only for readable images.
    """
    filled = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("image_path", *CHECKED_FIELDS)}
    readable = (
        (filled["image_path"] != "") & F.coalesce("file_exists", F.lit(False)) & F.coalesce("readable", F.lit(False))
    )
    missing = F.array_compact(F.array(*[F.when(filled[c] == "", F.lit(c)) for c in CHECKED_FIELDS]))
    unoriented = (filled["pitch"] == "") | (filled["roll"] == "") | (filled["yaw"] == "")
    status = (
        F.when(filled["image_path"] == "", "invalid_missing_image_path")
        .when(~F.coalesce("file_exists", F.lit(False)), "invalid_image_file_not_found")
        .when(~F.coalesce("readable", F.lit(False)), "invalid_image_unreadable")
        .when(safe_double(filled["camera_height_m"]).isNull(), "invalid_missing_camera_height")
        .when(F.col("blur_score") < blur_threshold, "warning_low_quality_blurry")
        .when(unoriented, READY_BASIC)
        .otherwise(READY_FULL)
    )
    return df.withColumn(
        "missing_metadata", F.when(readable, missing).otherwise(F.array().cast("array<string>"))
    ).withColumn("homography_status", status)


def ready_frames(df: DataFrame) -> DataFrame:
    return df.where(F.col("homography_status").isin(*READY))


def status_counts(df: DataFrame) -> DataFrame:
    """Validation report rows: total, ready, excluded, then one row per status."""
    per_status = df.groupBy("homography_status").agg(F.count(F.lit(1)).alias("frames"))
    ready = F.col("homography_status").isin(*READY)
    head = per_status.agg(
        F.coalesce(F.sum("frames"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(ready, F.col("frames"))), F.lit(0)).alias("ready"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("total").alias("line"), F.col("total").alias("frames")),
                F.struct(F.lit("ready").alias("line"), F.col("ready").alias("frames")),
                F.struct(F.lit("excluded").alias("line"), (F.col("total") - F.col("ready")).alias("frames")),
            )
        )
    )
    status = per_status.select(F.concat(F.lit("status:"), "homography_status").alias("line"), "frames")
    return head.unionByName(status).orderBy("line")


def quality_gate(df: DataFrame, blur: float = 100.0, dark: float = 30.0, bright: float = 245.0) -> DataFrame:
    """First failing check of blur, darkness and glare on metric columns."""
    reason = (
        F.when(F.col("blur_score") < blur, "motion_blur")
        .when(F.col("luminance") < dark, "underexposed")
        .when(F.col("luminance") > bright, "overexposed")
    )
    return df.withColumn("reject_reason", reason).withColumn("accepted", reason.isNull())


def valid_resolution(df: DataFrame) -> DataFrame:
    return df.where(F.col("width").between(64, 5312) & F.col("height").between(64, 2988))


def carry_heading(frames: DataFrame, s: Series, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bearing from the previous valid fix to this one, else the last heading, else 0.

    A fix is valid when both coordinates are present and non-zero.
    """
    ok = F.coalesce((F.col(lat) != 0.0) & (F.col(lon) != 0.0), F.lit(False))
    here = F.when(ok, F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    prev = scan(frames, s, befores={"_before": here})
    moved = bearing(F.col("_before.lat"), F.col("_before.lon"), F.col(lat), F.col(lon))
    own = F.when(ok & F.col("_before").isNotNull(), moved)
    out = scan(prev.withColumn("_own", own), s, fills={"heading": F.col("_own")})
    return out.withColumn("heading", F.coalesce("heading", F.lit(0.0))).drop("_before", "_own")
