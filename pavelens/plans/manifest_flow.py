"""Which frames of a survey are fit for measurement, why are the others not, and where were they?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_double
from ..operators.blocks import series
from ..operators.manifest import DEFAULT_BLUR_THRESHOLD, carry_heading, ready_frames, status_counts, validate_manifest
from ..sources.sinks import feature, to_feature_lines


def manifest_report(manifest: DataFrame, blur_threshold: float = DEFAULT_BLUR_THRESHOLD) -> DataFrame:
    return status_counts(validate_manifest(manifest, blur_threshold))


def manifest_features(manifest: DataFrame, blur_threshold: float = DEFAULT_BLUR_THRESHOLD) -> DataFrame:
    """Camera points of the ready frames with heading; needs session_id and frame_idx."""
    ready = ready_frames(validate_manifest(manifest, blur_threshold))
    fixes = ready.select(
        "session_id", "frame_idx", "frame_id",
        safe_double(F.col("latitude"), 0.0).alias("lat"), safe_double(F.col("longitude"), 0.0).alias("lon"),
    )
    headed = carry_heading(fixes, series("session_id", "frame_idx"))
    props = F.struct(F.lit("camera").alias("type"), F.col("frame_id").alias("filename"))
    point = feature("Point", F.array("lon", "lat"), props)
    return to_feature_lines(headed.where("lat != 0 and lon != 0").withColumn("feature", point))
