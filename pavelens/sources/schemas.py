"""Declared schemas of the survey tables; nothing is inferred."""

from pyspark.sql import types as T

MANIFEST_FIELDS = (
    "frame_id", "image_path", "timestamp", "latitude", "longitude", "camera_height_m", "pitch",
    "roll", "yaw", "source_video", "source_time_sec", "altitude_m", "status",
)
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in MANIFEST_FIELDS])

POINT_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

DETECTION = T.StructType(
    [
        T.StructField("class_name", T.StringType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("hex_color", T.StringType()),
        T.StructField("hidden", T.BooleanType()),
        T.StructField("is_grouped", T.BooleanType()),
        T.StructField("is_stitched", T.BooleanType()),
        T.StructField("world_polygon", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("spanned_frames", T.ArrayType(T.StringType())),
        T.StructField("area_sqm", T.DoubleType()),
    ]
)

FRAME_TELEMETRY = T.StructType(
    [
        *[T.StructField(n, T.DoubleType()) for n in ("lat", "lon", "raw_lat", "raw_lon", "heading", "speed_ms")],
        T.StructField("grav_vec", T.ArrayType(T.DoubleType())),
        *[T.StructField(n, T.DoubleType()) for n in ("xfov", "yfov", "pitch", "roll", "frame_timestamp_sec")],
    ]
)

PROCESS_META = T.StructType(
    [
        T.StructField("telemetry", FRAME_TELEMETRY),
        T.StructField("options", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "view_meta",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("K", T.ArrayType(T.ArrayType(T.DoubleType()))),
                        T.StructField("detections", T.ArrayType(DETECTION)),
                    ]
                ),
            ),
        ),
        T.StructField("original_name", T.StringType()),
    ]
)

PROCESS_META_LINE = T.StructType([T.StructField("filename", T.StringType()), *PROCESS_META.fields])

DATASET_SAMPLE = T.StructType(
    [
        T.StructField("scene_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("view_type", T.StringType()),
        T.StructField("defect_types_present", T.ArrayType(T.StringType())),
        T.StructField("num_defects", T.LongType()),
        T.StructField("camera_config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("paths", T.MapType(T.StringType(), T.StringType())),
        T.StructField("domain_randomization", T.MapType(T.StringType(), T.StringType())),
    ]
)
DATASET_MANIFEST = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("total_samples", T.LongType()),
        T.StructField("splits", T.MapType(T.StringType(), T.LongType())),
        T.StructField("samples", T.ArrayType(DATASET_SAMPLE)),
    ]
)

_VALUES = lambda *extra: T.StructType(
    [T.StructField("values", T.ArrayType(T.DoubleType())), *[T.StructField(n, T.DoubleType()) for n in extra]]
)
RUN_LOG = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("grad_norms", _VALUES("mean", "max", "min")),
        T.StructField("losses", _VALUES("mean", "latest")),
        T.StructField("last_grad_norms", T.ArrayType(T.DoubleType())),
        T.StructField("last_losses", T.ArrayType(T.DoubleType())),
    ]
)

LIVE_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("original_name", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("location", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField(
            "defects",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("class", T.StringType()),
                        T.StructField("conf", T.DoubleType()),
                        T.StructField("area_sqm", T.DoubleType()),
                        T.StructField("severity", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("message", T.StringType()),
    ]
)
