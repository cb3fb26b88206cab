"""Readers for manifests, telemetry dumps, frame documents, labels and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

# File extensions by kind, without the dot.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
VIDEO_EXTENSIONS = ("mp4", "mov")
MIN_LABEL_TOKENS = 7
#: Session and, if the file had more than one stream, its four-character name.
STREAM_FILE = r"^(.*?)(?:_([A-Z][A-Z0-9]{3}))?\.csv$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV manifest as text columns; an empty manifest is an error."""
    df = spark.read.schema(schemas.MANIFEST).csv(path, header=True, enforceSchema=False, nullValue="\u0000")
    if df.isEmpty():
        raise ValueError(f"manifest is empty: {path}")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_stream_csv(spark: SparkSession, glob: str) -> DataFrame:
    """Per-stream CSV dumps named {session}_{STREAM}.csv with positional columns; {session}.csv, from a file of one stream, has a null ``stream``.

    ``seq`` keeps file order; it is increasing and unique per file, not dense. ``data`` has every column of the file: blank values are null and keep
    their place, only those after a row's last value are left out. A pass over the bare lines finds the widest file.
    """
    widest = spark.read.text(glob).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    schema = T.StructType([T.StructField(str(i), T.DoubleType()) for i in range(widest)])
    name = F.col("_metadata.file_name")
    values = F.array(*[F.col(str(i)) for i in range(widest)])
    last = F.array_max(F.transform(values, lambda v, i: F.when(v.isNotNull(), i + 1).otherwise(0)))
    return (
        spark.read.schema(schema)
        .csv(glob, header=True, mode="PERMISSIVE", enforceSchema=True)
        .select(
            F.regexp_extract(name, STREAM_FILE, 1).alias("session_id"),
            F.nullif(F.regexp_extract(name, STREAM_FILE, 2), F.lit("")).alias("stream"),
            F.monotonically_increasing_id().alias("seq"),
            F.slice(values, F.lit(1), last).alias("data"),
        )
    )


def read_process_meta(spark: SparkSession, glob: str, one_per_file: bool = True) -> DataFrame:
    """Frame documents; unreadable ones give null telemetry.

    A capture folder has one document per file named process_meta_{filename}.json. Large
    surveys pack them as JSON lines that carry ``filename`` themselves.
    """
    if not one_per_file:
        return spark.read.schema(schemas.PROCESS_META_LINE).json(glob, mode="PERMISSIVE")
    name = F.col("_metadata.file_name")
    return (
        spark.read.schema(schemas.PROCESS_META)
        .json(glob, multiLine=True, mode="PERMISSIVE")
        .select(F.regexp_extract(name, r"^process_meta_(.*)\.json$", 1).alias("filename"), "*")
    )


def attach_process_meta(frames: DataFrame, meta: DataFrame) -> DataFrame:
    return frames.join(meta.drop("original_name"), "filename", "left")


def flatten_frame_results(df: DataFrame) -> DataFrame:
    """Frame documents to one row per (filename, view, det_idx)."""
    views = df.select("filename", F.explode("view_meta").alias("view", "meta"))
    dets = views.select("filename", "view", F.posexplode("meta.detections").alias("det_idx", "det"))
    return dets.select("filename", "view", "det_idx", "det.*")


def read_dataset_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Samples of one split. A missing manifest raises on read."""
    return (
        spark.read.schema(schemas.DATASET_MANIFEST)
        .json(path, multiLine=True, mode="FAILFAST")
        .select(F.explode("samples").alias("s"))
        .select("s.*")
        .where(F.col("split") == split)
    )


def portable_path(path: Column, root: str) -> Column:
    """Re-root the last four path segments."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), F.lit(4)))


def parse_labels(lines: DataFrame) -> DataFrame:
    """Polygon text rows (image, line_no, value) to class id and points; short rows are dropped."""
    tokens = F.split(F.trim("value"), r"\s+")
    xy = lambda i: F.struct(
        F.get(tokens, i).try_cast("double").alias("x"), F.get(tokens, i + 1).try_cast("double").alias("y")
    )
    return lines.where(F.size(tokens) >= MIN_LABEL_TOKENS).select(
        "image",
        "line_no",
        F.get(tokens, F.lit(0)).try_cast("int").alias("class_id"),
        F.transform(F.sequence(F.lit(1), F.size(tokens) - 1, F.lit(2)), xy).alias("points"),
    )


def read_labels(spark: SparkSession, glob: str) -> DataFrame:
    lines = spark.read.text(glob).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("image"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )
    return parse_labels(lines)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_LOG).json(path)


def media_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("unsupported")


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive listing with size and kind; file contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "modificationTime", "length", media_kind(F.col("path")).alias("kind"))
    )
