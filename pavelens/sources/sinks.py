"""Writers and export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .readers import IMAGE_EXTENSIONS

DEFAULT_LOCATION = "Unknown Location"


def label_line(class_id: Column, points: Column) -> Column:
    """Polygon to 'class x1 y1 x2 y2 ...' with six decimals."""
    pairs = F.transform(points, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(pairs, " "))


def write_labels(df: DataFrame, path: str) -> None:
    """One folder per image, lines in polygon order.

    Rows are ranged on (image, line_no), so an image with very many polygons is
    split over tasks and its files sort in order.
    """
    (
        df.select("image", "line_no", label_line(F.col("class_id"), F.col("points")).alias("value"))
        .repartitionByRange("image", "line_no")
        .sortWithinPartitions("image", "line_no")
        .select("image", "value")
        .write.mode("overwrite")
        .partitionBy("image")
        .text(path)
    )


def frame_records(frames: DataFrame, defects: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """One record per frame with its defects; frames without defects get an empty list.

    A frame with more than ``part_rows`` defects continues in further records with
    the same frame_id and increasing ``part``, so no row outgrows a task.
    ``det_idx`` is the position of a defect in its frame.
    """
    cols = [c for c in defects.columns if c not in ("frame_id", "det_idx")]
    grouped = (
        defects.withColumn("part", F.floor(F.col("det_idx") / part_rows).cast("int"))
        .groupBy("frame_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("det_idx", *cols))).alias("defects"))
    )
    empty = F.array().cast(grouped.schema["defects"].dataType)
    return frames.join(grouped, "frame_id", "left").select(
        *frames.columns, F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("defects", empty).alias("defects")
    )


def write_frame_json(frames: DataFrame, defects: DataFrame, path: str) -> None:
    frame_records(frames, defects).write.mode("overwrite").json(path)


def feature(geometry_type: str, coordinates: Column, properties: Column) -> Column:
    """GeoJSON feature as a struct."""
    return F.struct(
        F.lit("Feature").alias("type"),
        properties.alias("properties"),
        F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )


def to_feature_lines(df: DataFrame, column: str = "feature") -> DataFrame:
    """One GeoJSON feature text per row: the form that scales, read by GIS tools line by line."""
    return df.withColumn(column, F.to_json(column))


def to_feature_collection(
    df: DataFrame, keys: list[str], order: list[str], column: str = "feature", part: Column | None = None
) -> DataFrame:
    """GeoJSON collections per key, ordered.

    ``part`` splits a large key into several collections (for instance
    ``floor(frame_idx / 10000)``); each collection must fit one row.
    """
    by = [*keys]
    if part is not None:
        df = df.withColumn("part", part)
        by.append("part")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.to_json(column).alias("_json"))))
    texts = F.array_join(F.transform(parts, lambda p: p["_json"]), ",")
    return df.groupBy(*by).agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), texts, F.lit("]}")).alias("collection"),
        F.count(F.lit(1)).alias("features"),
    )


def ply_vertices(points: DataFrame) -> DataFrame:
    """Vertex columns of a point cloud export."""
    return points.select(
        F.col("x").cast("float").alias("x"),
        F.col("y").cast("float").alias("y"),
        F.col("z").cast("float").alias("z"),
        F.col("r").cast("short").alias("red"),
        F.col("g").cast("short").alias("green"),
        F.col("b").cast("short").alias("blue"),
        F.col("class").cast("int").alias("class_id"),
        F.col("severity").cast("float").alias("severity"),
    )


def stem_candidates(name: Column) -> Column:
    """Every substring of a file name that starts at the start or after '_' and ends before '.', '_' or the end."""
    tokens = F.split(name, r"(?=[._])|(?<=[._])")
    n = F.size(tokens)
    starts = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(tokens, F.greatest(i - 1, F.lit(1))) == "_")
    )
    spans = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.filter(
                    F.sequence(i, n),
                    lambda j: (j == n) | F.try_element_at(tokens, (j + 1).cast("int")).isin(".", "_"),
                ),
                lambda j: F.array_join(F.slice(tokens, i.cast("int"), (j - i + 1).cast("int")), ""),
            ),
        )
    )
    return F.array_distinct(spans)


def select_export_files(files: DataFrame, stems: DataFrame) -> DataFrame:
    """Files that belong to a frame stem, each once.

    A name belongs to a stem when the stem occurs between the start or '_' and the
    end, '.' or '_'. All such substrings are listed per file and matched by equality.
    """
    wanted = stems.select(F.col("stem")).distinct()
    return (
        files.select("*", F.explode(stem_candidates(F.col("name"))).alias("stem"))
        .join(wanted, "stem", "left_semi")
        .drop("stem")
        .distinct()
    )


def export_layout(df: DataFrame, kind: str) -> DataFrame:
    """Target path {location}/{view}/{RAW|FLAT}_{name} with a known image extension."""
    if kind not in ("RAW", "FLAT"):
        raise ValueError(kind)
    # Safe file names: blanks become '_', other than letters, digits, '.', '_' and '-' is dropped.
    safe = F.regexp_replace(F.regexp_replace(F.trim("original_name"), r"[\s/\\]+", "_"), r"[^A-Za-z0-9._-]", "")
    safe = F.regexp_replace(safe, r"^[._]+|[._]+$", "")
    known = F.lower(safe).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$")
    image = F.when(known, safe).otherwise(F.concat(safe, F.lit(".jpg")))
    base = F.regexp_replace(image, r"\.[^.]+$", "")
    folder = F.concat_ws("/", F.coalesce("location", F.lit(DEFAULT_LOCATION)), "view")
    return df.withColumn("image_target", F.concat(folder, F.lit(f"/{kind}_"), image)).withColumn(
        "meta_target", F.concat(folder, F.lit(f"/{kind}_"), base, F.lit(".json"))
    )


def retention_report(files: DataFrame, now: Column, days: float | None) -> DataFrame:
    """Counts and bytes to delete and to keep; without days everything goes."""
    keep = F.lit(False) if not days else F.col("mtime") > now - F.lit(days * 86400.0)
    return files.agg(
        F.count_if(~keep).alias("deleted"),
        F.count_if(keep).alias("kept"),
        F.coalesce(F.sum(F.when(~keep, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"),
    )


def upsert_detections(det: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Patch the non-null fields of keyed rows; updates without a matching row are ignored."""
    fields = [c for c in updates.columns if c not in keys]
    patch = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in det.columns]
    added = [F.col(f"_new_{c}").alias(c) for c in fields if c not in det.columns]
    return det.join(patch, keys, "left").select(*out, *added)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table version to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
