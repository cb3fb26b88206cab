"""Small value rules as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MAX_INLINE_BYTES = 1024
POTHOLE_KEYWORD = "pothole"
SEVERITY_MINOR_BELOW_CM2 = 500.0
SEVERITY_MODERATE_UPTO_CM2 = 2000.0
CLASS_COLORS = {
    0: (128, 128, 128),
    1: (0, 0, 0),
    2: (255, 0, 0),
    3: (255, 165, 0),
    4: (0, 0, 255),
    5: (0, 255, 0),
    6: (255, 255, 0),
    7: (255, 0, 255),
}


def safe_double(col: Column, default: float | None = None) -> Column:
    text = F.trim(col.cast("string"))
    parsed = F.when(text != "", text).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities become null; long binaries become a size placeholder, short ones text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        elif isinstance(f.dataType, T.BinaryType):
            size = F.octet_length(c)
            c = F.when(size > MAX_INLINE_BYTES, F.format_string("<binary data: %d bytes>", size)).otherwise(
                F.decode(c, "UTF-8")
            )
        out.append(c.alias(f.name))
    return df.select(*out)


def format_seconds(col: Column) -> Column:
    """HH:MM:SS.mmm; negatives and NaN count as zero."""
    sec = F.when(F.isnan(col) | (col < 0), 0.0).otherwise(col).cast("double")
    return F.format_string(
        "%02d:%02d:%06.3f",
        F.floor(sec / 3600).cast("int"),
        F.floor(F.pmod(sec, F.lit(3600.0)) / 60).cast("int"),
        F.pmod(sec, F.lit(60.0)),
    )


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def coalesce_metadata(df: DataFrame) -> DataFrame:
    """Prefer single tags, then composite tags, then 'N/A'.

    Reads create_date, original_date, altitude, composite_altitude, latitude, longitude,
    composite_position, gps_date, gps_time, composite_datetime.
    """
    parts = F.split(F.trim("composite_position"), r"\s+")
    from_composite = F.col("latitude").isNull() | F.col("longitude").isNull()
    paired = F.size(parts) >= 2

    def coordinate(name: str, at: int) -> Column:
        fallback = F.when(paired, F.try_element_at(parts, F.lit(at)))
        return F.coalesce(F.when(from_composite, fallback).otherwise(F.col(name)), F.lit("N/A"))

    blank_to_null = lambda c: F.when(F.col(c) != "", F.col(c))
    both = blank_to_null("gps_date").isNotNull() & blank_to_null("gps_time").isNotNull()
    return (
        df.withColumn("_lat", coordinate("latitude", 1))
        .withColumn("_lon", coordinate("longitude", 2))
        .withColumn(
            "taken_at", F.coalesce(blank_to_null("create_date"), blank_to_null("original_date"), F.lit("Unknown Date"))
        )
        .withColumn(
            "altitude", F.coalesce(blank_to_null("altitude"), blank_to_null("composite_altitude"), F.lit("N/A"))
        )
        .withColumn(
            "gps_datetime",
            F.coalesce(
                F.when(both, F.concat_ws(" ", "gps_date", "gps_time")), blank_to_null("composite_datetime"), F.lit("N/A")
            ),
        )
        .withColumn("latitude", F.col("_lat"))
        .withColumn("longitude", F.col("_lon"))
        .drop("_lat", "_lon")
    )


def is_pothole(cls: Column) -> Column:
    return F.coalesce(F.lower(cls).contains(POTHOLE_KEYWORD), F.lit(False))


def is_defect(class_id: Column) -> Column:
    return class_id > 1


def visible(det: DataFrame) -> DataFrame:
    return det.where(~F.coalesce("hidden", F.lit(False)))


def severity(area_cm2: Column) -> Column:
    return (
        F.when(area_cm2 < SEVERITY_MINOR_BELOW_CM2, "minor")
        .when(area_cm2 <= SEVERITY_MODERATE_UPTO_CM2, "moderate")
        .when(area_cm2.isNotNull(), "severe")
    )


def drift_class(value: Column, warn: float, bad: float) -> Column:
    return F.when(F.abs(value) >= bad, "red").when(F.abs(value) >= warn, "orange").otherwise("green")


def area_rating(error_pct: Column) -> Column:
    return (
        F.when(error_pct < 5, "EXCELLENT")
        .when(error_pct < 10, "GOOD")
        .when(error_pct < 20, "DRIFT")
        .otherwise("CHECK SETUP")
    )


def depth_color(class_id: Column, sev: Column) -> Column:
    """Class colour dimmed by severity, as struct(r, g, b); unknown classes are black."""
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sev * 0.7 + 0.3))
    channels = []
    for i, name in enumerate("rgb"):
        base = F.lit(0)
        for cid, color in CLASS_COLORS.items():
            base = F.when(class_id == cid, color[i]).otherwise(base)
        channels.append((base * gain).cast("int").alias(name))
    return F.struct(*channels)


def python_round(col: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col, digits)


def round_fast(col, digits: int) -> Column:
    """The values of ``round`` for doubles of very many rows: a decimal is built only for values next to a tie."""
    x = F.col(col) if isinstance(col, str) else col
    y = x * 10.0**digits
    plain = (F.abs(y) < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.rint(y) / 10.0**digits + 0.0).otherwise(F.round(x, digits))


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    r = lambda c, n: python_round(c).cast("int").alias(n)
    return F.struct(r(x1, "x"), r(y1, "y"), r(x2 - x1, "w"), r(y2 - y1, "h"))


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def xyxy_to_cxcywh(x1: Column, y1: Column, x2: Column, y2: Column, img_w: Column, img_h: Column) -> Column:
    """Normalised centre and size."""
    return F.struct(
        ((x1 + x2) / 2.0 / img_w).alias("cx"),
        ((y1 + y2) / 2.0 / img_h).alias("cy"),
        ((x2 - x1) / img_w).alias("w"),
        ((y2 - y1) / img_h).alias("h"),
    )
