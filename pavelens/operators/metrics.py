"""Evaluation metrics over per-pixel and per-image prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera

EPS_DEPTH = 1e-6
MIN_STD = 1e-8


def confusion_matrix(px: DataFrame, n: int) -> DataFrame:
    """Dense n x n counts over pixels whose target is a known class."""
    seen = (
        px.where(F.col("target_class").between(0, n - 1) & F.col("pred_class").between(0, n - 1))
        .groupBy("target_class", "pred_class")
        .agg(F.count(F.lit(1)).alias("pixels"))
    )
    grid = px.sparkSession.range(n * n).select(
        F.floor(F.col("id") / n).cast("int").alias("target_class"), (F.col("id") % n).cast("int").alias("pred_class")
    )
    return grid.join(seen, ["target_class", "pred_class"], "left").na.fill(0, ["pixels"])


def class_metrics(cm: DataFrame) -> DataFrame:
    """IoU and recall per class; a class without pixels scores zero."""
    hit = F.when(F.col("target_class") == F.col("pred_class"), F.col("pixels")).otherwise(0)
    sides = cm.select(
        F.explode(
            F.array(
                F.struct(F.col("target_class").alias("class"), F.col("pixels").alias("t"), F.lit(0).alias("p"), hit.alias("h")),
                F.struct(F.col("pred_class").alias("class"), F.lit(0).alias("t"), F.col("pixels").alias("p"), F.lit(0).alias("h")),
            )
        ).alias("s")
    ).select("s.*")
    agg = sides.groupBy("class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("tp"))
    union = F.col("t") + F.col("p") - F.col("tp")
    ratio = lambda d: F.when(d > 0, F.col("tp") / d).otherwise(0.0)
    return agg.select("class", "tp", ratio(union).alias("iou"), ratio(F.col("t")).alias("accuracy"), F.col("t").alias("target_pixels"))


def seg_metrics(cm: DataFrame) -> DataFrame:
    """Pixel accuracy, mean IoU and mean class accuracy; absent classes are averaged as zero."""
    total = F.sum("target_pixels")
    return class_metrics(cm).agg(
        F.when(total > 0, F.sum("tp") / total).otherwise(0.0).alias("pixel_accuracy"),
        F.avg("iou").alias("miou"),
        F.avg("accuracy").alias("mean_class_accuracy"),
    )


def depth_metrics(px: DataFrame) -> DataFrame:
    """RMSE over per-image mean squared errors, two-level AbsRel, pooled threshold shares."""
    p, t = F.greatest("pred_depth", F.lit(EPS_DEPTH)), F.greatest("target_depth", F.lit(EPS_DEPTH))
    ratio = F.greatest(p / t, t / p)
    per_image = (
        px.where(F.col("target_depth") > 0)
        .groupBy("image_id")
        .agg(
            F.avg((p - t) * (p - t)).alias("mse"),
            F.avg(F.abs(p - t) / t).alias("rel"),
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(ratio < 1.25**k).alias(f"d{k}") for k in (1, 2, 3)],
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per_image.agg(
        zero(F.sqrt(F.avg("mse"))).alias("rmse"),
        zero(F.avg("rel")).alias("abs_rel"),
        *[zero(F.sum(f"d{k}") / F.sum("n")).alias(f"delta_{k}") for k in (1, 2, 3)],
    )


def geodesic_error(pred: list[Column], target: list[Column]) -> Column:
    """Angle between two Rodrigues rotations, in radians."""
    rel = camera.matmul(camera.transpose(camera.rodrigues_matrix(*pred)), camera.rodrigues_matrix(*target))
    cos = camera.let(rel, lambda m: (m[0] + m[4] + m[8] - 1.0) / 2)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def camera_metrics(poses: DataFrame) -> DataFrame:
    """Mean intrinsic error, rotation angle and translation distance.

    Reads p_* and t_* columns for fx, fy, cx, cy, r1..r3, t1..t3.
    """
    gap = lambda c: F.abs(F.col(f"p_{c}") - F.col(f"t_{c}"))
    intr = (gap("fx") + gap("fy") + gap("cx") + gap("cy")) / 4
    rot = geodesic_error([F.col(f"p_r{i}") for i in (1, 2, 3)], [F.col(f"t_r{i}") for i in (1, 2, 3)])
    move = F.sqrt(sum((gap(f"t{i}") * gap(f"t{i}") for i in (2, 3)), gap("t1") * gap("t1")))
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    staged = poses.select(intr.alias("intr"), rot.alias("rot"), move.alias("move"))
    return staged.agg(
        zero("intr").alias("intrinsic_mae"), zero("rot").alias("rotation_geodesic"), zero("move").alias("translation_error")
    )


def severity_metrics(px: DataFrame) -> DataFrame:
    """Mean of per-image MAE inside defects and the pooled correlation, zero when either side is flat."""
    inside = px.where(F.col("target_class") > 0)
    p, t = F.col("pred_severity"), F.col("target_severity")
    per_image = inside.groupBy("image_id").agg(F.avg(F.abs(p - t)).alias("mae"))
    mae = per_image.agg(F.coalesce(F.avg("mae"), F.lit(0.0)).alias("mae"), F.lit(1).alias("_one"))
    varied = (F.count(F.lit(1)) > 1) & (F.stddev_pop(p) > MIN_STD) & (F.stddev_pop(t) > MIN_STD)
    corr = inside.agg(F.when(varied, F.corr(p, t)).otherwise(0.0).alias("pearson_correlation"), F.lit(1).alias("_one"))
    return mae.join(corr, "_one").drop("_one")


def masked_l1(px: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Mean absolute difference inside a mask; zero when the mask is empty."""
    m = F.col(mask)
    return px.agg(
        F.when(F.sum(m) != 0, F.sum(F.abs(m * F.col(b) - m * F.col(a))) / F.sum(m)).otherwise(0.0).alias("masked_l1")
    )


def binary_confusion(px: DataFrame) -> DataFrame:
    """Defect hits, false alarms and misses per image with mean depth and severity errors."""
    t, p = F.col("target_class") > 1, F.col("pred_class") > 1
    return px.groupBy("image_id").agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.avg(F.abs(F.col("target_depth") - F.col("pred_depth"))).alias("depth_error"),
        F.avg(F.abs(F.col("target_severity") - F.col("pred_severity"))).alias("severity_error"),
    )
