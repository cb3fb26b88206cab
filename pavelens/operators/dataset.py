"""Dataset splits, label states and training-run logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import index_rows, scan, series, with_halo


def split_counts(groups: DataFrame, keys: list[str], total: str, ratios: dict[str, float]) -> DataFrame:
    """(keys, split, samples): how many of each group's ``total`` go to each split, by largest remainder; ties go by name.

    One row per group comes in, so the shares are an array per row and nothing is shuffled. A total that is null or below 1 fails the job.
    """
    if not math.isclose(sum(ratios.values()), 1.0, abs_tol=1e-6):
        raise ValueError("ratios must sum to 1")
    n = F.when(F.col(total) >= 1, F.col(total)).otherwise(F.raise_error(F.lit("total must be positive")))
    shares = F.array(*[F.struct((n * share).alias("want"), F.lit(split).alias("split")) for split, share in ratios.items()])
    ranked = F.array_sort(F.transform(shares, lambda s: F.struct((F.floor(s["want"]) - s["want"]).alias("short"), s["split"].alias("split"), F.floor(s["want"]).alias("whole"))))
    spare = F.col(total) - F.aggregate("_ranked", F.lit(0).cast("bigint"), lambda acc, s: acc + s["whole"])
    sized = F.transform("_ranked", lambda s, i: F.struct(s["split"].alias("split"), (s["whole"] + (i < spare).cast("bigint")).alias("samples")))
    return groups.withColumn("_ranked", ranked).select(*keys, F.inline(sized))


def assign_splits(df: DataFrame, order: list[str], ratios: dict[str, float], position: str | None = None) -> DataFrame:
    """Contiguous split assignment in the given order of splits, with dense scene numbers.

    ``position`` names an existing dense 0-based position and saves the indexing pass.
    """
    placed = df.withColumn("scene_no", F.col(position)) if position else index_rows(
        df.withColumn("_all", F.lit(0)), ["_all"], order, "scene_no"
    ).drop("_all")
    sizes = split_counts(placed.agg(F.count(F.lit(1)).alias("total")), [], "total", ratios)
    samples = {row["split"]: row["samples"] for row in sizes.collect()}  # one row per split
    upto, label = 0, F.lit(None).cast("string")
    bounds = []
    for name in ratios:
        upto += samples[name]
        bounds.append((upto, name))
    for limit, name in reversed(bounds):
        label = F.when(F.col("scene_no") < limit, name).otherwise(label)
    return placed.withColumn("split", label).withColumn("scene_id", F.format_string("scene_%06d", "scene_no"))


def validate_splits(df: DataFrame, target: int, ratios: dict[str, float]) -> DataFrame:
    """One row: validity and issues of total size, view mix and split shares."""
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("view_type") == "dashcam").alias("_dash"),
        F.count_if(F.col("view_type") == "drone").alias("_drone"),
        *[F.count_if(F.col("split") == k).alias(f"_s_{k}") for k in ratios],
    )
    total = F.col("total")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(0.0)
    lo, hi = int(target * 0.99), int(target * 1.01)
    issues = [
        F.when(~total.between(lo, hi), F.format_string(f"total %d outside {lo}-{hi}", total)),
        F.when(share("_dash") != 1.0, F.format_string("dashcam proportion %.3f is not 1", share("_dash"))),
        F.when(share("_drone") != 0.0, F.format_string("drone proportion %.3f is not 0", share("_drone"))),
    ]
    for k, want in ratios.items():
        off = ~share(f"_s_{k}").between(want - 0.01, want + 0.01)
        issues.append(F.when(off, F.format_string(f"split {k} share %.3f is not {want}", share(f"_s_{k}"))))
    return agg.select("total", F.array_compact(F.array(*issues)).alias("issues")).withColumn("valid", F.size("issues") == 0)


def defect_types_present(instances: DataFrame, key: str = "scene_id") -> DataFrame:
    """Sorted distinct defect types and the defect count per scene."""
    return instances.groupBy(key).agg(
        F.array_sort(F.collect_set("defect_type")).alias("defect_types_present"), F.count(F.lit(1)).alias("num_defects")
    )


def cycle_pairs(a: DataFrame, b: DataFrame, seed: int = 0) -> DataFrame:
    """One row per index up to the longer side: side A by modulo, side B by a seeded hash.

    a and b carry a dense 0-based ``pos``; their columns come back as structs.
    """
    n_a, n_b = a.count(), b.count()
    if n_a == 0 or n_b == 0:
        raise ValueError("both sides need samples")
    length = max(n_a, n_b)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("idx").cast("string"))), 1, 12), 16, 10).cast("long")
    idx = a.sparkSession.range(length).select(F.col("id").alias("idx")).select(
        "idx", (F.col("idx") % n_a).alias("_a"), F.pmod(draw, F.lit(n_b)).alias("_b")
    )
    left = a.select(F.col("pos").alias("_a"), F.struct(*a.columns).alias("a"))
    right = b.select(F.col("pos").alias("_b"), F.struct(*b.columns).alias("b"))
    return idx.join(left, "_a").join(right, "_b").select("idx", "a", "b")


def label_status(images: DataFrame, labels: DataFrame, key: str = "filename") -> DataFrame:
    """approved when a label exists, else pending."""
    done = labels.select(key).distinct().withColumn("_done", F.lit(True))
    return (
        images.join(done, key, "left")
        .withColumn("status", F.when(F.col("_done"), "approved").otherwise("pending"))
        .drop("_done")
    )


def pending_work(images: DataFrame, labels: DataFrame, key: str = "filename") -> DataFrame:
    """Images whose label has not been written yet."""
    return images.join(labels.select(key), key, "left_anti")


def reuse_depth_cache(det: DataFrame, cache: DataFrame, method: str, keys: list[str], force: bool = False) -> DataFrame:
    """Detections with cached depth of the same method; the rest is marked for recomputing."""
    usable = cache.where(F.coalesce("depth_method", F.lit("geometry")) == method)
    if force:
        usable = usable.where(F.lit(False))
    out = det.join(usable.withColumn("_hit", F.lit(True)), keys, "left")
    return out.withColumn("recompute", F.col("_hit").isNull()).drop("_hit")


def node_status(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Map nodes with the state of their result; results without a node are appended.

    Later results of the same frame win.
    """
    res = results.groupBy("original_name").agg(
        F.max_by(F.struct("location", "lat", "lon"), "seq").alias("_r")
    )
    joined = nodes.withColumn("_node", F.lit(True)).join(res, "original_name", "full")
    place = F.col("_r").isNotNull()
    keep = F.col("_node").isNotNull() | (F.col("_r.lat").isNotNull() & F.col("_r.lon").isNotNull())
    return joined.where(keep).select(
        "original_name",
        place.alias("processed"),
        F.coalesce("_r.location", "location").alias("location"),
        F.coalesce("_r.lat", "lat").alias("lat"),
        F.coalesce("_r.lon", "lon").alias("lon"),
    )


# Run logs --------------------------------------------------------------------


def run_log_stats(log: DataFrame) -> DataFrame:
    """Per diagnostic record: gradient norm statistics, mean and latest loss, NaN or infinity flag."""
    g, lo = F.coalesce("grad_norms", F.array().cast("array<double>")), F.coalesce("losses", F.array().cast("array<double>"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    safe = lambda a, v: F.when(F.size(a) > 0, v).otherwise(0.0)
    latest = F.try_element_at(lo, F.lit(-1))
    bad = F.exists(lo, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        log.withColumn("grad_mean", safe(g, total(g) / F.size(g)))
        .withColumn("grad_max", safe(g, F.array_max(g)))
        .withColumn("grad_min", safe(g, F.array_min(g)))
        .withColumn("loss_mean", safe(lo, total(lo) / F.size(lo)))
        .withColumn("loss_latest", safe(lo, latest))
        .withColumn("has_nan", bad)
    )


def best_metrics(log: DataFrame, lower_is_better: Column, keys: list[str] | None = None) -> DataFrame:
    """Best value and its first epoch per metric; ``lower_is_better`` is a predicate on ``metric``."""
    keys = list(keys or [])
    flat = log.select(*keys, "epoch", F.explode("metrics").alias("metric", "value")).where(~F.isnan("value"))
    by_low = F.struct(F.col("value"), F.col("epoch"))
    by_high = F.struct(-F.col("value"), F.col("epoch"))
    best = F.when(F.first(lower_is_better), F.min(by_low)["epoch"]).otherwise(F.min(by_high)["epoch"])
    value = F.when(F.first(lower_is_better), F.min("value")).otherwise(F.max("value"))
    return flat.groupBy(*keys, "metric").agg(value.alias("best_value"), best.alias("best_epoch"))


def last_n(log: DataFrame, keys: list[str], order: str, col: str, n: int = 10, chunk: int = 8_192) -> DataFrame:
    """The last n values up to each row, oldest first."""
    spread = with_halo(log, series(keys, order), n - 1, 0, max(chunk, n))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn(f"last_{col}", F.collect_list(col).over(w))
        .where("_core")
        .drop("_pos", "_len", "_chunk", "_core")
    )


def patience(log: DataFrame, keys: list[str], order: str, loss: str = "loss") -> DataFrame:
    """Running best loss and rows since the last strict improvement."""
    s = series(keys, order)
    pos = scan(log, s, number="_at")
    best = scan(pos, s, mins={"_best": F.struct(F.col(loss).alias("v"), F.col("_at").alias("p"))})
    return (
        best.withColumn("best_loss", F.col("_best.v"))
        .withColumn("epochs_without_improvement", F.col("_at") - F.col("_best.p"))
        .drop("_at", "_best")
    )
