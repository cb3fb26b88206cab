"""Masks as cell tables: components, ratios, runs and bowl shapes.

Cells are (keys..., row, col). A frame is at most 5312 x 2988 pixels, so one row or one
column of one mask is the largest group that a window here holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import scan, series
from .graph import connected_components
from .joins import salted_join


def row_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal horizontal runs (row, c0, c1) with their cell count."""
    line = Window.partitionBy(*keys, "row").orderBy("col")
    island = F.col("col") - F.row_number().over(line)
    return (
        cells.withColumn("_g", island)
        .groupBy(*keys, "row", "_g")
        .agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("n"))
        .drop("_g")
    )


def label_components(cells: DataFrame, keys: list[str], width: int = 1 << 20) -> DataFrame:
    """Runs with their 8-connected component; the label is the first run in raster order."""
    runs = row_runs(cells, keys).withColumn("node", F.col("row").cast("long") * width + F.col("c0"))
    above = runs.select(*keys, (F.col("row") + 1).alias("row"), F.col("c0").alias("_c0"), F.col("c1").alias("_c1"), F.col("node").alias("v"))
    touch = (
        salted_join(runs, above, [*keys, "row"])
        .where((F.col("_c0") <= F.col("c1") + 1) & (F.col("_c1") >= F.col("c0") - 1))
        .select(*keys, F.col("node").alias("u"), "v")
    )
    comp = connected_components(touch, keys)
    return runs.join(comp, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def largest_component(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the biggest 8-connected component per mask; the first in raster order on ties."""
    labelled = label_components(cells, keys)
    sizes = labelled.groupBy(*keys, "component").agg(F.sum("n").alias("size"))
    best = sizes.groupBy(*keys).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    kept = salted_join(labelled, best, [*keys, "component"])
    return kept.select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def mask_rle(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Uncompressed column-major run lengths, starting with a zero run.

    Runs alternate zeros and ones; a mask has at most height * width of them.
    """
    pos = cells.select(*keys, (F.col("col").cast("long") * height + F.col("row")).alias("p"))
    s = series(keys, "p", 1_000_000)
    step = scan(pos, s, lags={"_prev": F.col("p")}).where(F.col("_prev").isNull() | (F.col("p") > F.col("_prev") + 1))
    runs = scan(step, s, leads={"_end": F.col("_prev")}, number="_k")
    last = pos.groupBy(*keys).agg(F.max("p").alias("_last"))
    full = salted_join(runs, last, keys)
    end = F.coalesce("_end", "_last")
    zeros = F.col("p") - F.coalesce(F.col("_prev") + 1, F.lit(0))
    ones = end - F.col("p") + 1
    pairs = full.select(*keys, "_k", zeros.alias("z"), ones.alias("o"), "_last")
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "z", "o"))), lambda t: F.array(t["z"], t["o"])))
    tail = F.lit(height * width) - 1 - F.max("_last")
    return pairs.groupBy(*keys).agg(body.alias("_b"), tail.alias("_t")).select(
        *keys, F.when(F.col("_t") > 0, F.concat("_b", F.array("_t"))).otherwise(F.col("_b")).alias("counts")
    )


def _envelope(v: list[int]) -> list[float]:
    """Distance of every cell of a row run to the nearest cell outside, from its vertical distances ``v``.

    Every cell, and the two outside cells at the run's ends, is the vertex of a parabola of squared distances; their lower envelope is built and
    read in one walk each.
    """
    f = [0, *(x * x for x in v), 0]
    site, start = [0], [float("-inf")]
    for q in range(1, len(f)):
        while True:
            p = site[-1]
            cut_at = ((f[q] + q * q) - (f[p] + p * p)) / (2 * (q - p))
            if cut_at > start[-1]:
                break
            site.pop()
            start.pop()
        site.append(q)
        start.append(cut_at)
    start.append(float("inf"))
    out, k = [], 0
    for q in range(1, len(f) - 1):
        while start[k + 1] < q:
            k += 1
        out.append(math.sqrt((q - site[k]) ** 2 + f[site[k]]))
    return out


def boundary_distance(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Exact Euclidean distance of every mask cell to the nearest cell outside the mask.

    Separable: the vertical distance within each column run, then the lower envelope of parabolas
    along each row run (a neighbour beyond the run is never closer than its end), in time linear in the cells. Runs stream
    through a task in order; it holds one batch and one run.
    """
    column = Window.partitionBy(*keys, "col").orderBy("row")
    v = cells.withColumn("_g", F.col("row") - F.row_number().over(column))
    run = Window.partitionBy(*keys, "col", "_g")
    v = v.withColumn("_v", F.least(F.col("row") - F.min("row").over(run), F.max("row").over(run) - F.col("row")) + 1)
    line = Window.partitionBy(*keys, "row").orderBy("col")
    h = v.select(*keys, "row", "col", "_v", F.coalesce(F.lag("col").over(line) != F.col("col") - 1, F.lit(True)).alias("_head"))
    columns = [*keys, "row", "col"]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None

        def done(part: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
            values = part["_v"].to_numpy().tolist()
            dist = [d for a, b in zip(ends[:-1], ends[1:]) for d in _envelope(values[a:b])]
            return part[columns].assign(dist=dist)

        for part in parts:
            if not len(part):
                continue
            part = part if tail is None else pd.concat([tail, part], ignore_index=True)
            heads = np.flatnonzero(part["_head"].to_numpy()).tolist()
            if heads[-1]:
                yield done(part.iloc[: heads[-1]], heads)
            tail = part.iloc[heads[-1] :].reset_index(drop=True)
        if tail is not None:
            yield done(tail, [0, len(tail)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in h.select(*columns).schema.fields)
    return h.mapInPandas(walk, f"{fields}, dist double")


def crater_profile(cells: DataFrame, keys: list[str], depth: DataFrame, crop: DataFrame | None = None) -> DataFrame:
    """Mean depth of a bowl whose shape is (distance / largest distance) ^ 0.8, and a shape quality.

    depth: keys..., max_depth_m. crop: keys..., crop_w, crop_h of the padded box; by
    default the mask box padded by 20 percent, at least 20 pixels, per side.
    """
    d = boundary_distance(cells, keys)
    peak = d.groupBy(*keys).agg(
        F.max("dist").alias("_peak"),
        (F.max("col") - F.min("col")).alias("_w"),
        (F.max("row") - F.min("row")).alias("_h"),
        F.avg(F.pow("dist", F.lit(0.8))).alias("_mean"),
    )
    pad = lambda side: side + F.greatest((side * 0.2).cast("int"), F.lit(20)) * 2
    sized = (
        peak.withColumn("crop_w", pad(F.col("_w"))).withColumn("crop_h", pad(F.col("_h")))
        if crop is None
        else peak.join(crop, keys)
    )
    shape = F.col("_mean") / F.pow("_peak", F.lit(0.8))
    quality = F.col("_peak") / (F.greatest("crop_w", "crop_h") * 0.5)
    return sized.join(depth, keys).select(
        *keys,
        (shape * F.col("max_depth_m")).alias("mean_depth_m"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)).alias("quality"),
    )
