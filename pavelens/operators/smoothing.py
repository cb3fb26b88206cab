"""Smoothing of ordered series with neighbour halos."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Series, Steps, scan, with_halo

GAUSSIAN_TRUNCATE = 4.0


def gaussian_radius(sigma: Column) -> Column:
    return F.floor(sigma * GAUSSIAN_TRUNCATE + 0.5)


def _edge_index(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    folded = np.mod(i, 2 * n)
    return np.where(folded < n, folded, 2 * n - 1 - folded)


def _convolve(df: DataFrame, s: Series, cols: list[str], radius: Column, sigma: Column | None, mode: str, chunk: int) -> DataFrame:
    """Weighted mean over 2*radius+1 neighbours; one Arrow group per chunk and its halo."""
    if mode not in ("nearest", "reflect"):
        raise ValueError(mode)
    prepared = df.withColumn("_r", radius.cast("long")).withColumn("_sigma", (sigma if sigma is not None else F.lit(0.0)).cast("double"))
    spread = with_halo(prepared, s, F.col("_r"), F.col("_r"), chunk)
    used = {*cols, *s.keys}
    slim = spread.select(
        *[F.col(c) if c in used else F.when(F.col("_core"), F.col(c)).alias(c) for c in df.columns],
        "_r", "_sigma", "_pos", "_len", "_chunk", "_core",
    )
    out_schema = T.StructType(
        [T.StructField(f.name, T.DoubleType() if f.name in cols else f.dataType) for f in df.schema.fields]
    )
    names = df.columns

    def smooth(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        pos = table["_pos"].to_numpy()
        core = np.flatnonzero(table["_core"].to_numpy(zero_copy_only=False))
        r, n = int(table["_r"][0].as_py()), int(table["_len"][0].as_py())
        sig = float(table["_sigma"][0].as_py())
        offsets = np.arange(-r, r + 1)
        kernel = np.exp(-0.5 * (offsets / sig) ** 2) if sig > 0 else np.ones(2 * r + 1)
        kernel = kernel / kernel.sum()
        window = np.arange(pos[core[0]] - r, pos[core[-1]] + r + 1)
        take = np.searchsorted(pos, _edge_index(window, n, mode))
        result = table.select(names).take(pa.array(core))
        for c in cols:
            values = table[c].to_numpy(zero_copy_only=False).astype(float)
            smoothed = np.convolve(values[take], kernel, mode="valid")
            result = result.set_column(names.index(c), c, pa.array(smoothed, pa.float64()))
        return result

    return slim.groupBy(*s.keys, "_chunk").applyInArrow(smooth, out_schema)


def gaussian_smooth(df: DataFrame, s: Series, cols: list[str], sigma, mode: str = "nearest", chunk: int = 8_192) -> DataFrame:
    """Gaussian smoothing of ``cols`` along a series; sigma in samples, constant per series.

    ``nearest`` repeats the end values, ``reflect`` mirrors about the half sample.
    """
    sig = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    return _convolve(df, s, cols, gaussian_radius(sig), sig, mode, chunk)


def unwrap(df: DataFrame, s: Series, col: str, out: str) -> DataFrame:
    """Remove jumps of more than pi from an angle in radians."""
    pi, two_pi = F.lit(np.pi), F.lit(2 * np.pi)

    def shift(p: Column, q: Column) -> Column:
        d = q["v"] - p["v"]
        folded = F.pmod(d + pi, two_pi) - pi
        folded = F.when((folded == -pi) & (d > 0), pi).otherwise(folded)
        return F.when(F.abs(d) < pi, 0.0).otherwise(folded - d)

    total = scan(df, s, steps={"_shift": Steps(F.struct(F.col(col).alias("v")), shift)})
    return total.withColumn(out, F.col(col) + F.col("_shift")).drop("_shift")


def smooth_heading(photos: DataFrame, s: Series, window: int = 5) -> DataFrame:
    """Circular moving average of ``heading`` with repeated ends.

    The window shrinks to the largest odd size that fits; under three photos nothing changes.
    """
    counted = scan(photos, s, totals={"_n": ("count", F.lit(1))})
    fit = F.least(F.lit(window), F.col("_n"))
    fit = fit - F.when(fit % 2 == 0, 1).otherwise(0)
    half = F.when(fit >= 3, F.floor(fit / 2)).otherwise(0)
    rad = unwrap(counted.withColumn("_half", half).withColumn("_rad", F.radians("heading")), s, "_rad", "_un")
    sm = _convolve(rad, s, ["_un"], F.col("_half"), None, "nearest", 8_192)
    heading = F.when(F.col("_half") > 0, F.pmod(F.degrees("_un"), F.lit(360.0))).otherwise(F.col("heading"))
    return sm.withColumn("heading", heading).select(*photos.columns)


def interpolate_index(df: DataFrame, s: Series, pos: str, cols: list[str]) -> DataFrame:
    """Fill nulls linearly between known rows by position; zero outside the known range."""
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).alias("v"))) for c in cols}
    out = scan(
        df, s, fills={f"_a_{c}": k for c, k in known.items()}, next_fills={f"_b_{c}": k for c, k in known.items()}
    )
    values = []
    for c in df.columns:
        if c not in cols:
            values.append(F.col(c))
            continue
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        lerp = a["v"] + (b["v"] - a["v"]) * ((F.col(pos) - a["p"]) / F.when(b["p"] != a["p"], b["p"] - a["p"]).otherwise(1))
        values.append(F.coalesce(lerp, F.lit(0.0)).alias(c))
    return out.select(*values)
