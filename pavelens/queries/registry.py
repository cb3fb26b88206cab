"""Query registry: Spark callables and, where SQL can say it, the same question as ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_fast

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rnd(c, digits: int = 6) -> Column:
    """Rounded for comparison; a small offset settles exact ties the same way in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 10.0 ** -(digits + 3), digits)


def rnd_fast(c, digits: int = 6) -> Column:
    """The values of ``rnd`` for results of very many rows."""
    return round_fast((F.col(c) if isinstance(c, str) else c) + 10.0 ** -(digits + 3), digits)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# SQL text helpers -----------------------------------------------------------


def r(expr: str, digits: int = 6) -> str:
    """The SQL twin of rnd: a rounded double without negative zero."""
    value = f"round(({expr}) + 1e-{digits + 3}::DOUBLE, {digits})"
    return f"(CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END)"


def sql_hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians(({c})-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2))"
    return f"(2*6378137.0*atan2(sqrt({h}),sqrt(greatest(1-{h},0))))"


def sql_mod(x: str, m: str) -> str:
    return f"(({x}) - ({m}) * floor(({x}) / ({m})))"


def sql_bearing(a: str, b: str, c: str, d: str) -> str:
    dl = f"(radians({d})-radians({b}))"
    x = f"(sin({dl})*cos(radians({c})))"
    y = f"(cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos({dl}))"
    return sql_mod(f"degrees(atan2({x},{y}))", "360.0")


def sql_dest(lat: str, lon: str, rad: str, dist: str) -> tuple[str, str]:
    arc = f"(({dist})/6378137.0)"
    la = f"radians({lat})"
    out = f"asin(greatest(-1.0,least(1.0,sin({la})*cos({arc})+cos({la})*sin({arc})*cos({rad}))))"
    lon_out = f"(radians({lon})+atan2(sin({rad})*sin({arc})*cos({la}),cos({arc})-sin({la})*sin({out})))"
    return f"degrees({out})", f"degrees({lon_out})"


def sql_l2g(lat: str, lon: str, heading: str, x: str, z: str) -> tuple[str, str]:
    return sql_dest(lat, lon, f"(radians({heading})+atan2({x},{z}))", f"sqrt(({x})*({x})+({z})*({z}))")
