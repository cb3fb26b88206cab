"""Ordered scans over series of any length.

A plain ``Window.partitionBy(session)`` sends a whole session to one task, which
fails when one session holds a large share of all rows. Here every series is cut
into blocks along its leading order column. In-block windows run on
``(keys, block)``; what has to cross a block border (last row, running sum, last
known value, ...) comes from one summary row per block, scanned per series and
joined back. The big side is shuffled once, on ``(keys, block)``.

Rows per block are bounded by the density of the order column: a block of
``width`` positions holds at most ``width`` rows when the column is a unique
position, and ``rate * width`` rows when it is a clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK = "_block"
NO_BLOCK = -(2**62)  # of rows whose leading order column is null
POSITIONS_PER_BLOCK = 200_000
SECONDS_PER_BLOCK = 3_600.0
METERS_PER_BLOCK = 10_000.0


@dataclass(frozen=True)
class Series:
    """Rows that belong together (``keys``) and their total order (``order``)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: float = POSITIONS_PER_BLOCK

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, BLOCK]

    def block(self) -> Column:
        return F.coalesce(F.floor(F.col(self.order[0]) / F.lit(self.width)).cast("long"), F.lit(NO_BLOCK))

    def rows(self) -> Window:
        return Window.partitionBy(*self.block_keys).orderBy(*self.order)


def series(keys, order, width: float = POSITIONS_PER_BLOCK) -> Series:
    as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v)
    return Series(as_tuple(keys), as_tuple(order), width)


@dataclass(frozen=True)
class Steps:
    """A running sum of ``between(before, here)`` over the rows where the struct ``at`` is not null.

    ``start`` stands before the first such row; without it that row adds nothing. ``before`` may name a further column: the sum
    at the previous row of the series, null on its first row.
    """

    at: Column
    between: Callable[[Column, Column], Column]
    start: Column | None = None
    before: str | None = None


def scan(
    df: DataFrame,
    s: Series,
    *,
    lags: dict | None = None,
    leads: dict | None = None,
    sums: dict | None = None,
    mins: dict | None = None,
    fills: dict | None = None,
    befores: dict | None = None,
    next_fills: dict | None = None,
    number: str | None = None,
    totals: dict | None = None,
    steps: dict | None = None,
) -> DataFrame:
    """Add ordered-scan columns to ``df``; every dict maps new name -> expression.

    lags / leads    value on the previous / next row of the series
    sums / mins     inclusive running sum / minimum
    fills           last non-null value at or before the row
    befores         last non-null value strictly before the row
    next_fills      first non-null value at or after the row
    number          name of a dense 0-based position
    totals          (kind, expression) over the whole series; kind is one of
                    count, sum, min, max, first, last
    steps           ``Steps``: running sum of a function of each row and the one before it

    Rows are read twice: once for the blocks, once for the row per block that carries values across borders. Scans that build on each other double
    that, so ``steps`` takes the place of lags with sums over them.
    """
    lags, leads, sums, mins = lags or {}, leads or {}, sums or {}, mins or {}
    fills, befores, next_fills, totals = fills or {}, befores or {}, next_fills or {}, totals or {}
    order = F.struct(*s.order)
    before = Window.partitionBy(*s.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*s.keys).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    neighbour = Window.partitionBy(*s.keys).orderBy(BLOCK)
    whole = Window.partitionBy(*s.keys)

    rows = df.withColumn(BLOCK, s.block())
    inputs, aggs, carries, outputs = [], [], [], {}
    w = s.rows()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a frame that ends with the last row is worked out anew for every row, so what follows a row is looked at from the end
    onward = Window.partitionBy(*s.block_keys).orderBy(F.col("_turn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def add(kind: str, name: str, value: Column, agg: Column, carry) -> tuple[str, str]:
        src, held = f"_{kind}_in_{name}", f"_{kind}_at_{name}"
        if value is not None:
            inputs.append(value.alias(src))
        aggs.append(agg.alias(held))
        carries.append(carry(F.col(held)).alias(f"_{kind}_of_{name}"))
        return src, f"_{kind}_of_{name}"

    for name, e in lags.items():
        src = f"_lag_in_{name}"
        _, got = add("lag", name, F.struct(e.alias("v")), F.max_by(F.col(src), order), lambda c: F.lag(c).over(neighbour))
        outputs[name] = F.coalesce(F.lag(src).over(w), F.col(got))["v"]
    for name, e in leads.items():
        src = f"_lead_in_{name}"
        _, got = add("lead", name, F.struct(e.alias("v")), F.min_by(F.col(src), order), lambda c: F.lead(c).over(neighbour))
        outputs[name] = F.coalesce(F.lead(src).over(w), F.col(got))["v"]
    for name, e in sums.items():
        src = f"_sum_in_{name}"
        _, got = add("sum", name, e, F.sum(src), lambda c: F.sum(c).over(before))
        outputs[name] = F.coalesce(F.col(got), F.lit(0)) + F.coalesce(F.sum(src).over(upto), F.lit(0))
    for name, e in mins.items():
        src = f"_min_in_{name}"
        _, got = add("min", name, e, F.min(src), lambda c: F.min(c).over(before))
        outputs[name] = F.least(F.col(got), F.min(src).over(upto))
    for name, e in fills.items():
        src = f"_fill_in_{name}"
        known = F.when(F.col(src).isNotNull(), order)
        _, got = add("fill", name, e, F.max_by(F.col(src), known), lambda c: F.last(c, ignorenulls=True).over(before))
        outputs[name] = F.coalesce(F.last(src, ignorenulls=True).over(upto), F.col(got))
    for name, e in befores.items():
        src = f"_bef_in_{name}"
        known = F.when(F.col(src).isNotNull(), order)
        _, got = add("bef", name, e, F.max_by(F.col(src), known), lambda c: F.last(c, ignorenulls=True).over(before))
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        outputs[name] = F.coalesce(F.last(src, ignorenulls=True).over(earlier), F.col(got))
    for name, e in next_fills.items():
        src = f"_next_in_{name}"
        known = F.when(F.col(src).isNotNull(), order)
        _, got = add("next", name, e, F.min_by(F.col(src), known), lambda c: F.last(c, ignorenulls=True).over(after))
        outputs[name] = F.coalesce(F.last(src, ignorenulls=True).over(onward), F.col(got))
    if number:
        _, got = add("num", number, None, F.count(F.lit(1)), lambda c: F.sum(c).over(before))
        outputs[number] = F.coalesce(F.col(got), F.lit(0)) + F.row_number().over(w).cast("long") - 1
    for name, (kind, e) in totals.items():
        src = f"_tot_in_{name}"
        if kind == "count":
            agg, comb = F.count(src), lambda c: F.sum(c).over(whole)
        elif kind == "sum":
            agg, comb = F.sum(src), lambda c: F.sum(c).over(whole)
        elif kind == "min":
            agg, comb = F.min(src), lambda c: F.min(c).over(whole)
        elif kind == "max":
            agg, comb = F.max(src), lambda c: F.max(c).over(whole)
        elif kind == "first":
            agg, comb = F.min_by(F.col(src), order), lambda c: F.min_by(c, F.col(BLOCK)).over(whole)
        elif kind == "last":
            agg, comb = F.max_by(F.col(src), order), lambda c: F.max_by(c, F.col(BLOCK)).over(whole)
        else:
            raise ValueError(kind)
        _, got = add("tot", name, e, agg, comb)
        outputs[name] = F.col(got)

    rows = rows.select("*", *inputs)
    stepped = steps or {}
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    for name, e in stepped.items():
        at, run = f"_step_at_{name}", f"_step_run_{name}"
        rows = rows.withColumn(at, e.at)
        rows = rows.withColumn(f"_step_prev_{name}", F.last(at, ignorenulls=True).over(earlier))
        own = F.when(F.col(at).isNotNull() & F.col(f"_step_prev_{name}").isNotNull(), e.between(F.col(f"_step_prev_{name}"), F.col(at)))
        rows = rows.withColumn(run, F.sum(F.coalesce(own, F.lit(0))).over(upto)).withColumn(f"_step_on_{name}", F.coalesce(at, f"_step_prev_{name}").isNotNull())
        if e.before:
            rows = rows.withColumn(f"_step_was_{name}", F.lag(F.struct(F.col(run).alias("run"), F.col(f"_step_on_{name}").alias("on"))).over(w))
        known = F.when(F.col(at).isNotNull(), order)
        aggs += [F.min_by(at, known).alias(f"_step_first_{name}"), F.max_by(at, known).alias(f"_step_last_{name}"), F.max_by(run, order).alias(f"_step_sum_{name}")]
        carries += [F.col(f"_step_{c}_{name}") for c in ("first", "sum")] + [F.last(f"_step_last_{name}", ignorenulls=True).over(before).alias(f"_step_came_{name}")]
    borders = rows.groupBy(*s.block_keys).agg(*aggs).select(*s.block_keys, *carries)
    for name, e in stepped.items():
        came = F.col(f"_step_came_{name}")
        came = came if e.start is None else F.coalesce(came, e.start)
        link = F.when(came.isNotNull() & F.col(f"_step_first_{name}").isNotNull(), e.between(came, F.col(f"_step_first_{name}")))
        borders = borders.withColumn(f"_step_link_{name}", F.coalesce(link, F.lit(0)))
        # the same sums in the same order as on rows, so that the last row of a block and the next block's start agree to the bit
        borders = borders.withColumn(f"_step_base_{name}", F.sum(F.col(f"_step_link_{name}") + F.col(f"_step_sum_{name}")).over(before))
        value = lambda run, on, n=name: F.coalesce(F.col(f"_step_base_{n}"), F.lit(0)) + (F.when(on, F.col(f"_step_link_{n}")).otherwise(0) + run)
        outputs[name] = value(F.col(f"_step_run_{name}"), F.col(f"_step_on_{name}"))
        if e.before:
            was = F.col(f"_step_was_{name}")
            outputs[e.before] = F.when(was.isNotNull(), value(was["run"], was["on"])).otherwise(F.col(f"_step_base_{name}"))
    joined = rows.join(borders, s.block_keys)
    if next_fills:
        joined = joined.withColumn("_turn", F.row_number().over(w))
    kept = [c for c in df.columns if c not in outputs]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[e.alias(n) for n, e in outputs.items()])


def index_rows(df: DataFrame, keys, order, name: str = "pos") -> DataFrame:
    """Dense 0-based position per series for order columns of any type.

    Rows are range-partitioned on (keys, order), which balances hot series, and
    numbered inside each range; per-range counts give the offsets. The ranged rows
    are checkpointed first so that the ranges stay the same on a retry.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    ranged = cut(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    )
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    )
    return (
        ranged.join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_range", "_at", "_first", "_before")
    )


def with_halo(df: DataFrame, s: Series, back, ahead, chunk: int = 8_192) -> DataFrame:
    """Copy rows so that every chunk of ``chunk`` positions also holds its neighbours.

    Adds _pos (dense position), _len (rows in the series), _chunk and _core (true on
    the one copy that belongs to the chunk). Chunk c sees positions from
    ``c*chunk - back`` to ``(c+1)*chunk - 1 + ahead``.
    """
    n = scan(df, s, number="_pos", totals={"_len": ("count", F.lit(1))})
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    first = F.floor(F.greatest(F.col("_pos") - as_col(ahead), F.lit(0)) / chunk)
    last = F.floor(F.least(F.col("_pos") + as_col(back), F.col("_len") - 1) / chunk)
    spread = n.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return spread.withColumn("_core", F.col("_chunk") == F.floor(F.col("_pos") / chunk))
