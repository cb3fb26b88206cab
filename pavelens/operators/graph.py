"""Connected components and one-to-one matching as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .joins import salted_join

#: Rounds before what is left is looked at by component, and pairs of a component that one task scans in order.
ROUNDS = 3
PAIRS_IN_ORDER = 1_000_000


def connected_components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Smallest reachable id per node, for every node that has an edge.

    ``edges`` is (keys..., u, v); components never cross keys. Alternates two steps
    that replace edges by edges to a neighbourhood minimum: first from larger
    neighbours, then from smaller ones, until nothing moves. Both steps are
    aggregates and joins; a hub node is salted, not collected.
    """
    keys = list(keys or [])
    node = [*keys, "u"]
    cols = [*keys, "u", "v"]
    cur = cut(
        edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    seen = _digest(cur)
    while True:
        both = cur.unionByName(cur.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*node).agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = (
            salted_join(both, low.select(*node, "m"), node, counts=low.select(*node, "_n"), rows=2 * seen[0])
            .where("v > u")
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = cut(large)
        low = large.groupBy(*node).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = (
            salted_join(large, low.select(*node, "m"), node, counts=low.select(*node, "_n"), rows=2 * seen[0])
            .select(*keys, F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(*keys, F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        cur = cut(small)
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(*keys, F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(df: DataFrame):
    return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()


def fold_pairs(pairs: DataFrame, group: list[str], order: list[str], choose: Callable, schema: str) -> DataFrame:
    """One pass over the pairs (a, b, ...) of every group, in order.

    ``choose(row)`` sees a pair of two nodes that no earlier pair of the group has spent, and returns those of them that it spends.
    Pairs stream through a task sorted; only spent nodes are held. Returned are the pairs that spent nodes, with those nodes as ``spent``.
    """
    columns = pairs.columns
    at = [columns.index(c) for c in group]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, spent = None, set()
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                name = tuple(row[i] for i in at)
                if name != own:
                    own, spent = name, set()
                if row.a in spent or row.b in spent:
                    continue
                gone = choose(row)
                if gone:
                    spent.update(gone)
                    out.append((*row, list(gone)))
            yield pd.DataFrame(out, columns=[*columns, "spent"])

    return pairs.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def greedy_match(pairs: DataFrame, keys: list[str] | None = None, in_order: int = PAIRS_IN_ORDER) -> DataFrame:
    """Closest-first one-to-one matching of (a, b, dist).

    A pair that is the smallest, by (dist, a, b), at both of its ends is what the
    greedy scan would take; taking all such pairs and repeating gives the same result.
    Pairs that tie, such as those of a parked vehicle, form long chains: after a few rounds what is left falls
    into components, those of up to ``in_order`` pairs are scanned in order, one task each, and only larger ones go on in rounds.
    """
    keys = list(keys or [])
    order = F.struct("dist", "a", "b")
    open_, taken = cut(pairs.select(*keys, "a", "b", "dist")), None
    while not open_.isEmpty():
        for _ in range(ROUNDS):
            ends = open_.select(*keys, F.explode(F.array("a", "b")).alias("node"), "a", "b", "dist")
            best = ends.groupBy(*keys, "node").agg(F.min(order).alias("_m"))
            won = cut(
                best.groupBy(*keys, F.col("_m.dist").alias("dist"), F.col("_m.a").alias("a"), F.col("_m.b").alias("b"))
                .agg(F.count(F.lit(1)).alias("_c"))
                .where(F.col("_c") == 2)
                .select(*keys, "a", "b", "dist")
            )
            taken = won if taken is None else taken.unionByName(won)
            used = won.select(*keys, F.explode(F.array("a", "b")).alias("node"))
            free = open_
            for end in ("a", "b"):
                free = free.join(used.withColumnRenamed("node", end), [*keys, end], "left_anti")
            open_ = cut(free)
        if open_.isEmpty():
            break
        parts = connected_components(open_.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), keys)
        labelled = cut(open_.join(parts.withColumnRenamed("node", "a"), [*keys, "a"]))
        small = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= in_order).drop("_n")
        ready = labelled.join(small, [*keys, "component"], "left_semi")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)
        node = ready.schema["a"].dataType.simpleString()
        won = fold_pairs(ready, [*keys, "component"], ["dist", "a", "b"], lambda row: (row.a, row.b), f"{fields}, spent array<{node}>")
        taken = taken.unionByName(won.select(*keys, "a", "b", "dist"))
        open_ = cut(labelled.join(small, [*keys, "component"], "left_anti").select(*keys, "a", "b", "dist"))
    return taken if taken is not None else open_
