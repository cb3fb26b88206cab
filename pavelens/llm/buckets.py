"""Comparing the members of buckets in bounded blocks, with results per member instead of per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Members, and units of their weight, that one block of a bucket holds at most; a task compares two blocks.
BLOCK_ROWS = 2048
BLOCK_WEIGHT = 1 << 20


def blocks(members: DataFrame, bucket: list[str], member: str, weight: str | None = None) -> DataFrame:
    """``members`` of buckets of two or more, with ``_i`` and ``_j``: the two blocks that meet where the row goes, and ``_b``, its own.

    A bucket of n blocks sends each member to n pairs of blocks, so every two members meet once (twice inside one block's row, as the same
    rows) and no task gets a whole large bucket.
    """
    w = F.sum(weight) if weight else F.lit(0)
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(w / BLOCK_WEIGHT), F.lit(1)).cast("int")
    sizes = members.groupBy(*bucket).agg(n.alias("_nb"), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    mine = members.join(sizes, bucket).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
    other = mine.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return other.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o", "_nb")


def by_group(df: DataFrame, group: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over the rows of each group; many small groups share a task's batches. A group is held as a whole."""
    small = [c for c in df.columns if c in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.zeros(batch.num_rows, bool)
            head[0] = True
            for c in small:
                col = batch.column(c).to_numpy(zero_copy_only=False)
                head[1:] |= col[1:] != col[:-1]
            cuts = [*np.flatnonzero(head).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own = tuple(batch.column(c)[lo].as_py() for c in small)
                if held and own != name:
                    got = fn(pa.Table.from_batches(held))
                    held = []
                    if got is not None:
                        yield got
                name = own
                held.append(batch.slice(lo, hi - lo))
        if held:
            got = fn(pa.Table.from_batches(held))
            if got is not None:
                yield got

    return df.repartition(*group).sortWithinPartitions(*group).mapInArrow(lean(run), schema)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable by links (a, b) from each of n numbers."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        on = root[a] != root[b]
        a, b = a[on], b[on]
        if not on.any() and (root[root] == root).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root
