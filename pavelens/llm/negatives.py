"""Hard negatives among feature vectors of detections: exact integer scores by Strassen products, kept in mergeable heaps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, need, stage

#: Rows of a candidate block, of an anchor block, blocks of candidates that one task goes through, and side at which a product is no longer split.
CANDIDATES, ANCHORS, SHARD_BLOCKS = 4096, 512, 4
LEAF = 16
#: Tasks of a pass; with more pairs of shards and bundles a task gets several.
MOST_TASKS = 10_000
#: Components that a block holds, so that very long vectors make blocks of fewer rows.
BLOCK_NUMBERS = 4 << 20
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by Strassen's seven products, odd sides padded with a zero row or column.

    Additions and products wrap modulo 2**64 alike, so the result is exact wherever it fits 64 bits.
    """
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
    if k % 2 or m % 2:
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((2 * i, 2 * l), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:i, :l] = p
    out[i:, l:] = p
    p = strassen(a21 + a22, b11, leaf)
    out[i:, :l] = p
    out[i:, l:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:i, l:] = p
    out[i:, l:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:i, :l] += p
    out[i:, :l] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:i, :l] -= p
    out[:i, l:] += p
    out[i:, l:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:i, :l] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:n, :m]


class Heaps:
    """The ``size`` best (score, id) of every slot: higher scores first, ties by smaller id, an id once by its best score.

    Two sets of heaps merge into the heaps of both, in any order.
    """

    def __init__(self, slots: int, size: int) -> None:
        self.size = size
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(slots, NONE)  # no lower score can enter a full slot

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, id_ = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((~score, id_, slot))  # ~ reverses order and, other than minus, cannot overflow
        slot, score, id_ = slot[order], score[order], id_[order]
        once = np.concatenate([[True], (slot[1:] != slot[:-1]) | (id_[1:] != id_[:-1])])
        slot, score, id_ = slot[once], score[once], id_[once]
        order = np.lexsort((id_, ~score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.size
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]
        last = np.flatnonzero(np.arange(len(slot)) - first == self.size - 1)
        self.least[slot[last]] = score[last]


def _top(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries where ``ok`` that may be among the ``k`` best of their row, all ties included."""
    some = np.flatnonzero(ok.any(1))
    if not len(some):
        return some, some
    s = np.where(ok[some], scores[some], NONE)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        good = ok[some] & (s >= kth[:, None])
    else:
        good = ok[some]
    r, c = np.nonzero(good)
    return some[r], c


def _pack(vectors: np.ndarray) -> bytes:
    top = int(np.abs(vectors).max()) if vectors.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind.encode() + vectors.astype(kind).tobytes()


def _unpack(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob[3:], blob[:3].decode()).reshape(rows, -1 if len(blob) > 3 else 0).astype(np.int64)


def integer_vectors(detections: DataFrame, det: str, label: str, vector: str, anchor: str, scale: float) -> DataFrame:
    """(_det, _label, _dim, _anchor, _v): rows that take part, components as floor(scale * x)."""
    x = F.transform(f"`{vector}`", lambda c: c.cast("double"))
    rows = detections.select(F.col(f"`{det}`").cast("bigint").alias("_det"), F.col(f"`{label}`").alias("_label"), F.coalesce(F.col(f"`{anchor}`"), F.lit(False)).alias("_anchor"), x.alias("_x"))
    # nulls, NaN and infinities fail the bound too
    rows = rows.where(F.col("_det").isNotNull() & F.col("_label").isNotNull() & F.forall("_x", lambda c: F.coalesce(F.abs(c) < 2.0**31, F.lit(False))))
    rows = rows.withColumn("_v", F.transform("_x", lambda c: F.floor(c * scale).cast("bigint"))).drop("_x")
    length = F.aggregate("_v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    # scores of any two vectors that are shorter than 2**31 fit 64 bits
    return rows.where(length < 2.0**62).withColumn("_dim", F.size("_v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one dimension packed by ``size``: one row per block, ordered by id inside, dealt by what it holds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            part = sorted(held.pop(dim), key=lambda r: (r[0], r[1]))
            v = np.array([r[2] for r in part], np.int64).reshape(len(part), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([[r[0] for r in part]], pa.list_(pa.int64())), pa.array([[r[1] for r in part]], pa.list_(label)), pa.array([_pack(v)], pa.binary())],
                ["_dim", "_dets", "_labels", "_vectors"],
            )

        for batch in batches:
            label = batch.column("_label").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("_det", "_label", "_v"))):
                mine = held.setdefault(len(row[2]), [])
                mine.append(row)
                if len(mine) >= min(size, BLOCK_NUMBERS // max(1, len(row[2]))):
                    yield block(len(row[2]))
        for dim in list(held):
            yield block(dim)

    kind = rows.schema["_label"].dataType.simpleString()
    return rows.select("_det", "_label", "_v").mapInArrow(pack, f"_dim int, _dets array<bigint>, _labels array<{kind}>, _vectors binary")


def _labels(table: pa.Table, i: int) -> np.ndarray:
    return np.array(table.column("_labels")[i].as_py(), object)


def _score(anchors: pa.Table, candidates: pa.Table, heaps_of: Callable, take: Callable) -> Iterator:
    """Goes through all tiles of the blocks that meet here; ``take`` puts a tile's entries into the heaps of its anchor block."""
    for a in range(anchors.num_rows):
        ids, labels = np.array(anchors.column("_dets")[a].as_py(), np.int64), _labels(anchors, a)
        left = _unpack(anchors.column("_vectors")[a].as_py(), len(ids))
        heaps = heaps_of(a, len(ids))
        for c in range(candidates.num_rows):
            own = np.array(candidates.column("_dets")[c].as_py(), np.int64)
            right = _unpack(candidates.column("_vectors")[c].as_py(), len(own))
            scores = strassen(left, np.ascontiguousarray(right.T))
            alike = np.equal.outer(*_numbered(labels, _labels(candidates, c)))
            take(heaps, scores, alike, ids, own)
        yield a, heaps


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number: dict = {}
    return tuple(np.array([number.setdefault(x, len(number)) for x in side.tolist()], np.int64) for side in (a, b))


PIECE = "_dim int, _group bigint, _slots array<int>, _scores array<bigint>, _ids array<bigint>"


def _piece(dim: int, group: int, heaps: Heaps) -> tuple:
    return dim, group, heaps.slot.astype(np.int32), heaps.score, heaps.id


def _table(pieces: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    cols = list(zip(*pieces)) or [()] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["_dim", "_group", "_slots", "_scores", "_ids"])


def _merged(pieces: DataFrame, slots: int, size: int) -> DataFrame:
    """One row of heaps per anchor block: pieces stream into it one by one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heaps = None, None
        for batch in batches:
            for dim, group, slot, score, id_ in zip(*(batch.column(c) for c in ("_dim", "_group", "_slots", "_scores", "_ids"))):
                name = (dim.as_py(), group.as_py())
                if name != own:
                    if heaps is not None:
                        yield from _table([_piece(*own, heaps)]).to_batches()
                    own, heaps = name, Heaps(slots, size)
                heaps.add(*(x.values.to_numpy().astype(np.int64) for x in (slot, score, id_)))
        if heaps is not None:
            yield from _table([_piece(*own, heaps)]).to_batches()

    return pieces.repartition("_dim", "_group").sortWithinPartitions("_dim", "_group").mapInArrow(merge, PIECE)


def window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest integer n with 50 * score <= 100 * n <= 95 * score, without overflow."""
    return -((-score) // 2), (score // 20) * 19 + (score % 20) * 19 // 20


def mine_hard_negatives(
    detections: DataFrame, det: str = "det_id", label: str = "class_name", vector: str = "embedding", anchor: str = "is_anchor", positives: int = 5, negatives: int = 3,
    scale: float = 256.0, candidates: int = CANDIDATES, anchors: int = ANCHORS, shard_blocks: int = SHARD_BLOCKS,
) -> DataFrame:
    """Hard negatives of detections with a feature vector, for training an embedding of defects.

    Components are taken as floor(``scale`` * x), a row's score is its exact integer inner product with the anchor. An anchor's positives are the first ``positives`` other detections
    of its class, higher scores first, ties by smaller ``det``. For each, the negatives are the first ``negatives`` detections of other classes with
    50 * positive score <= 100 * score <= 95 * positive score. Returns ``anchor_id``, ``positive_id`` (long), ``rank`` (int, from 1), ``negative_id``, ``positive_score``, ``negative_score`` (long).

    How: every row is packed into blocks of ``candidates``, the rows where ``anchor`` is true also into blocks of ``anchors``. Each task multiplies anchor
    blocks with a shard of candidate blocks by Strassen's recursion on int64 and puts the entries into heaps; heaps of all shards merge as a stream. A first pass finds positives,
    a second fills the score window of each. Only heaps leave a task, never pairs; nothing is grouped by class, so a common class is no hot key. The work is
    anchors x detections by definition.

    Rows with a null ``det``, class, vector or ``anchor`` flag: the first three take no part, a null flag is false; vectors with a null or non-finite component, or so large that a score could
    exceed 64 bits (length of 2**31 or more after scaling), take no part. Vectors of different length have no score. Rows that repeat a ``det`` count once, as the best of their
    scores that can count; a repeated anchor is taken once (its smallest class and vector). Empty vectors score 0. An empty table gives none; further columns are ignored. ``det`` must be an integer.
    """
    free(det, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    rows = integer_vectors(need(detections, det, label, vector, anchor), det, label, vector, anchor, scale)
    pool = stage(_blocks(rows, candidates), "negatives-pool")
    queries = rows.where("_anchor").groupBy("_det").agg(F.min(F.struct("_label", "_v", "_dim")).alias("_r")).select("_det", "_r.*")
    asked = stage(_blocks(queries, anchors), "negatives-anchors")
    asked = stage(asked.withColumn("_group", F.xxhash64("_dim", "_dets")), "negatives-groups")
    # candidate blocks are dealt into shards, anchor blocks into bundles: each pair of both meets in one task
    n_pool, n_asked = pool.count(), asked.count()
    shards, bundles = max(1, math.ceil(n_pool / shard_blocks)), max(1, math.ceil(n_asked / shard_blocks))
    deal = lambda of, n: F.pmod(F.xxhash64("_dim", "_dets", F.lit("deal")), F.lit(n)).cast("int").alias(of)
    every = lambda of, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(of)
    spread = pool.select("*", deal("_shard", shards), every("_bundle", bundles))
    keys = ["_dim", "_shard", "_bundle"]

    # a small table is much work: tasks are counted by pairs of blocks, not by bytes
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * shards * bundles, MOST_TASKS))

    def meet(left: DataFrame, fn: Callable) -> DataFrame:
        side = left.select("*", deal("_bundle", bundles), every("_shard", shards))
        return side.repartition(tasks, *keys).groupBy(*keys).cogroup(spread.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(fn, PIECE)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        def take(heaps: Heaps, scores, alike, ids, own) -> None:
            ok = alike & (ids[:, None] != own[None, :]) & (scores >= heaps.least[:, None])
            r, c = _top(scores, ok, positives if _distinct(own) else scores.shape[1])
            heaps.add(r, scores[r, c], own[c])

        got = _score(left, right, lambda a, n: Heaps(n, positives), take)
        return _table([_piece(left.column("_dim")[a].as_py(), left.column("_group")[a].as_py(), h) for a, h in got if len(h.slot)])

    best = stage(_merged(meet(asked, find), anchors, positives), "positives")
    second = asked.join(best.hint("merge"), ["_dim", "_group"])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        def heaps_of(a: int, n: int) -> tuple:
            slots, score = (np.array(left.column(c)[a].as_py(), np.int64) for c in ("_slots", "_scores"))
            return Heaps(len(slots), negatives), slots, *window(score)

        def take(held: tuple, scores, alike, ids, own) -> None:
            heaps, slots, low, high = held
            k = negatives if _distinct(own) else scores.shape[1]
            # the slots of the j-th positives of all anchors together: one row of scores each
            place = np.arange(len(slots)) - np.searchsorted(slots, slots)
            for j in range(int(place.max()) + 1 if len(place) else 0):
                at = np.flatnonzero(place == j)
                s = scores[slots[at]]
                ok = ~alike[slots[at]] & (s >= np.maximum(low[at], heaps.least[at])[:, None]) & (s <= high[at][:, None])
                r, c = _top(s, ok, k)
                heaps.add(at[r], s[r, c], own[c])

        got = _score(left, right, heaps_of, take)
        return _table([_piece(left.column("_dim")[a].as_py(), left.column("_group")[a].as_py(), h[0]) for a, h in got if len(h[0].slot)])

    filled = _merged(meet(second, fill), anchors * positives, negatives).select("_dim", "_group", F.arrays_zip("_slots", "_scores", "_ids").alias("_found"))
    named = second.select("_dim", "_group", "_dets", "_slots", "_scores", "_ids").join(filled.hint("merge"), ["_dim", "_group"])
    each = named.select("_dets", "_slots", "_scores", "_ids", F.posexplode("_found").alias("_n", "_f"), F.col("_found._slots").alias("_all"))
    # heaps come by slot and best first, so an entry's rank is its distance to the first of its slot
    rank = F.col("_n") - F.array_position("_all", F.col("_f._slots")) + 2
    at = lambda c, i: F.element_at(c, (i + 1).cast("int"))
    slot = F.col("_f._slots")
    return each.select(
        at("_dets", at("_slots", slot)).alias("anchor_id"), at("_ids", slot).alias("positive_id"), rank.cast("int").alias("rank"),
        F.col("_f._ids").alias("negative_id"), at("_scores", slot).alias("positive_score"), F.col("_f._scores").alias("negative_score"),
    )


def _distinct(ids: np.ndarray) -> bool:
    """Whether sorted ids are distinct: then the best entries of a row suffice."""
    return bool((ids[1:] != ids[:-1]).all())
