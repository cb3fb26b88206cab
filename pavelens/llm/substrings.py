"""Repeated passages of live event messages: a count-min sketch first, exact groups for what it cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, need
from .words import Words, gathered, mix, ragged, split, windows

WINDOW = 13
#: Words of the anchors that stand for windows in the sketch.
ANCHOR = 5
SLICE = 2 << 20
#: Cells of the merged sketch, half for each of its two rows: one bit a cell, 64 MB, goes to the tasks, whatever the input.
CELLS = 1 << 29
_BLOCK = 1 << 20


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window's first word, window's anchor number, hash of each anchor) for every window of WINDOW words.

    The anchor of a window is its run of ANCHOR words with the smallest hash, the leftmost of equals. Equal windows have equal anchors at
    equal places inside, so an anchor occurs at least as often as any window that it stands for.
    """
    h, at = windows(words, ANCHOR, seed=3)
    span = WINDOW - ANCHOR + 1
    n = len(words.hash)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    full[at] = h
    start = np.flatnonzero(words.row[: n - WINDOW + 1] == words.row[WINDOW - 1 :])
    low, where = full[: n - span + 1].copy(), np.zeros(n - span + 1, np.int8)
    for i in range(1, span):
        less = full[i : n - span + 1 + i] < low
        low[less] = full[i : n - span + 1 + i][less]
        where[less] = i
    place = start + where[start]
    spot, number = np.unique(place, return_inverse=True)
    return start, number, full[spot]


def _cells(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each hash in the two rows of the sketch."""
    half = np.uint64(cells // 2)
    return [h % half, half + (h >> np.uint64(32)) % half]


def _part_sketch(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block, packed counts) of one slice; a count is 1 or 2, for more is not asked."""
    spot, count = np.unique(cells, return_counts=True)
    block = (spot // np.uint64(_BLOCK)).astype(np.int64)
    for b, lo, hi in zip(*_ranges(block)):
        inside = (spot[lo:hi] % np.uint64(_BLOCK)).astype(np.int64)
        twice = np.minimum(count[lo:hi], 2) - 1
        gaps = np.diff(inside * 2 + twice, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4)
        yield int(b), zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def _ranges(sorted_: np.ndarray):
    value, lo = np.unique(sorted_, return_index=True)
    return value, lo, np.append(lo[1:], len(sorted_))


def repeated_cells(messages: DataFrame, message: str, firsts: Broadcast, cells: int = CELLS) -> np.ndarray:
    """One bit per cell of the merged sketch of ``messages``: whether its count is above one. Copies that ``firsts`` rules out do not count."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(_first_copies(batches, firsts.value), message, SLICE):
            _, _, h = anchors(split(batch.column(message), "visible"))
            yield _parts(np.concatenate(_cells(h, cells)))

    return merged_bits(messages.mapInArrow(sketch, "block int, part binary"), cells)


def first_copies(named: DataFrame, cells: int) -> np.ndarray:
    """A Bloom filter of (text, key) of the first copy of every text, of two bits each: what it does not hold is a later copy."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(np.concatenate(_cells(mix(batch.column("_copy").to_numpy().view(np.uint64)), cells)))
            yield _parts(np.repeat(h, 2))

    first = named.groupBy("_name", "_text").agg(F.min("_key").alias("_key")).select(F.xxhash64("_name", "_text", "_key").alias("_copy"))
    return merged_bits(first.mapInArrow(mark, "block int, part binary"), cells)


def _first_copies(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(held(mix(batch.column("_copy").to_numpy().view(np.uint64)), bits)))


def merged_bits(parts: DataFrame, cells: int) -> np.ndarray:
    """Adds up part sketches block by block on Spark; only one bit per cell, whether its count is above one, comes to the driver."""

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        done: int | None = None
        for batch in parts:  # sorted by block, so one block is open at a time
            for b, blob in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
                if b != done and done is not None:
                    yield _bits(done, counts.pop(done))
                done = b
                count = counts.setdefault(b, np.zeros(_BLOCK, np.uint8))
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
                code = np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64))
                count[code // 2] = np.minimum(2, count[code // 2] + 1 + code % 2)
        if done is not None:
            yield _bits(done, counts.pop(done))

    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary").toArrow()
    out = np.zeros(cells // 8, np.uint8)
    for b, bits in zip(merged.column("block").to_pylist(), merged.column("bits").to_pylist()):
        got = np.frombuffer(bits, np.uint8)[: max(0, len(out) - b * _BLOCK // 8)]
        out[b * _BLOCK // 8 : b * _BLOCK // 8 + len(got)] = got
    return out


def _parts(cells: np.ndarray) -> pa.RecordBatch:
    parts = list(_part_sketch(cells))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["block", "part"])


def _bits(block: int, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])


def held(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bits of both rows are set: the sketch's estimate, the smaller of two, is above one. Never false for what occurs twice."""
    yes = np.ones(len(h), bool)
    for cell in _cells(h, len(bits) * 8):
        yes &= (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return yes


def remove_repeated_passages(events: DataFrame, key: str = "event_id", message: str = "message", cells: int = CELLS) -> DataFrame:
    """Messages without the words of passages that a message with a smaller key has too.

    Words are runs of bytes other than white space (space, tab to carriage return), unchanged; a window is 13 consecutive words of one message. A word goes if a window over it also starts
    in a message with a smaller key; windows are judged on the input. Returns per row of ``events``: ``key``, ``n_words``, ``n_removed``
    (long) and ``kept`` (the other words joined by one space).

    How: exact copies of a whole message are found by its hash; a fixed-size filter of the first copies keeps later ones, which lose all their
    words, out of the rest. Partition sketches of anchors, five-word runs that stand for windows, are added up to a count-min sketch that never
    underestimates a window; windows estimated at two or more are grouped exactly by 96 bits of hash: smallest and largest key per
    window (combined before the shuffle, so a passage of a third of all rows is cheap), then a join back to its places, which may be split. The sketch
    has a fixed size: with far more input than cells it lets more windows through, and the groups stay exact.

    Null and empty messages have no words; rows with a null key have no smaller or larger key: they keep all words and remove
    none elsewhere. Repeated rows with one key do not remove each other. An empty table gives none; further columns are ignored.
    """
    free(key, "n_words", "n_removed", "kept")
    rows = need(events, key, message).withColumn("_text", F.hash(message))  # tells rows of one key apart
    kind = rows.schema[key].dataType.simpleString()
    context = rows.sparkSession.sparkContext
    own = F.col(f"`{key}`")
    keyed = rows.where(own.isNotNull() & F.col(f"`{message}`").isNotNull()).withColumn("_name", F.xxhash64(message))
    named = keyed.select(own.alias("_key"), "_name", "_text")
    firsts = context.broadcast(first_copies(named, max(1 << 16, cells >> 3)))
    marked = keyed.select(own.alias("_key"), "_text", F.col(f"`{message}`").alias("_message"), F.xxhash64("_name", "_text", own).alias("_copy"))
    bits = context.broadcast(repeated_cells(marked.select("_message", "_copy"), "_message", firsts, cells))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(_first_copies(batches, firsts.value), "_message", SLICE):
            words = split(batch.column("_message"), "visible")
            start, number, h = anchors(words)
            start = start[held(h, bits.value)[number]]
            a, at = windows(words, WINDOW, seed=0)
            b, _ = windows(words, WINDOW, seed=1)
            where = np.searchsorted(at, start)
            # a window that a message repeats inside goes once
            _, once = np.unique(a[where] ^ mix(words.row[start].astype(np.uint64)), return_index=True)
            start, where = start[once], where[once]
            row = words.row[start]
            pos = (start - words.first[row]).astype(np.int32)
            for lo in range(0, len(start), 50_000):
                s = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(row[s])), batch.column("_text").take(pa.array(row[s])), pa.array(a[where[s]].view(np.int64)), pa.array((b[where[s]] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(pos[s])],
                    ["_key", "_text", "_a", "_b", "_pos"],
                )

    found = marked.mapInArrow(suspects, f"_key {kind}, _text int, _a bigint, _b int, _pos int")
    first = found.groupBy("_a", "_b").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last")).where("_first < _last").select("_a", "_b", "_first")
    later = found.join(first, ["_a", "_b"]).where("_key > _first").select("_key", "_text", "_pos")
    # all of a later copy goes: place -1
    least = named.groupBy("_name", "_text").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last")).where("_first < _last").drop("_last")
    copies = named.join(least, ["_name", "_text"]).where("_key > _first").select("_key", "_text", F.lit(-1).alias("_pos"))
    # a message's places are as many as its words; equal rows of one key agree on them
    places = later.unionByName(copies).groupBy("_key", F.col("_text").alias("_of")).agg(F.collect_set("_pos").alias("_at"))
    cover = rows.join(places, (own == F.col("_key")) & (F.col("_text") == F.col("_of")), "left").select(own, f"`{message}`", "_at")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, message, SLICE):
            words = split(batch.column(message), "visible")
            lists = batch.column("_at")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False))
            place = lists.flatten().to_numpy()
            a, at = windows(words, WINDOW, seed=0)
            a ^= mix(words.row[at].astype(np.uint64))
            spot = np.searchsorted(at, words.first[row] + place)
            ok = (place >= 0) & (words.first[row] + place + WINDOW <= words.first[1:][row])
            touched = np.zeros(batch.num_rows, bool)
            touched[row[ok]] = True
            some = np.flatnonzero(touched[words.row[at]])
            gone_at = at[some[np.isin(a[some], a[spot[ok]])]]
            whole = np.zeros(batch.num_rows, bool)
            whole[row[place < 0]] = True
            edge = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(edge, gone_at, 1)
            np.add.at(edge, gone_at + WINDOW, -1)
            gone = (np.cumsum(edge[:-1]) > 0) | (whole & (words.counts >= WINDOW))[words.row]
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[words.first[1:]] - total[words.first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), _joined(words, ~gone)], [key, "n_words", "n_removed", "kept"]
            )

    return cover.mapInArrow(remove, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string")


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Per row the kept words with one space between them."""
    at = np.flatnonzero(keep)
    row = words.row[at]
    length = words.end[at] - words.start[at]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    size = length + ~last  # a word and the space behind it
    out = np.full(int(size.sum()), 0x20, np.uint8)
    out[ragged(np.cumsum(size) - size, length)] = words.data[ragged(words.start[at], length)]
    per_row = np.bincount(row, weights=size, minlength=words.n_rows).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.StringArray.from_buffers(words.n_rows, pa.py_buffer(off), pa.py_buffer(out))
