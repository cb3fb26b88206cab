"""Vectorised splitting and hashing of whole text columns inside Arrow batches.

A text column is one byte buffer with offsets. A table of 256 classes says which bytes belong
to a word, so words of every row are found with a few array operations and no loop over rows.
Prefix sums of a keyed polynomial give every word a 64-bit hash the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _table(keep: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word membership per byte and a random odd 64-bit value per (folded) byte."""
    member = np.zeros(256, bool)
    member[list(keep)] = True
    value = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        value[65:91] = value[97:123]
    return member, value


ALNUM = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
VISIBLE = bytes(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: ``alnum``: digits, A-Z taken as a-z, and everything beyond ASCII. ``visible``: all but white space.
#: ``chunk``: as visible with A-Z taken as a-z, and full stops, commas and the like apart where that is safe.
KINDS = {"alnum": _table(ALNUM, True), "visible": _table(VISIBLE, False), "chunk": _table(VISIBLE, True)}
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
_PLAIN = np.zeros(256, bool)  # ASCII letters and digits
_PLAIN[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown per process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            more = min(done, size - done)
            have[done : done + more] = have[:more] * step
            done += more
        _POWERS[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of consecutive texts: byte range in ``data``, row of each word, hash, words before each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    n_rows: int

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every longest run of member bytes inside one row."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = member[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]])
    return np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))


#: Bytes that are looked at in one go; a longer row makes a longer block.
BLOCK_BYTES = 2 << 20


def split(texts: pa.Array, kind: str) -> Words:
    """Words of all texts. Rows are split in blocks, so that the arrays as long as the bytes stay small."""
    data, off = buffers(texts)
    rows = len(off) - 1
    found, lo = [], 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, side="right")) - 1)
        start, end, hashes = _split_block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], kind)
        found.append((start + off[lo], end + off[lo], hashes))
        lo = hi
    if len(found) == 1:
        start, end, hashes = found[0]
    else:
        start, end, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    del found
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(data, start, end, row, hashes, first, rows)


def _split_block(data: np.ndarray, off: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    member, value = KINDS[kind]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = member[data]
    edge = np.zeros(n + 1, bool)  # a word never crosses from one row into the next
    edge[off] = True
    if kind == "chunk":
        edge |= _stops_apart(data, inside, edge)
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    hashes = _hash(data, value, start, end)
    if kind == "chunk":  # special tokens of tokenizers are told apart by case
        for i in np.unique(np.searchsorted(start, np.flatnonzero(data == 0x7C), side="right") - 1):
            hashes[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return start, end, hashes


def _stops_apart(data: np.ndarray, inside: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Borders around runs of stops whose neighbours are plain letters, digits, white space or a row's border.

    Tokenizers that split letters, digits and other signs from each other cut there in any case.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if not n:
        return cut
    stop = np.zeros(n + 1, bool)
    stop[:n] = _STOPS[data]
    was = np.concatenate([[False], stop[:-1]])
    start = np.flatnonzero(stop & (~was | edge))
    end = np.flatnonzero(was & (~stop | edge))
    plain = np.zeros(n + 1, bool)
    plain[:n] = _PLAIN[data]
    left = np.maximum(start - 1, 0)
    latin = (data[left] >= 0x80) & (data[left] != 0x97) & (data[left] != 0xB7) & (data[left] < 0xC0) & (data[np.maximum(start - 2, 0)] == 0xC3)
    ok = (edge[start] | ~inside[left] | plain[left] | latin) & (edge[end] | ~inside[end] | plain[end])
    cut[start[ok]] = True
    cut[end[ok]] = True
    return cut


def _hash(data: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keyed polynomial of each byte range, freed of its place by the inverse power; then mixed with the length."""
    out = np.empty(len(start), np.uint64)
    block = 1 << 18  # bytes, so that temporaries and powers stay small
    lo = 0
    while lo < len(start):
        hi = min(len(start), max(lo + 1, int(np.searchsorted(start, start[lo] + block))))
        a, b = int(start[lo]), int(end[hi - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(value[data[a:b]] * powers(_POLY, b - a), out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * powers(pow(_POLY, -1, 1 << 64), b - a + 1)[s]
        lo = hi
    return mix(out + (end - start).astype(np.uint64) * _MULT)


def windows(words: Words, size: int, seed: int = 0, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``size`` words inside one row, in order.

    With ``short``, a row of fewer words, but not none, gives one window of all its words.
    """
    h = mix(words.hash + np.uint64((seed * 0xA24BAED4963EE407) & _MASK)) if seed else words.hash
    n = len(h)
    base = (_POLY + 2 * seed + 2) & _MASK | 1
    acc = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        acc += h[i : n - size + 1 + i] * np.uint64(pow(base, i, 1 << 64))
    at = np.flatnonzero(words.row[: n - size + 1] == words.row[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    got = mix(acc[at])
    if short:
        counts = words.counts
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            extra = np.array([_run(h[words.first[r] : words.first[r + 1]], base) for r in few], np.uint64)
            at = np.concatenate([at, words.first[few]])
            order = np.argsort(at, kind="stable")
            at, got = at[order], np.concatenate([got, extra])[order]
    return got, at


def _run(h: np.ndarray, base: int) -> np.uint64:
    acc = np.zeros(1, np.uint64)
    for i in range(len(h)):
        acc += h[i : i + 1] * np.uint64(pow(base, i, 1 << 64))
    return mix(acc + np.array([len(h)], np.uint64) * _MULT)[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, cut where the text column reaches ``limit`` bytes, so that memory does not follow batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes: small batches are joined, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, column, limit):
        data, _ = buffers(part.column(column))
        if held and size + len(data) > limit:
            yield _concat(held)
            held, size = [], 0
        held.append(part)
        size += len(data)
    if held:
        yield _concat(held)


def _concat(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(length) - length
    return np.repeat(start - skip, length) + np.arange(total)
