"""Test annotations that occur in training annotations: suffix arrays of training shards, searched for every test suffix."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import JUDGED, free, judge, need
from .words import Words, powers, ragged, split

WINDOW = 13
#: Base of the hashes of runs of words, odd.
RUN = 0xB5AD4ECEDA1CE2A9
#: Test text that a task searches at a time; more test items make more blocks, which every shard goes through.
BLOCK_BYTES = 32 << 20
FIELDS = "n_words bigint, n_hit bigint, items array<string>, longest bigint, longest_item string, longest_at bigint, leaked boolean"


@dataclass
class TestBlock:
    """Word hashes of some test items, one after the other, with the item and place of each word."""

    hash: np.ndarray
    first: np.ndarray
    items: list

    def __post_init__(self) -> None:
        self.vocabulary, rank = np.unique(self.hash, return_inverse=True)
        # a rank of 0 is a word that no test item has: nothing matches across it
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.step = max(1, 64 // self.bits)  # words in one 64-bit key
        self.rank = rank.astype(np.uint64) + np.uint64(1)
        length = np.diff(self.first)
        self.item = np.repeat(np.arange(len(length)), length)
        self.left = np.repeat(self.first[1:], length) - np.arange(len(self.hash))  # words from here to the item's end
        self.need = np.minimum(WINDOW, np.repeat(length, length))
        self.key = _keys(self.rank, self.item, self.bits, self.step)
        self.order = _sorted_suffixes(self.rank.astype(np.int64), self.item)
        self.sums = _prefix_sums(self.hash)


def _sorted_suffixes(rank: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Places of test words sorted by the words from there to the item's end, by doubling; a suffix comes before those that it begins."""
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    rank = np.unique(rank, return_inverse=True)[1]
    while k < n:
        second = np.full(n, -1, np.int64)
        second[: n - k] = np.where(item[: n - k] == item[k:], rank[k:], -1)
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        fresh = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        done = fresh[-1] == rank.max() and (second == -1).all()
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if done or fresh[-1] == n - 1:
            break
        k *= 2
    return order


def _prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of words."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(RUN, len(hashes)), out=out[1:])
    return out


def _common(words_sums: np.ndarray, at: np.ndarray, test_sums: np.ndarray, test: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of equal words from the places ``at`` and ``test`` on, at most ``most``, by binary search over hashes of runs."""
    inverse = powers(pow(RUN, -1, 1 << 64), max(len(words_sums), len(test_sums)))
    lo, hi = np.zeros(len(at), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = (words_sums[at + mid] - words_sums[at]) * inverse[at] == (test_sums[test + mid] - test_sums[test]) * inverse[test]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def _keys(rank: np.ndarray, row: np.ndarray, bits: int, step: int) -> np.ndarray:
    """The next ``step`` words of every place as one number; places behind the row's end count as rank 0."""
    n = len(rank)
    key = np.zeros(n, np.uint64)
    for i in range(step):
        part = np.zeros(n, np.uint64)
        if n > i:
            part[: n - i] = np.where(row[: n - i] == row[i:], rank[i:], np.uint64(0))
        key |= part << np.uint64(bits * (step - 1 - i))
    return key


def suffix_array(key: np.ndarray, rank: np.ndarray, step: int, bits: int, depth: int) -> np.ndarray:
    """Places sorted by their words, as far as ``depth`` words or the first word that no test item has.

    Places at such words are left out: no test suffix gets to them. Ties of the first key are refined key by key.
    """
    at = np.flatnonzero(rank)
    order = at[np.argsort(key[at], kind="stable")]
    low = np.uint64((1 << bits) - 1)
    group = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]])) if len(order) else order
    size = np.diff(np.append(group, len(order)))
    done = step
    while done < depth:
        # only groups that tie in full keys go on
        more = (size > 1) & ((key[np.minimum(order[group] + done - step, len(key) - 1)] & low) != 0)
        group, size = group[more], size[more]
        if not len(group):
            break
        spot = ragged(group, size)
        label = np.repeat(np.arange(len(group), dtype=np.int64), size)
        place = order[spot] + done
        k = np.where(place < len(key), key[np.minimum(place, len(key) - 1)], np.uint64(0))
        turn = np.lexsort((k, label))
        order[spot] = order[spot][turn]
        k = k[turn]
        head = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (k[1:] != k[:-1])]))
        group, size = spot[head], np.diff(np.append(head, len(spot)))
        done += step
    return order


@dataclass
class Found:
    """Windows of test texts that occur in a shard: each distinct one has an interval of ``order``, its length and the test places where it starts."""

    rank: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray
    window: np.ndarray
    test: np.ndarray


def search(words: Words, block: TestBlock) -> Found:
    """Every test suffix is searched in the shard; suffixes that begin with the same window end in the same interval."""
    none = np.zeros(0, np.int64)
    if not len(words.hash) or not len(block.hash):
        return Found(none, none, none, none, none, none, none)
    place = np.minimum(np.searchsorted(block.vocabulary, words.hash), len(block.vocabulary) - 1)
    rank = np.where(block.vocabulary[place] == words.hash, place.astype(np.uint64) + np.uint64(1), np.uint64(0))
    key = _keys(rank, words.row, block.bits, block.step)
    order = suffix_array(key, rank, block.step, block.bits, WINDOW)
    test = np.flatnonzero(block.left >= block.need)
    lo, hi = np.zeros(len(test), np.int64), np.full(len(test), len(order), np.int64)
    got = np.zeros(len(test), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(test):
        left = block.need[test] - got
        cut = np.uint64(block.bits) * np.maximum(0, block.step - left).astype(np.uint64)  # words of the key beyond the window
        want = block.key[test + got] >> cut

        def values(rows, which):
            p = order[rows] + got[which]
            k = np.where(p < len(key), key[np.minimum(p, len(key) - 1)], np.uint64(0))
            return k >> cut[which]

        lo, hi = _search(values, lo, hi, want)
        alive = lo < hi
        full = alive & (left <= block.step)
        done.append((test[full], lo[full], hi[full]))
        on = alive & ~full
        test, lo, hi, got = test[on], lo[on], hi[on], got[on] + block.step
    test, lo, hi = (np.concatenate(x) for x in zip(*done)) if done else (none, none, none)
    if not len(test):
        return Found(rank, order, none, none, none, none, none)
    each, window = np.unique(np.c_[lo, hi, block.need[test]], axis=0, return_inverse=True)
    return Found(rank, order, each[:, 0], each[:, 1], each[:, 2], window.ravel(), test)


def _search(values, lo, hi, want):
    out = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while True:
            which = np.flatnonzero(a < b)
            if not len(which):
                break
            mid = (a[which] + b[which]) // 2
            v = values(mid, which)
            go = v <= want[which] if right else v < want[which]
            a[which[go]] = mid[go] + 1
            b[which[~go]] = mid[~go]
        out.append(a)
    return out[0], out[1]


def pairs(words: Words, block: TestBlock, found: Found) -> np.ndarray:
    """(row, item) of every row that holds a window of an item, once. Windows of the same items are taken together."""
    size = found.high - found.low
    owner = np.repeat(np.arange(len(size)), size)
    row = words.row[found.order[ragged(found.low, size)]].astype(np.int64)
    item = np.unique(np.c_[found.window, block.item[found.test]], axis=0)
    cuts = np.searchsorted(item[:, 0], np.arange(len(size) + 1))
    sets: dict[bytes, int] = {}
    kind = np.array([sets.setdefault(item[a:b, 1].tobytes(), len(sets)) for a, b in zip(cuts[:-1], cuts[1:])], np.int64)
    members = [np.frombuffer(k, np.int64) for k in sets]
    held = np.unique(np.c_[kind[owner], row], axis=0)
    each = [np.c_[np.repeat(held[a:b, 1], len(m)), np.tile(m, b - a)] for m, a, b in zip(members, *(np.searchsorted(held[:, 0], np.arange(len(members)), side=s) for s in ("left", "right")))]
    return np.unique(np.concatenate(each), axis=0)


def longest(words: Words, block: TestBlock, found: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, test place, words) of the longest match of each row that has one, the first one of several.

    A place's longest match is with one of its two neighbours among the sorted test suffixes. If it is shorter than a window, the place has only whole
    short items, of which the longest counts.
    """
    size = found.high - found.low
    place, window = found.order[ragged(found.low, size)], np.repeat(np.arange(len(size)), size)
    turn = np.lexsort((-found.need[window], place))
    turn = turn[np.flatnonzero(np.diff(place[turn], prepend=-1))]
    at, window = place[turn], window[turn]
    start = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(start, found.window, found.test)
    sums = _prefix_sums(words.hash)
    left = words.first[1:][words.row[at]] - at
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(block.order), np.int64)
    rank = np.append(found.rank.astype(np.int64), 0)
    mine = np.append(block.rank.astype(np.int64), 0)
    while (low < high).any():
        mid = np.minimum((low + high) // 2, len(block.order) - 1)
        test = block.order[mid]
        n = _common(sums, at, block.sums, test, np.minimum(left, block.left[test]))
        theirs = np.where(n < left, rank[np.minimum(at + n, len(rank) - 1)], 0)
        own = np.where(n < block.left[test], mine[np.minimum(test + n, len(mine) - 1)], -1)
        on = low < high
        low, high = np.where(on & (own < theirs), mid + 1, low), np.where(on & (own >= theirs), mid, high)
    best, partner = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for near in (low - 1, low):
        ok = (near >= 0) & (near < len(block.order))
        test = block.order[np.where(ok, near, 0)]
        n = np.where(ok, _common(sums, at, block.sums, test, np.minimum(left, block.left[test])), 0)
        better = (n > best) | ((n == best) & (test < partner))
        best, partner = np.where(better, n, best), np.where(better, test, partner)
    short = best < WINDOW
    best, partner = np.where(short, found.need[window], best), np.where(short, start[window], partner)
    first = np.lexsort((at, -best, words.row[at]))
    first = first[np.flatnonzero(np.diff(words.row[at[first]], prepend=-1))]
    at, partner, best = at[first], partner[first], best[first]
    for i, (p, t, n) in enumerate(zip(at.tolist(), partner.tolist(), best.tolist())):  # hashes of runs only proposed it
        other = np.flatnonzero(words.hash[p : p + n] != block.hash[t : t + n])
        best[i] = other[0] if len(other) else n
    return at, partner, best


def find_leaked_labels(
    labels: DataFrame, test_labels: DataFrame, image: str = "image", value: str = "value", test_image: str = "image", test_value: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Label texts of training images that hold passages of the label texts of test images.

    Words are runs of ASCII letters (A-Z as a-z), digits and anything beyond ASCII. A window is 13 consecutive words of a test text, or all words of a
    shorter one; a training word inside an occurrence of a window is hit. Returns per row of ``labels``: ``image``, ``n_words``,
    ``n_hit`` (long), ``items`` (sorted distinct test images as strings), ``longest`` (words of the longest verbatim match of at least a window,
    0 if none), ``longest_item``, ``longest_at`` (its test image and first word in the training text) and ``leaked``: n_hit > 0 and 20 * n_hit >= n_words.

    How: each task sorts the suffixes of its shard of about 8 MB and searches every test suffix in it; the interval it ends in
    gives all places, once for all suffixes with the same window. The longest match of a place is with a neighbour among the sorted test suffixes, its length found by binary search. Test texts go to the tasks in blocks of at most ``block_bytes``, so that no broadcast grows
    with them; training rows are not shuffled, and a passage that many rows share costs only its hits.

    Null or empty texts have no words and no hits, a null test image is left out of ``items`` but its hits count; repeated rows and null keys are
    kept, an empty table on either side gives no hits; further columns are ignored.
    """
    free(image, *StructType.fromDDL(FIELDS).names)
    rows = need(labels, image, value)
    return _judged(rows, test_labels, value, test_image, test_value or value, block_bytes).select(f"`{image}`", f"{JUDGED}.*")


def drop_leaked_labels(
    labels: DataFrame, test_labels: DataFrame, value: str = "value", test_image: str = "image", test_value: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``labels`` without the rows that ``find_leaked_labels`` calls leaked; every column stays as it is."""
    return _judged(labels, test_labels, value, test_image, test_value or value, block_bytes).where(f"not {JUDGED}.leaked").drop(JUDGED)


def _judged(rows: DataFrame, test_labels: DataFrame, value: str, test_image: str, test_value: str, block_bytes: int) -> DataFrame:
    blocks = _blocks(need(test_labels, test_image, test_value), test_image, test_value, block_bytes)

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        words = split(batch.column(value), "alnum")
        edge = np.zeros(len(words.hash) + 1, np.int64)
        items: list[set] = [set() for _ in range(batch.num_rows)]
        best: list[tuple[int, str | None, int | None]] = [(0, None, None)] * batch.num_rows
        for block in (b.value for b in blocks):
            found = search(words, block)
            if not len(found.low):
                continue
            size = found.high - found.low
            at = found.order[ragged(found.low, size)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + np.repeat(found.need, size), -1)
            for row, item in pairs(words, block, found).tolist():
                items[row].add(block.items[item])
            for p, t, n in zip(*(x.tolist() for x in longest(words, block, found))):
                row = int(words.row[p])
                if n > best[row][0]:
                    best[row] = (n, block.items[block.item[t]], int(p - words.first[row]))
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        n_hit = (hit[words.first[1:]] - hit[words.first[:-1]]).astype(np.int64)
        counts = words.counts.astype(np.int64)
        return [
            pa.array(counts), pa.array(n_hit), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())), pa.array([b[0] for b in best], pa.int64()),
            pa.array([b[1] for b in best], pa.string()), pa.array([b[2] for b in best], pa.int64()), pa.array((n_hit > 0) & (20 * n_hit >= counts)),
        ]

    return judge(rows, value, FIELDS, find)


def _blocks(tests: DataFrame, item: str, value: str, block_bytes: int) -> list:
    """Broadcasts of test texts, each of bounded size: the driver holds one block at a time."""
    size = tests.agg(F.coalesce(F.sum(F.octet_length(value) + 64), F.lit(0)).alias("n")).first()["n"]
    count = max(1, math.ceil(2 * size / block_bytes))  # twice, for hashing is not even
    out = []
    for b in range(count):
        part = tests if count == 1 else tests.where(F.pmod(F.xxhash64(item, value), F.lit(count)) == b)
        got = part.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{value}`").alias("value")).toArrow()
        words = split(got.column("value"), "alnum")
        out.append(tests.sparkSession.sparkContext.broadcast(TestBlock(words.hash, words.first, got.column("item").to_pylist())))
    return out
