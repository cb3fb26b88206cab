"""Alike label texts of images: a chosen-path join on five-word shingles with verified Jaccard similarity."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .buckets import blocks, by_group, local_roots
from .common import free, lean, need, stage
from .words import gathered, mix, ragged, split, windows

SHINGLE = 5
#: Shingles of a text, those of smallest hash, that paths are chosen from.
SKETCH = 64
#: Tokens chosen at each step of a path.
CHOICES = 3
#: Members of a bucket that is compared as it is.
SMALL = 64
#: Steps after which a bucket is compared in blocks, whatever its size.
DEPTH = 4
#: A bucket whose largest part keeps this share of it holds alike texts: it is compared in blocks and not split further.
DENSE = 0.5
RECALL = 0.999
#: Sets that one step of ``split_buckets`` holds at a time.
STEP_ROWS = 20_000


def runs_needed(least: float, choices: int, depth: int, recall: float) -> int:
    """Runs after which a pair at similarity ``least`` has met with probability ``recall``, if every one of ``depth`` steps must keep it."""
    step = 1 - (1 - least) ** choices
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - step**depth)))


def pack(sorted_: np.ndarray) -> bytes:
    """Sorted distinct 32-bit numbers in about three bytes each."""
    gaps = np.diff(sorted_, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def shingle_sets(rows: DataFrame, image: str, value: str, runs: int, choices: int, least: float) -> DataFrame:
    """Per row with words: ``image``; ``_name``, 128 bits of its shingle set; ``_n``, the set's size; ``_sketch``, its SKETCH shingles of
    smallest hash; ``_paths``, its first buckets; ``_set``, all shingles as packed 32-bit numbers. With 10,000 shingles, 32 bits add 0.02 false common
    ones on average."""
    kind = rows.schema[image].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, value):
            words = split(batch.column(value), "alnum")
            h, at = windows(words, SHINGLE, seed=7, short=True)
            cuts = np.searchsorted(words.row[at], np.arange(batch.num_rows + 1)).tolist()
            have = [i for i in range(batch.num_rows) if cuts[i] < cuts[i + 1]]
            out: list[list] = [[], [], [], []]
            sketches = []
            for i in have:
                s = np.unique(h[cuts[i] : cuts[i + 1]])
                sketches.append(s[:SKETCH])  # hashes are evenly spread, so the smallest are a fair draw
                out[0].append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                out[1].append(len(s))
                out[2].append(sketches[-1].tobytes())
                out[3].append(pack(np.unique((s & np.uint64(0xFFFFFFFF)).astype(np.uint32))))
            row, path = first_buckets(sketches, np.array(out[1], np.int64), runs, choices, least)
            firsts = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(have) + 1)), pa.int32()), pa.array(path.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(image).take(pa.array(have, pa.int64())), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), firsts, pa.array(out[3], pa.binary())],
                [image, "_name", "_n", "_sketch", "_paths", "_set"],
            )

    return rows.mapInArrow(lean(make), f"`{image}` {kind}, _name string, _n int, _sketch binary, _paths array<bigint>, _set binary")


def _choose(sets: list[np.ndarray], seeds: np.ndarray, choices: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the ``choices`` tokens of each set that are smallest under the row's seed; the path goes on from the seed."""
    length = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), length)
    h = mix(token ^ seeds[row])
    order = np.lexsort((h, row))
    start = np.cumsum(length) - length
    take = order[ragged(start, np.minimum(length, choices))]
    return row[take], mix(h[take] + np.uint64(0x5851F42D4C957F2D))


def first_buckets(sets: list[np.ndarray], sizes: np.ndarray, runs: int, choices: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the first step of all runs, by row.

    The path also takes the set's size, in steps of ratio ``least``; a set goes to its own step and the next, so alike sets still meet and sets of quite
    different sizes do not.
    """
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    got = [_choose(sets, np.full(len(sets), seed), choices) for seed in seeds]
    row, path = (np.concatenate(c) for c in zip(*got))
    if least < 1:
        step_of = np.floor(np.log(sizes) / -np.log(least) + 1e-9).astype(np.uint64)[row]
        path = np.concatenate([mix(path + step_of * np.uint64(2)), mix(path + (step_of + np.uint64(1)) * np.uint64(2))])
        row = np.concatenate([row, row])
    order = np.argsort(row, kind="stable")
    return row[order], path[order]


def split_buckets(members: DataFrame, choices: int) -> DataFrame:
    """A further step of the path: (_class, _froms, _sketch) to (_class, _path, _from), as many rows as tokens are chosen."""
    kind = members.schema["_class"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(b, np.uint64) for b in batch.column("_sketch").to_pylist()]
            lists = batch.column("_froms")
            seeds = lists.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            for lo in range(0, len(owner), STEP_ROWS):
                mine, seed = owner[lo : lo + STEP_ROWS], seeds[lo : lo + STEP_ROWS]
                row, path = _choose([sets[i] for i in mine.tolist()], seed, choices)
                yield pa.RecordBatch.from_arrays([batch.column("_class").take(pa.array(mine[row])), pa.array(path.view(np.int64)), pa.array(seed[row].view(np.int64))], ["_class", "_path", "_from"])

    return members.select("_class", "_froms", "_sketch").mapInArrow(lean(step), f"_class {kind}, _path bigint, _from bigint")


def leaf_buckets(firsts: DataFrame, sketches: DataFrame, choices: int, depth: int, small: int, dense: float) -> DataFrame:
    """(_class, _leaf): the buckets in which each class is compared. ``firsts`` has (_class, _paths), ``sketches`` (_class, _sketch) of at least those.

    Sketches go along only with classes that share a bucket, once per class and step. Both sides of those joins grow with the input, so
    they are merged at every size.
    """
    parts = firsts.select("_class", F.explode("_paths").alias("_path"), F.lit(0).cast("bigint").alias("_from"))
    leaves, parent = None, None
    for level in range(1, depth + 1):
        sizes = parts.groupBy("_path", "_from").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
        # one shared token may be chance, so every first bucket is split once
        big = ((F.col("_m") > small) | F.lit(level == 1)) & F.lit(level < depth)
        if parent is not None:  # a part that keeps most of its bucket holds alike texts
            sizes = sizes.join(parent, "_from")
            big &= F.col("_m") < dense * F.col("_of")
        sizes = stage(sizes.select("_path", "_m", big.alias("_big")), "sizes")
        kept = parts.join(sizes.hint("merge"), "_path")
        found = kept.where("not _big").select("_class", F.col("_path").alias("_leaf"))
        leaves = found if leaves is None else leaves.unionByName(found)
        parent = sizes.where("_big").select(F.col("_path").alias("_from"), F.col("_m").alias("_of"))
        if level == depth or parent.isEmpty():
            break
        onward = kept.where("_big").groupBy("_class").agg(F.collect_list("_path").alias("_froms"))
        sketches = stage(sketches.join(onward.hint("merge"), "_class").dropDuplicates(["_class"]), "onward")
        parts = stage(split_buckets(sketches, choices), "paths")
        sketches = sketches.drop("_froms")
    leaves = stage(leaves.distinct(), "leaves")
    # buckets with the same members are compared once
    h = [F.xxhash64("_class", F.lit(i)).cast("decimal(20,0)") for i in (1, 2)]
    alike = leaves.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_m"), F.sum(h[0]).alias("_x"), F.sum(h[1]).alias("_y"))
    return leaves.join(alike.groupBy("_m", "_x", "_y").agg(F.min("_leaf").alias("_leaf")).select("_leaf"), "_leaf")


def verify(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weight of links per row, links per row, links a, links b) that belong to the leaf of ``table``, between its two blocks."""
    n = table.num_rows
    block = table.column("_b").to_numpy()
    same = table.column("_i")[0] == table.column("_j")[0]
    a = np.arange(n) if same else np.flatnonzero(block == table.column("_i")[0].as_py())
    b = a if same else np.flatnonzero(block != table.column("_i")[0].as_py())
    empty = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), empty, empty
    sets = [unpack(s) for s in table.column("_set").to_pylist()]
    size = np.array([len(s) for s in sets], np.float64)
    common = _shared(sets, a, b)
    ok = common >= least * (size[a][:, None] + size[b][None, :] - common) - 1e-9
    if same:
        np.fill_diagonal(ok, False)
    if ok.any():  # a pair belongs to the first leaf that both are in
        leaf = table.column("_leaf")[0].as_py()
        before = [np.array([x for x in s if x < leaf], np.int64).view(np.uint64) for s in table.column("_leaves").to_pylist()]
        ok &= _shared(before, a, b) == 0
    copies = table.column("_copies").to_numpy()
    weight, links = np.zeros(n, np.int64), np.zeros(n, np.int64)
    weight[a] += ok @ copies[b]
    links[a] += ok.sum(1)
    if not same:
        weight[b] += copies[a] @ ok
        links[b] += ok.sum(0)
    x, y = np.nonzero(np.triu(ok) if same else ok)
    return weight, links, a[x], b[y]


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Number of common elements of every set in ``a`` with every one in ``b``, by products of membership matrices over parts of the elements."""
    length = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), length)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    head = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    number = np.cumsum(head) - 1
    often = np.bincount(number, minlength=1)[number] > 1 if len(token) else np.zeros(0, bool)
    row, number = row[often], number[often]
    if len(number):
        number = np.cumsum(np.concatenate([[False], number[1:] != number[:-1]]))
    common = np.zeros((len(a), len(b)), np.float32)
    in_a, in_b = np.full(len(sets), -1), np.full(len(sets), -1)
    in_a[a], in_b[b] = np.arange(len(a)), np.arange(len(b))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        s, e = np.searchsorted(number, [lo, lo + columns])
        r, c = row[s:e], number[s:e] - lo
        x = np.zeros((len(a), min(columns, int(c[-1]) + 1 if len(c) else 1)), np.float32)
        x[in_a[r[in_a[r] >= 0]], c[in_a[r] >= 0]] = 1
        if a is b:
            common += x @ x.T
        else:
            y = np.zeros((len(b), x.shape[1]), np.float32)
            y[in_b[r[in_b[r] >= 0]], c[in_b[r] >= 0]] = 1
            common += x @ y.T
    return common


def alike_labels(
    labels: DataFrame, image: str = "image", value: str = "value", least: float = 0.8, recall: float = RECALL, choices: int = CHOICES, depth: int = DEPTH,
    small: int = SMALL, dense: float = DENSE,
) -> DataFrame:
    """Images whose label texts are alike: Jaccard similarity of their sets of five-word shingles of at least ``least``.

    Words are runs of ASCII letters (A-Z as a-z), digits and anything beyond ASCII; a text of fewer words, but not none, is one
    shingle. Returns per row of ``labels``: ``image``, ``copy_id`` (smallest image with the same shingles), ``n_links`` (long, other label texts, one per image and set of shingles, that
    those of the image are linked to directly, copies included), ``class_id`` (smallest image reachable by links, itself included) and ``kept`` (class_id = image).

    How: texts with the same shingles are one class from the start. A run sends each class to the buckets of ``choices`` sampled
    tokens; large buckets are split by further tokens along the path, small ones compared, and so are those that
    hardly shrink, in bounded blocks. Runs repeat until a pair at ``least`` is found with probability ``recall``; what is found is verified on all shingles, which 32 bits of hash stand for. A link counts
    in the first bucket both classes are in. Blocks emit counts and one edge per member, never pairs, so a group of many copies
    costs its comparisons but no rows; no bucket is cut.

    Texts that are null, empty or without words link with nothing. Rows with a null image are kept as their own class with a null ``class_id``. An image
    with several texts has the links of all of them and joins their classes; each of its rows gets that result, and repeated rows count once. An empty table gives none; further columns are ignored.
    """
    free(image, "copy_id", "n_links", "class_id", "kept")
    rows = need(labels, image, value)
    own = F.col(f"`{image}`")
    runs = runs_needed(least, choices, depth, recall)
    made = shingle_sets(rows.where(own.isNotNull()), image, value, runs, choices, least)
    made = stage(made.withColumn("_row", F.monotonically_increasing_id()), "shingles")
    # texts with one shingle set are one class, named by one of its rows; sets do not travel here
    named = made.groupBy("_name").agg(F.min("_row").alias("_class"), F.count_distinct(own).alias("_copies"), F.min(own).alias("_least"))
    named = stage(named, "classes")
    firsts = made.join(named.select("_class").hint("merge"), F.col("_row") == F.col("_class")).select("_class", "_n", "_paths")
    firsts = stage(firsts, "firsts")
    leaves = leaf_buckets(firsts, made.select(F.col("_row").alias("_class"), "_sketch"), choices, depth, small, dense)
    sized = leaves.join(firsts.select("_class", "_n"), "_class")
    # who meets whom is settled on narrow rows; sets travel once to their class and once to its blocks
    place = F.struct("_leaf", "_i", "_j", "_b")
    placed = blocks(sized, ["_leaf"], "_class", "_n")
    per_class = placed.groupBy("_class").agg(F.sort_array(F.collect_set("_leaf")).alias("_leaves"), F.collect_list(place).alias("_places"))
    holders = stage(per_class.join(named.select("_class", "_copies"), "_class"), "holders")
    # by a shuffle at every size: a class has some leaves, so the holders grow with the input
    sets = made.select(F.col("_row").alias("_class"), "_set").join(holders.hint("merge"), "_class")
    members = sets.select("_class", "_copies", "_set", "_leaves", F.explode("_places").alias("_p")).select("_class", "_copies", "_set", "_leaves", "_p.*")

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        weight, links, a, b = verify(table, least)
        if not len(a):
            return None
        root = local_roots(table.num_rows, a, b)
        on = np.flatnonzero(links)
        ids = table.column("_class").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(on)), pa.array(weight[on]), ids.take(pa.array(root[on]))], ["_class", "_weight", "_root"])

    found = stage(by_group(members, ["_leaf", "_i", "_j"], compare, "_class bigint, _weight bigint, _root bigint"), "links")
    counts = found.groupBy("_class").agg(F.sum("_weight").alias("_weight"))
    # an image with several texts joins their classes
    several = made.groupBy(own.alias("_image")).agg(F.min("_name").alias("_a"), F.max("_name").alias("_z")).where("_a <> _z").select("_image")
    inside = made.select(own.alias("_image"), "_name").join(several, "_image", "left_semi").join(named.select("_name", "_class"), "_name")
    inside = stage(inside.select("_image", "_class").distinct(), "images")
    first = inside.groupBy("_image").agg(F.min("_class").alias("_first"))
    joined = inside.join(first, "_image").where("_class <> _first").select(F.col("_class").alias("u"), F.col("_first").alias("v"))
    edges = found.select(F.col("_class").alias("u"), F.col("_root").alias("v")).unionByName(joined)
    reach = connected_components(edges).withColumnRenamed("node", "_class")
    linked = named.join(counts, "_class", "left").join(reach, "_class", "left")
    linked = stage(linked.select("_name", "_least", "component", (F.coalesce("_weight", F.lit(0)) + F.col("_copies") - 1).alias("_links")), "linked")
    top = linked.where("component is not null").groupBy("component").agg(F.min("_least").alias("_top"))
    linked = linked.join(top, "component", "left").select("_name", "_least", F.coalesce("_top", "_least").alias("_group"), "_links")
    mine = made.select(own.alias("_image"), "_name").distinct().join(linked, "_name")
    mine = mine.groupBy("_image").agg(F.min("_least").alias("_least"), F.min("_group").alias("_group"), F.sum("_links").alias("_links"))
    out = rows.select(own).join(mine, own == F.col("_image"), "left")
    group = F.coalesce("_group", own)
    return out.select(own, F.coalesce("_least", own).alias("copy_id"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), group.alias("class_id"), F.coalesce(group == own, F.lit(True)).alias("kept"))
