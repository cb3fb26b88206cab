"""Token files: ids of live event messages as Parquet lists, laid out for selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SLICE_BYTES, distinct, encode_words, texts_at
from .common import free, need
from .words import gathered, ragged, split

#: Row groups of about 32 MB that hold pages of 64 kB with min and max in the page index. Ids are dictionary encoded (a vocabulary
#: is small), the other columns delta encoded; the page index lets a reader skip pages by key and start.
LAYOUT = {
    "compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
}
#: Distinct words that a Python worker remembers; more are encoded again, so only time depends on it.
KNOWN_WORDS = 1_500_000


class KnownWords:
    """Ids of words by their hash, in sorted arrays. When full, words met later are not added."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, words, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word)."""
        at, code = distinct(words)
        mine = words.hash[at]
        place = np.minimum(np.searchsorted(self.hash, mine), max(0, len(self.hash) - 1))
        known = self.hash[place] == mine if len(self.hash) else np.zeros(len(mine), bool)
        fresh = np.flatnonzero(~known)
        ids, lengths = encode_words(texts_at(words, at[fresh]).to_pylist(), vocabulary)
        start, length = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        if known.any():
            start[known], length[known] = self.start[place[known]], self.length[place[known]]
        start[fresh], length[fresh] = len(self.ids) + np.cumsum(lengths) - lengths, lengths
        every = np.concatenate([self.ids, ids.astype(np.int32)])
        if len(self.hash) < KNOWN_WORDS:
            order = np.argsort(np.concatenate([self.hash, mine[fresh]]), kind="stable")
            self.hash = np.concatenate([self.hash, mine[fresh]])[order]
            self.start = np.concatenate([self.start, start[fresh]])[order]
            self.length = np.concatenate([self.length, lengths])[order]
            self.ids = every
        per_word = length[code]
        return every[ragged(start[code], per_word)], per_word


_KNOWN: dict[str, KnownWords] = {}


def write_token_files(
    events: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "event_id", message: str = "message"
) -> DataFrame:
    """Encode every whole message, append ``end_id``, write the ids in ascending ``key`` order to ``folder`` and return the files as a table.

    Files hold ``key``, ``part`` (int, number of the file in key order), ``seq`` (long, row in the part), ``n_tokens`` (long, with
    the end id) and ``ids`` (array of int). Messages are dealt out by ranges of (key, message hash) before they are encoded, so the
    expensive step runs once and a key that many rows share is still split; each file is sorted.

    A null message counts as empty and gives the end id alone; null keys come first; repeated rows are written each; an
    empty table gives files without rows. A folder that exists already is an error.
    """
    free(key, "part", "seq", "n_tokens", "ids", "start")
    rows = need(events, key, message)
    kind = rows.schema[key].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.setdefault(vocabulary, KnownWords())
        seq = 0
        for batch in gathered(batches, message, SLICE_BYTES * 3 // 4):
            words = split(batch.column(message), "chunk")
            ids, per_word = known.encode(words, vocabulary)
            ends = np.concatenate([[0], np.cumsum(per_word)])[words.first[1:]]  # ids up to the end of each row
            out = np.insert(ids, ends, end_id).astype(np.int32)
            ends += np.arange(1, batch.num_rows + 1)
            off = np.concatenate([[0], ends])
            step = 512  # rows at a time to the JVM
            for lo in range(0, batch.num_rows, step):
                hi = min(batch.num_rows, lo + step)
                lists = pa.ListArray.from_arrays(pa.array((off[lo : hi + 1] - off[lo]).astype(np.int32)), pa.array(out[off[lo] : off[hi]]))
                counts = pa.array(np.diff(off[lo : hi + 1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), pa.array(np.arange(seq + lo, seq + hi, dtype=np.int64)), counts, lists], [key, "seq", "n_tokens", "ids"])
            seq += batch.num_rows

    order = [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64(message)]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tokens = dealt.mapInArrow(encode, f"`{key}` {kind}, seq bigint, n_tokens bigint, ids array<int>").withColumn("part", F.spark_partition_id())
    tokens.write.options(**LAYOUT).parquet(folder)
    return read_token_files(rows.sparkSession, folder)


def read_token_files(spark: SparkSession, folder: str, key: str = "event_id", low=None, high=None) -> DataFrame:
    """The token files in ``folder``; with ``low`` or ``high`` only keys from ``low`` to ``high``, whose pages alone are read."""
    found = spark.read.parquet(folder)
    if low is not None:
        found = found.where(F.col(f"`{key}`") >= low)
    if high is not None:
        found = found.where(F.col(f"`{key}`") <= high)
    return found


def token_offsets(files: DataFrame, key: str = "event_id") -> DataFrame:
    """(part, seq, ``start``): the number of ids before each row. Reads the narrow columns alone, not the ids.

    Sums per part are as few as the files; their running sum and the one inside each part make the offset.
    """
    narrow = files.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("part").agg(F.sum("n_tokens").alias("_sum")).select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return narrow.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, "part").select("part", "seq", (F.col("_base") + F.col("_in")).alias("start"))


def token_checks(files: DataFrame, key: str = "event_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids_crc32`` (long) of every row as it stands in the files."""
    kind = files.schema[key].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "part", "seq")), pa.array(np.diff(off).astype(np.int64)), pa.array(sums, pa.int64())], [key, "part", "seq", "n_tokens", "ids_crc32"])

    read = files.select(f"`{key}`", "part", "seq", "ids").mapInArrow(check, f"`{key}` {kind}, part int, seq bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(token_offsets(files, key), ["part", "seq"]).select(f"`{key}`", "start", "n_tokens", "ids_crc32")
