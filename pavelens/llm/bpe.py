"""Byte-pair encoding of live event messages through a table of distinct words, and decoding back.

A word here is a run of visible bytes, with stops such as ``,`` apart where the tokenizer cuts anyway. Words
never interact in a tokenizer that drops white space and has no token across it, so the ids of a
message are the ids of its words in order.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, give_back, lean, need
from .words import Words, gathered, ragged, split

#: Text handled at a time by one task; only memory depends on it.
SLICE_BYTES = 16 << 20
WORDS_A_CALL = 4096


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer in ``path`` without truncation and padding; one per process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(path)
    got.no_truncation()
    got.no_padding()
    return got


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """Piece per id, in UTF-8. As large as the vocabulary file, whatever the input."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        table[i] = piece.encode()
    return table


@lru_cache(maxsize=2)
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table as bytes: all pieces with a space behind each, where each starts, and its length (0: no such id)."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    known = np.zeros(max(vocab.values(), default=-1) + 1, bool)
    known[list(vocab.values())] = True
    table = [p + b" " if k else b"" for p, k in zip(pieces(path), known)]
    length = np.array([len(p) for p in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(length) - length, length


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The text that ``ids`` decode to, in UTF-8: their pieces, joined by one space. Ids that the vocabulary lacks are left out."""
    data, start, length = _piece_bytes(path)
    ids = ids.astype(np.int64)
    ids = ids[(ids >= 0) & (ids < len(length))]
    return data[ragged(start[ids], length[ids])].tobytes()[:-1]


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, ids per word)."""
    ends = _ending(path)
    letters = [i for i, w in enumerate(words) if _LETTERS(w)] if ends.any() else []
    plain = np.zeros(len(words), bool)
    plain[letters] = True
    start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    found: list[np.ndarray] = []
    held = 0
    for lo in range(0, len(letters), WORDS_A_CALL):
        part = letters[lo : lo + WORDS_A_CALL]
        # a word of letters alone is one piece of text to the tokenizer, and its last token alone ends a word
        ids = np.array(tokenizer(path).encode(" ".join([words[i] for i in part]), add_special_tokens=False).ids, np.uint32)
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) != len(part):
            plain[part] = False
            continue
        length[part] = np.diff(cut, prepend=0)
        start[part] = held + cut - length[part]
        found.append(ids)
        held += len(ids)
    rest = np.flatnonzero(~plain).tolist()
    for lo in range(0, len(rest), WORDS_A_CALL):
        part = rest[lo : lo + WORDS_A_CALL]
        ids_ = [e.ids for e in tokenizer(path).encode_batch_fast([words[i] for i in part], add_special_tokens=False)]
        length[part] = [len(x) for x in ids_]
        start[part] = held + np.cumsum(length[part]) - length[part]
        found.append(np.array([i for x in ids_ for i in x], np.uint32))
        held += len(found[-1])
    every = np.concatenate(found) if found else np.zeros(0, np.uint32)
    return every[ragged(start, length)], length


_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


@lru_cache(maxsize=2)
def _ending(path: str) -> np.ndarray:
    """Which ids end a word, if the tokenizer marks word ends."""
    return np.array([p.endswith(b"</w>") for p in pieces(path)])


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct word, number of the distinct word at each place)."""
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, known = pd.factorize(words.hash)  # numbered as they come
    code = code.astype(np.int32)
    at = np.zeros(len(known), np.int64)
    at[code[::-1]] = np.arange(len(code) - 1, -1, -1)  # the first place is written last
    # frequent words get small numbers, which pack well
    order = np.argsort(-np.bincount(code), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return at[order], rank[code]


def texts_at(words: Words, at: np.ndarray) -> pa.Array:
    """The words at ``at`` as a string column."""
    length = words.end[at] - words.start[at]
    off = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    data = words.data[ragged(words.start[at], length)]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(data))


def _pack(numbers: np.ndarray) -> bytes:
    """Little-endian numbers, bytes of equal weight together, zstandard."""
    n = np.ascontiguousarray(numbers.astype(np.uint32)).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(n.T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def _slice_id(batch: pa.RecordBatch, text: str, words: Words) -> str:
    """Names a slice by what it holds, so that a task run again gives the same name."""
    seen = hashlib.blake2b(words.hash.tobytes(), digest_size=16)
    seen.update(str(batch.column(0).to_pylist()).encode())
    seen.update(np.ascontiguousarray(words.first).tobytes())
    return seen.hexdigest()


def encode_messages(
    events: DataFrame, vocabulary: str, key: str = "event_id", message: str = "message", digests: bool = False
) -> DataFrame:
    """Token ids of every whole message, and the text that they decode to.

    Returns one row per row of ``events``: ``key``, ``n_tokens`` (long), ``ids`` (array of int) and ``decoded``
    (pieces joined by one space, as the tokenizers library decodes without a decoder); with ``digests`` the last two
    are given as ``ids_sha256`` (of little-endian unsigned 32-bit ids) and ``decoded_sha256`` instead.

    How: messages are cut into slices of about 16 MB that list their distinct words and hold, per place, the word's
    number. The lists of all slices meet by word, where each distinct word is encoded once; the ids go
    back to the slices by number and are laid out by place. The ids of a message are then decoded through the id-to-piece table of the
    vocabulary (``decode_messages``), whose size does not depend on the input. A word arrives at most once per slice, so no word is hot.

    ``events`` must give the same rows in the same order when a task is run again, as a stored table does; if not,
    words without ids raise an error. A null message counts as empty: no tokens, empty text. A null key stays null, repeated rows give
    repeated results, further columns are ignored, and an empty table gives an empty result.
    """
    free(key, "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    rows = need(events, key, message)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, message, SLICE_BYTES):
            words = split(batch.column(message), "chunk")
            at, _ = distinct(words)
            name = _slice_id(batch, message, words)
            for lo in range(0, len(at), 50_000):
                part = at[lo : lo + 50_000]
                code = pa.array(np.arange(lo, lo + len(part), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([texts_at(words, part), pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([name])).dictionary_decode(), code], ["word", "slice", "code"])

    def list_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, message, SLICE_BYTES):
            words = split(batch.column(message), "chunk")
            _, code = distinct(words)
            name = _slice_id(batch, message, words)
            step = max(1, batch.num_rows // 8)
            for lo in range(0, batch.num_rows, step):
                hi = min(batch.num_rows, lo + step)
                keys = batch.column(key).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([_pack(code[words.first[lo] : words.first[hi]])], pa.binary()), pa.array([_pack(words.counts[lo:hi])], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), keys)],
                    ["slice", "places", "counts", "keys"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        found: dict[str, tuple[list[int], list[bytes]]] = {}
        held = 0
        for batch in batches:
            words = batch.column("word").to_pylist()
            fresh = [w for w in dict.fromkeys(words) if w not in known]
            ids, lengths = encode_words(fresh, vocabulary)
            ends = np.cumsum(lengths)
            for w, a, b in zip(fresh, ends - lengths, ends):
                known[w] = ids[a:b].tobytes()
            for w, s, c in zip(words, batch.column("slice").to_pylist(), batch.column("code").to_pylist()):
                codes, parts = found.setdefault(s, ([], []))
                codes.append(c)
                parts.append(known[w])
            held += len(words)
            if held >= 500_000:
                yield _found(found)
                found, held = {}, 0
            if len(known) >= 500_000:  # words of one task come sorted, so a dropped word is not met again
                known = {}
        if found:
            yield _found(found)

    kind = rows.schema[key].dataType.simpleString()
    results = ("ids_sha256 string", "decoded_sha256 string") if digests else ("ids array<int>", "decoded string")

    def lay_out(places: pa.Table, given: pa.Table) -> pa.Table:
        lengths, starts, ids = _dictionary(given)
        out: list[list] = [[], [], []]
        for places_, counts_ in zip(places.column("places").to_pylist(), places.column("counts").to_pylist()):
            code, ends = _unpack(places_).astype(np.int64), np.cumsum(_unpack(counts_).astype(np.int64))
            if len(code) and (code.max() >= len(lengths) or lengths[code].min() < 0):
                raise RuntimeError("the messages changed between two reads; store them first")
            lo = 0
            for hi in ends.tolist():
                mine = code[lo:hi]
                got = ids[ragged(starts[mine], lengths[mine])]
                text = decode_ids(got, vocabulary)
                out[0].append(len(got))
                out[1].append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest() if digests else got.astype(np.int32))
                out[2].append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                lo = hi
        del ids
        give_back()
        keys = pa.concat_arrays([c.flatten() for c in places.column("keys").chunks])
        types = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
        return pa.table([keys, pa.array(out[0], pa.int64()), pa.array(out[1], types[0]), pa.array(out[2], types[1])], [key, "n_tokens", *[r.split()[0] for r in results]])

    words_at = rows.mapInArrow(lean(list_words), "word string, slice string, code int")
    # sorted words: equal words are neighbours, so each is encoded once though the memory of known words is bounded
    given = words_at.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(lean(encode), "slice string, codes binary, lengths binary, ids binary")
    places = rows.mapInArrow(lean(list_places), f"slice string, places binary, counts binary, keys array<{kind}>")
    return places.groupBy("slice").cogroup(given.groupBy("slice")).applyInArrow(lay_out, ", ".join([f"`{key}` {kind}", "n_tokens bigint", *results]))


def _found(found: dict[str, tuple[list[int], list[bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found)), pa.array([_pack(np.array(c)) for c, _ in found.values()], pa.binary()),
         pa.array([_pack(np.array([len(x) // 4 for x in p])) for _, p in found.values()], pa.binary()),
         pa.array([_pack(np.frombuffer(b"".join(p), np.uint32)) for _, p in found.values()], pa.binary())],
        ["slice", "codes", "lengths", "ids"],
    )


def _dictionary(given: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice: ids per word (-1: unknown), their start, all ids."""
    columns = [given.column(c).to_pylist() for c in ("codes", "lengths", "ids")]
    codes, counts, ids = (np.concatenate([_unpack(b) for b in col]) if col else np.zeros(0, np.uint32) for col in columns)
    size = int(codes.max()) + 1 if len(codes) else 0
    lengths, starts = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    lengths[codes] = counts
    ends = np.cumsum(counts.astype(np.int64))
    starts[codes] = ends - counts
    return lengths, starts, ids


def decode_messages(tokens: DataFrame, vocabulary: str, key: str = "event_id", ids: str = "ids") -> DataFrame:
    """Texts of messages that are given as token ids (array of integers), such as the files of ``write_token_files``.

    Returns per row ``key`` and ``decoded``: each id's piece, found by its number in the id-to-piece table of the vocabulary, joined by one space in the order of the
    ids, as the tokenizers library decodes without a decoder. The table is as large as the vocabulary, whatever the input; ids meet it packed, row by row, without a shuffle.

    Null ids, and ids that the vocabulary lacks, are left out; a null or empty list decodes to an empty text. Null keys and repeated rows are kept; an empty table gives none; further
    columns are ignored.
    """
    free(key, "decoded")
    rows = need(tokens, key, ids)
    kind = rows.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            texts = [decode_ids(np.array([x for x in v.as_py() if x is not None], np.int64), vocabulary).decode() if v.is_valid else "" for v in lists]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "decoded"])

    return rows.mapInArrow(lean(decode), f"`{key}` {kind}, decoded string")
