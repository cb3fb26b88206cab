"""Secrets in live event messages: a keyword automaton, anchored patterns at its hits, and checksums inside tokens."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import JUDGED, free, judge, need
from .words import buffers, runs

FIELDS = "spans array<struct<kind:string,start:int,end:int>>, redacted string"

# The kinds in the order of their report, their keywords, patterns and lengths.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]_|npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def checksum_holds(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the base-62 CRC-32 of ``body``, as in tokens that carry their own checksum."""
    n, digits = zlib.crc32(body), bytearray()
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return bytes(reversed(digits)) == check


def _near(kind: str, data: bytes, at: int, end: int) -> tuple[int, bool] | None:
    """(end of the match that starts at ``at``, whether it counts), if there is one."""
    if kind == "assign":
        m = ASSIGN.match(data, at, end)
        return m and (m.end(), m.end(2) - m.start(2) >= LEAST["assign"])
    if kind == "access":
        m = ACCESS.match(data, at, end)
        return m and (m.end(), m.end() - m.start() >= LEAST["access"])
    m = CHECKED.match(data, at, end)
    return m and (m.end(), checksum_holds(m[1], m[2]))


def spans_in(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Per row the (start, kind number, end) of every secret in code points, sorted."""
    data, off = buffers(texts)
    raw = data.tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}
    last: dict[tuple[int, str], int] = {}
    # bytes.lower() changes A-Z alone and keeps every place
    hits = sorted((e - n + 1, kind) for e, (kind, n) in _automaton().iter(raw.lower().decode("latin-1")))
    rows = (np.searchsorted(off, [h[0] for h in hits], side="right") - 1).tolist() if hits else []
    for (at, kind), row in zip(hits, rows):
        if at < last.get((row, kind), 0):
            continue
        got = _near(kind, raw, at, int(off[row + 1]))
        if got:
            last[row, kind] = got[0]
            if got[1]:
                found.setdefault(row, []).append((at, KINDS.index(kind), got[0]))
    start, end = runs(data, off, _HEX)
    long = np.flatnonzero(end - start >= LEAST["hex"])
    for s, e, row in zip(start[long].tolist(), end[long].tolist(), (np.searchsorted(off, start[long], side="right") - 1).tolist()):
        found.setdefault(row, []).append((s, KINDS.index("hex"), e))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    for row, spans in found.items():
        a, b = int(off[row]), int(off[row + 1])
        point = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])  # code points before each byte
        out[row] = sorted((int(point[s - a]), k, int(point[e - a])) for s, k, e in spans)
    return out


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every stretch that spans cover, alone or together, replaced by ``mark``."""
    parts, done = [], 0
    for s, _, e in spans:
        if s >= done:
            parts += [text[done:s], mark]
        done = max(done, e)
    return "".join([*parts, text[done:]])


def find_secrets(events: DataFrame, key: str = "event_id", message: str = "message", mark: str = "[secret]") -> DataFrame:
    """Secrets in every whole message.

    Returns per row of ``events``: ``key``, ``spans`` (array of kind, start, end in code points, end exclusive, by start, then kind in
    the order of ``KINDS``) and ``redacted`` (the message with ``mark`` in place of the spans; as it was when there is none).

    An Aho-Corasick automaton finds keywords in lower-cased bytes of whole batches; only at its hits is the kind's pattern tried,
    anchored. Runs of hexadecimal digits have no keyword and are found by their length. Tokens with a CRC-32 of their own count
    only if it holds. Matches of one kind do not overlap, those of different kinds may.

    Rows are judged alone, with no shuffle. Null and empty messages have no spans, and ``redacted`` is null or empty; repeated rows
    and null keys are kept; an empty table gives none; further columns are ignored.
    """
    free(key, "spans", "redacted")
    return _judged(need(events, key, message), message, mark).select(f"`{key}`", f"{JUDGED}.*")


def redact_secrets(events: DataFrame, message: str = "message", mark: str = "[secret]") -> DataFrame:
    """``events`` with every secret that ``find_secrets`` finds replaced by ``mark``; rows and columns stay."""
    clean = _judged(events, message, mark)
    return clean.select(*[F.col(f"{JUDGED}.redacted").alias(c) if c == message else F.col(f"`{c}`") for c in events.columns])


def _judged(rows: DataFrame, message: str, mark: str) -> DataFrame:
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(message)
        spans = spans_in(texts)
        hit = [i for i, s in enumerate(spans) if s]
        if hit:
            texts = texts.to_pylist()
            for i in hit:
                texts[i] = redact(texts[i], spans[i], mark)
            texts = pa.array(texts, pa.string())
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans], item), texts.cast(pa.string())]

    return judge(rows, message, FIELDS, find)
