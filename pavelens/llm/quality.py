"""Quality of live event messages: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import JUDGED, free, judge, need
from .fitting import fit_on_sample
from .words import Words, mix, split

#: Messages of label 0 and 1 at most that the weights are fitted on.
FIT_ROWS = (5_000, 10_000)
BITS = 20
PASSES = 3
#: Share of each family of n-grams in a message's features.
FAMILIES = (1.0, 1.0, 4.0, 4.0)


@dataclass
class Weights:
    """Weight per hashed n-gram, and of the constant."""

    gram: np.ndarray
    constant: float


def shapes(words: Words) -> np.ndarray:
    """Per word a number for how it is written and whether it repeats: letter cases, digits, signs, last byte, length, said before."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.uint64)
    data = words.data

    def having(member: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(member)])
        return (total[words.end] - total[words.start]).astype(np.uint64)

    upper = np.minimum(having((data >= 65) & (data <= 90)), np.uint64(2))
    lower = np.minimum(having((data >= 97) & (data <= 122)), np.uint64(1))
    digit = np.minimum(having((data >= 48) & (data <= 57)), np.uint64(2))
    sign = np.minimum(having((data < 128) & ~((data >= 48) & (data <= 57)) & ~((data >= 65) & (data <= 90)) & ~((data >= 97) & (data <= 122))), np.uint64(3))
    last = data[words.end - 1].astype(np.uint64)
    last = np.where((last < 128) & ~((last >= 97) & (last <= 122)) & ~((last >= 65) & (last <= 90)) & ~((last >= 48) & (last <= 57)), last, np.uint64(0))
    length = np.minimum(np.log2((words.end - words.start).astype(np.float64)) * 1.5, 9).astype(np.uint64)
    own = words.hash ^ mix(words.row.astype(np.uint64) + np.uint64(1))
    _, at, back = np.unique(own, return_index=True, return_inverse=True)
    before = (at[back] != np.arange(n)).astype(np.uint64)
    same = np.zeros(n, np.uint64)
    same[1:] = (own[1:] == own[:-1]).astype(np.uint64)
    out = upper
    for part, size in ((lower, 2), (digit, 3), (sign, 4), (last, 256), (length, 10), (before, 2), (same, 2)):
        out = out * np.uint64(size) + part
    return mix(out + np.uint64(0x1234567))


def grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Per family (row, hashed n-gram): words and shapes, single and in pairs; and the number of rows."""
    words = split(texts, "visible")
    size = np.uint64((1 << BITS) - 1)
    out = []
    for k, h in enumerate((words.hash, shapes(words))):
        out.append((words.row, (mix(h + np.uint64(2 * k)) & size).astype(np.int64)))
        pair = words.row[1:] == words.row[:-1]
        both = mix(h[:-1] * np.uint64(3) + mix(h[1:]) + np.uint64(2 * k + 1))[pair] if len(h) else h
        out.append((words.row[1:][pair] if len(h) else words.row, (both & size).astype(np.int64)))
    return out, words.n_rows


def dot(texts: pa.Array, weights: Weights) -> np.ndarray:
    """Sparse dot product of every text's n-gram shares with the weights, and the constant."""
    families, n = grams(texts)
    out = np.full(n, weights.constant)
    for share, (row, gram) in zip(FAMILIES, families):
        count = np.maximum(1, np.bincount(row, minlength=n))
        out += share * np.bincount(row, weights=weights.gram[gram], minlength=n) / count
    return out


def fit_weights(texts: list[bytes], label: np.ndarray, shift: float, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0) -> Weights:
    """Follow-the-regularised-leader (proximal) over the texts in a fixed mixed order, ``PASSES`` times."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for t in texts:
        families, _ = grams(pa.array([t.decode()], pa.string()))
        index = np.concatenate([g for _, g in families] + [[size]]).astype(np.int64)
        value = np.concatenate([np.full(len(g), s / max(1, len(g))) for s, (_, g) in zip(FAMILIES, families)] + [[1.0]])
        own, back = np.unique(index, return_inverse=True)
        rows.append((own, np.bincount(back, weights=value)))

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for turn in range(PASSES):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            index, value = rows[i]
            zi, ni = z[index], n[index]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(value @ w, -30, 30)))
            g = (p - label[i]) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
    w = weight(z, n)
    return Weights(w[:size].astype(np.float32), float(w[size]) + shift)


def fit_quality(events: DataFrame, labels: DataFrame, key: str = "event_id", message: str = "message", label: str = "quality", fit_rows: tuple[int, int] = FIT_ROWS) -> Weights:
    """Weights from at most ``fit_rows`` whole labelled messages of label 0 and 1."""
    return fit_on_sample(need(events, key, message), need(labels, key, label), key, message, label, fit_rows, fit_weights)


def score_quality(events: DataFrame, weights: Weights, key: str = "event_id", message: str = "message") -> DataFrame:
    """Quality of every whole message: ``key`` and ``score`` (0 to 1, higher: label 1 likelier).

    Features are the shares of hashed words, word pairs, word shapes and pairs of shapes; a shape says how a word is written and whether the message
    has said it before. The score is the logistic of their sparse dot product with the weights. Rows are scored alone, with no shuffle, a batch
    at a time. Null and empty messages have no n-grams and get the constant's score; repeated rows and null keys are kept; an empty table gives
    none; further columns are ignored.
    """
    free(key, "score")
    rows = need(events, key, message)
    held = rows.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS weights, whatever the input

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-np.clip(dot(batch.column(message), held.value), -30, 30))))]

    return judge(rows, message, "score double", score).select(f"`{key}`", f"{JUDGED}.score")
