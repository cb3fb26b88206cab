"""Toxic live event messages by compression distance: a zstandard dictionary with and without toxic stretches, windows, calibrated lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import JUDGED, free, judge, need
from .fitting import fit_on_sample

#: Messages of label 0 and 1 at most that the dictionaries and thresholds are fitted on.
FIT_ROWS = (6_000, 2_000)
#: Bytes of the windows; each size is compressed with both dictionaries.
WINDOWS = (32, 64)
ORDINARY_BYTES, TOXIC_BYTES = 24_000, 24_000
#: Bytes of the grams, which start at the space before a word, and how many bytes of a word tell its start from the same letters further inside.
GRAM, START = 5, 3
#: Signed root of the likelihood ratio from which a gram counts as more usual in toxic texts: about one false gram in 150,000.
EVIDENCE = 4.5
_MARKED = bytes(i ^ 0x80 for i in range(256))


@dataclass
class Distance:
    """Ordinary dictionary, the toxic stretches that stand before it, weights of the calibrated window features."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def score(self, text: bytes) -> float:
        x = (features(text, self) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weight[:-1] + self.weight[-1], -30, 30))))


def mark_starts(text: bytes) -> bytes:
    """Lower-cased words, each behind a space and its first ``START`` bytes as other bytes: a stem at a word's start matches only there."""
    words = text.lower().split()
    return b" " + b" ".join(w[:START].translate(_MARKED) + w[START:] for w in words) + b" " if words else b""


def cut(text: bytes, size: int) -> list[bytes]:
    """Windows of ``size`` bytes or little more, up to the next space if it is near."""
    out, lo = [], 0
    while lo < len(text):
        hi = lo + size
        if hi < len(text):
            space = text.find(b" ", hi, hi + 64)
            hi = hi if space < 0 else space + 1
        out.append(text[lo:hi])
        lo = hi
    return out


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    params = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=18, chain_log=18, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    out = []
    # the toxic passages stand before the shared text, so that matches in the latter cost the same with either dictionary
    for content in (ordinary, toxic + ordinary):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(compression_params=params, dict_data=held).compress)
    return out


def features(text: bytes, model: Distance) -> np.ndarray:
    """Per window size: the largest three gains of the toxic dictionary, how many and which share of the windows gain, the mean gain, the number of windows."""
    plain, toxic = _compressors(model.ordinary, model.toxic)
    text = mark_starts(text)
    out: list[float] = []
    for size in WINDOWS:
        windows = cut(text, size)
        gain = np.array([len(plain(w)) - len(toxic(w)) for w in windows] or [0])
        weighed = np.sort(gain.clip(0, 6))[::-1]  # so that one odd window does not stand for many
        top = np.r_[weighed, 0, 0, 0][:3]
        n = np.log(max(1, len(windows)))
        counts = [np.log1p((gain >= g).sum()) for g in (1, 2, 3, 4)]
        shares = [(gain >= g).mean() ** 0.5 for g in (1, 2, 3)]
        out += [*top, n, *counts, *shares, weighed.mean(), top[0] / (np.log(3 + len(windows)))]
    return np.array(out, np.float64)


def _grams(word: bytes) -> list[bytes]:
    word = b" " + word
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def _stretches(word: bytes, marked: set[bytes]) -> list[bytes]:
    """Longest stretches of ``word``, with the space before it, that marked grams cover."""
    out, start, end = [], None, 0
    for i, gram in enumerate(_grams(word)):
        if gram in marked:
            if start is None or i > end:
                if start is not None:
                    out.append((b" " + word)[start:end])
                start = i
            end = i + GRAM
    return out if start is None else [*out, (b" " + word)[start:end]]


def _evidence(counts: tuple[Counter, Counter], n: list[int]) -> dict[bytes, float]:
    """Signed root of the likelihood ratio per gram of toxic texts: that its share of toxic texts differs from that of ordinary ones.

    A stem that ordinary texts use now and then, or that only the texts of a rare language hold, passes if there are texts enough to tell.
    """
    k = [np.array([c[g] for g in counts[1]], np.float64) for c in counts]

    def fit(x: np.ndarray, m: int, p: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(p, 1e-300)) + (m - x) * np.log(np.maximum(1 - p, 1e-300))

    p = (k[0] + k[1]) / (n[0] + n[1])
    ratio = sum(fit(x, m, x / m) - fit(x, m, p) for x, m in zip(k, n))
    return dict(zip(counts[1], np.sqrt(2 * np.maximum(ratio, 0)) * np.sign(k[1] / n[1] - k[0] / n[0])))


def _trained(size: int, windows: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size + 8192, windows, k=16, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b" ".join(windows)[-size:]


def fit_distance(texts: list[bytes], label: np.ndarray, shift: float) -> Distance:
    """Dictionaries from one part of the texts, calibration on the other.

    The ordinary one is trained by zstandard on windows of ordinary texts. The toxic one is a list of the stretches of words that are more usual in
    toxic texts than in ordinary ones and stand in two at least; the ordinary windows leave those words out. The toxic dictionary stands before the ordinary one; the difference of
    two lengths is then due to those stretches alone. How often they occur is left to the calibration.
    """
    first = np.arange(len(texts)) % 5 < 3
    part = {i: mark_starts(texts[i]) for i in np.flatnonzero(first)}
    counts, n = (Counter(), Counter()), [0, 0]
    seen: set[int] = set()
    for i, t in part.items():
        words = t.split()
        sketch = sorted({zlib.crc32(b" ".join(words[j : j + 3])) for j in range(len(words) - 2)})[:8]
        if sum(h in seen for h in sketch) >= 2:  # a near copy is no evidence of its own; it is used for all else
            continue
        seen.update(sketch)
        counts[label[i]].update({g for w in set(words) for g in _grams(w)})
        n[label[i]] += 1
    n = [max(1, k) for k in n]
    marked = {g for g, z in _evidence(counts, n).items() if z > EVIDENCE}
    if not marked:  # few labels
        marked = {g for g, c in counts[1].items() if c >= 3 and not counts[0][g]}
    windows: list[bytes] = []
    found: Counter = Counter()
    rng = np.random.default_rng(7)
    for i, t in part.items():
        if label[i]:
            found.update({s for w in t.split() for s in _stretches(w, marked)})
        else:
            own = cut(t, 96)
            for j in rng.choice(len(own), min(4, len(own)), replace=False) if own else ():
                windows.append(b" " + b" ".join(w for w in own[j].split() if marked.isdisjoint(_grams(w))) + b" ")
    # each stretch once, the most frequent last and so nearest; a trained dictionary repeats them, and its seams look like common words
    toxic = b" ".join(s for s, c in sorted(found.items(), key=lambda x: (x[1], x[0])) if c > 1)[-TOXIC_BYTES:] + b" "
    model = Distance(_trained(ORDINARY_BYTES, windows) or b" the ", toxic, np.zeros(1), np.ones(1), np.zeros(2))
    rest = np.flatnonzero(~first)
    x = np.array([features(texts[i], model) for i in rest]) if len(rest) else np.zeros((0, len(features(b"", model))))
    y = label[rest].astype(np.float64)
    model.mean, model.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model.weight = logistic((x - model.mean) / model.scale, y, shift)
    return model


def logistic(x: np.ndarray, y: np.ndarray, shift: float) -> np.ndarray:
    """Ridge logistic regression by Newton's steps, the last weight for a constant; ``shift`` goes to the latter."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
    w[-1] += shift
    return w


def fit_toxicity(events: DataFrame, labels: DataFrame, key: str = "event_id", message: str = "message", label: str = "toxic", fit_rows: tuple[int, int] = FIT_ROWS) -> Distance:
    """The two dictionaries and the calibration, from at most ``fit_rows`` whole labelled messages of label 0 and 1."""
    return fit_on_sample(need(events, key, message), need(labels, key, label), key, message, label, fit_rows, fit_distance)


def score_toxicity(events: DataFrame, model: Distance, key: str = "event_id", message: str = "message") -> DataFrame:
    """Toxicity of every whole message: ``key`` and ``score`` (0 to 1, calibrated share of toxic ones).

    Every window of a message is compressed with the ordinary and with the toxic dictionary; the gains of the latter, over all windows, are weighed
    by thresholds calibrated on labelled messages. Rows are judged alone, with no shuffle. Null and empty messages have no window and get the score of
    no gain; repeated rows and null keys are kept; an empty table gives none; further columns are ignored.
    """
    free(key, "score")
    return _judged(need(events, key, message), model, message).select(f"`{key}`", f"{JUDGED}.score")


def drop_toxic(events: DataFrame, model: Distance, message: str = "message", limit: float = 0.5) -> DataFrame:
    """``events`` without those whose score is ``limit`` or more; every column stays as it is."""
    return _judged(events, model, message).where(F.col(f"{JUDGED}.score") < limit).drop(JUDGED)


def _judged(rows: DataFrame, model: Distance, message: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)  # as large as two dictionaries

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        own = held.value
        return [pa.array([own.score((t or "").encode()) for t in batch.column(message).to_pylist()], pa.float64())]

    return judge(rows, message, "score double", score)
