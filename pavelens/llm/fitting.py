"""Bounded samples of labelled messages, and models made of them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_on_sample(
    events: DataFrame, labels: DataFrame, key: str, message: str, label: str, rows_per_class: tuple[int, int], fit: Callable[[list[bytes], np.ndarray, float], object]
) -> object:
    """What ``fit(texts, labels, log odds of label 1 among all labels less those in the sample)`` makes of whole labelled messages.

    At most ``rows_per_class`` messages of label 0 and 1 are taken, those of smallest key hash; beyond that bound more input changes neither
    the cost of fitting nor the size of the model. Keys of the sample are broadcast: their number is bounded. Of rows that repeat a key the message of
    smallest hash stands for it, chosen before the rows meet.
    """
    given = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label")).where("_key is not null and _label in (0, 1)").dropDuplicates(["_key"])
    totals = {r["_label"]: r["n"] for r in given.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [given.where(F.col("_label") == k).orderBy(F.xxhash64("_key"), "_key").limit(n) for k, n in enumerate(rows_per_class)]
    sample = events.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{message}`").alias("_text")).join(F.broadcast(taken[0].unionByName(taken[1])), "_key")
    one = F.min(F.struct(F.xxhash64("_text").alias("_hash"), "_text", "_label")).alias("_one")
    sample = sample.groupBy("_key").agg(one).select("_key", "_one._text", "_one._label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            found += zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), batch.column("_label").to_pylist())
        found.sort(key=lambda x: (str(x[0]), x[1] or ""))
        y = np.array([x[2] for x in found], np.int64)
        n = [totals.get(k, 0) for k in (0, 1)]
        shift = np.log((n[1] + 0.5) / (n[0] + 0.5)) - np.log(((y == 1).sum() + 0.5) / ((y == 0).sum() + 0.5))
        model = fit([(x[1] or "").encode() for x in found], y, float(shift))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # keys and texts of the bounded sample alone meet in this one task
    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], np.zeros(0, np.int64), 0.0)
