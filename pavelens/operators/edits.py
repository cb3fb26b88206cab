"""Replaying manual edits on the detections of a view."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["filename", "view"]
BATCH_ROWS = 10_000
_PLAN = "filename string, view string, det_idx long, base_idx long, add_seq long, outline_seq long, class_seq long"


def _replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turn (filename, view, seq, action, idx) rows, in order, into the final list per view.

    The first row of a view has the action 'size' and its number of detections. Items
    are [base_idx, add_seq, outline_seq, class_seq].
    """
    view, items, rows = None, [], []

    def frame():
        return pd.DataFrame(rows, columns=["filename", "view", "det_idx", "base_idx", "add_seq", "outline_seq", "class_seq"]).astype(
            {c: "Int64" for c in ("base_idx", "add_seq", "outline_seq", "class_seq")}
        )

    for part in parts:
        for filename, name, seq, action, idx in part.itertuples(index=False):
            if (filename, name) != view:
                if view is not None:
                    rows.extend((*view, i, *item) for i, item in enumerate(items))
                if len(rows) >= BATCH_ROWS:
                    yield frame()
                    rows = []
                view, items = (filename, name), []
            idx = None if pd.isna(idx) else int(idx)
            known = idx is not None and 0 <= idx < len(items)
            if action == "size":
                items = [[i, None, None, None] for i in range(idx)]
            elif action == "add" or (action == "add_corridor" and not known):
                items.append([None, seq, None, None])
            elif action == "add_corridor":
                items[idx] = [None, seq, None, None]
            elif action == "re-outline" and known:
                items[idx][2] = seq
            elif action == "update" and known:
                items[idx][3] = seq
            elif action == "delete" and known:
                items.pop(idx)
    if view is not None:
        rows.extend((*view, i, *item) for i, item in enumerate(items))
        yield frame()


def replay_edits(det: DataFrame, log: DataFrame) -> DataFrame:
    """Detections after all edits, in order of ``seq`` per (filename, view).

    det: filename, view, det_idx (0..n-1), class_name, points. log: filename, view, seq,
    action, det_idx, class_name, points. add appends, add_corridor replaces a valid
    index or appends, re-outline swaps the polygon, update the class, delete removes
    and shifts later indexes. Edits on indexes that do not exist are ignored.

    Only edited views are replayed, on index columns alone and as a stream of sorted
    batches; polygons and classes are joined back by key.
    """
    edited = log.select(*KEYS).distinct()
    sizes = edited.join(det.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("idx")), KEYS, "left").select(
        *KEYS, F.lit(-1).cast("long").alias("seq"), F.lit("size").alias("action"), F.coalesce("idx", F.lit(0)).cast("long").alias("idx")
    )
    steps = sizes.unionByName(log.select(*KEYS, F.col("seq").cast("long").alias("seq"), "action", F.col("det_idx").cast("long").alias("idx")))
    plan = steps.repartition(*KEYS).sortWithinPartitions(*KEYS, "seq").mapInPandas(_replay, _PLAN)
    base = det.select(*KEYS, F.col("det_idx").cast("long").alias("base_idx"), F.col("class_name").alias("_bc"), F.col("points").alias("_bp"))
    step = lambda at, *cols: log.select(*KEYS, F.col("seq").cast("long").alias(at), *[F.col(c).alias(f"_{at}_{c}") for c in cols])
    full = (
        plan.join(base, [*KEYS, "base_idx"], "left")
        .join(step("add_seq", "class_name", "points"), [*KEYS, "add_seq"], "left")
        .join(step("outline_seq", "points"), [*KEYS, "outline_seq"], "left")
        .join(step("class_seq", "class_name"), [*KEYS, "class_seq"], "left")
    )
    done = full.select(
        *KEYS,
        "det_idx",
        F.coalesce("_class_seq_class_name", "_add_seq_class_name", "_bc").alias("class_name"),
        F.coalesce("_outline_seq_points", "_add_seq_points", "_bp").alias("points"),
        F.col("outline_seq").isNotNull().alias("reoutlined"),
    )
    rest = det.join(edited, KEYS, "left_anti").select(
        *KEYS, F.col("det_idx").cast("long").alias("det_idx"), "class_name", "points", F.lit(False).alias("reoutlined")
    )
    return done.unionByName(rest)
