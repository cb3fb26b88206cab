"""Small helpers of the operators in this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from ..session import shared_dir
from .words import SLICE_BYTES, gathered

JUDGED = "_judged"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and no executor holds it."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after which the worker gives freed memory back: Spark keeps workers for later stages, which would add theirs to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns``, so that further columns of the caller never clash with ours."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}; there are {df.columns}")
    return df.select(*[f"`{c}`" for c in columns])


def free(key: str, *taken: str) -> None:
    """The key keeps its name in the result, so it may not be one of the result's own."""
    if key in taken:
        raise ValueError(f"key column {key} has the name of a result column")


def judge(rows: DataFrame, text: str, fields: str, fn: Callable[[pa.RecordBatch], list[pa.Array]], limit: int = SLICE_BYTES) -> DataFrame:
    """``rows`` and a struct column ``_judged`` of ``fields``, which ``fn`` makes of slices of about ``limit`` bytes of ``text``.

    Row by row and without a shuffle, so every column of the caller comes along.
    """
    if JUDGED in rows.columns:
        raise ValueError(f"column {JUDGED} is taken")
    kind = StructType.fromDDL(fields)
    schema = StructType([*rows.schema.fields, StructField(JUDGED, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, text, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fn(batch), kind.names)], schema.names)

    return rows.mapInArrow(lean(run), schema)
