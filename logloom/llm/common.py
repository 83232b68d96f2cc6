"""Shared helpers of the training-data operators: columns, bounded batches, task identity."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one step inside a task works on; a single longer text is a step of its own.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only ``_id`` and ``_text`` (UTF-8 bytes, null text: empty) and ``more``, so that no other column can clash."""
    return docs.select(
        docs[id_col].cast("bigint").alias("_id"),
        F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("_text"),
        *more,
    )


def steps(batches: Iterator[pa.RecordBatch], column: str = "_text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Memory that a task has freed goes back to the system; a Python worker serves many stages and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a binary or string column without nulls."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    return np.diff(offsets[column.offset : column.offset + len(column) + 1]).astype(np.int64)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and the offsets of each."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def as_text(column: pa.Array) -> pa.Array:
    """UTF-8 strings of a binary column; malformed bytes become U+FFFD."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in column.to_pylist()], pa.string())


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, …`` of every range, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=np.int64)


def task_number() -> tuple[int, int]:
    """Partition and attempt of the running task."""
    context = TaskContext.get()
    return (context.partitionId(), context.taskAttemptId()) if context else (0, 0)


def rows_of(values: dict[str, np.ndarray | list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in zip(schema, values.values(), strict=True)],
        schema=schema,
    )


def without_broken_characters(kept: bytes, cuts: list[int]) -> bytes:
    """``kept`` without the bytes of characters that were broken at ``cuts``, positions where something was taken out."""
    parts = [kept[a:b] for a, b in zip([0, *cuts], [*cuts, len(kept)], strict=True)]
    for i, part in enumerate(parts):
        if i:
            begin = 0
            while begin < len(part) and part[begin] & 0xC0 == 0x80:
                begin += 1
            part = part[begin:]
        if i < len(cuts):
            for back in range(1, min(3, len(part)) + 1):
                byte = part[-back]
                if byte & 0xC0 != 0x80:
                    if byte >= 0xC0 and back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                        part = part[:-back]
                    break
        parts[i] = part
    return b"".join(parts)
