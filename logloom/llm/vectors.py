"""Vectors as bytes of doubles, so that tasks read them without copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, _v``: rows whose vector is not null or empty, not zero, and has finite components only."""
    rows = df.select(df[id_col].cast("bigint").alias("_id"), df[vector_col].cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("_v").isNotNull() & finite & F.exists("_v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def dimension(vectors: DataFrame) -> int:
    """The length of all vectors (0 without rows); different lengths are an error."""
    least, most = vectors.select(F.min(F.size("_v")), F.max(F.size("_v"))).first()
    if least != most:
        raise ValueError(f"vectors have between {least} and {most} components")
    return least or 0


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of usable vectors in a list column, and each scaled to length one."""
    column = pc.fill_null(column, []) if column.null_count else column
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    sizes, kept, units = np.diff(offsets), [], []
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        part = flat[offsets[rows][:, None] + np.arange(size)]
        largest = np.abs(part).max(axis=1)
        good = np.isfinite(largest) & (largest > 0)
        # Scaled first, so that no square over- or underflows; adding zero turns -0 into 0.
        part = part[good] / largest[good][:, None]
        units.append(part / np.sqrt((part * part).sum(axis=1))[:, None] + 0.0)
        kept.append(rows[good])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), units


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, _v, _same``: usable vectors with an id, of length one, and a digest that equal ones share."""
    rows = df.select(df[id_col].cast("bigint").alias("_id"), df[vector_col].cast("array<double>").alias("_v")).filter("_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, units = _units(batch.column("_v"))
            if not len(kept):
                continue
            sizes = np.concatenate([np.full(len(u), u.shape[1]) for u in units])
            same = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for u in units for v in u]
            vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([u.ravel() for u in units])))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(kept)), vectors, pa.array(same, pa.binary())], names=["_id", "_v", "_same"])

    return rows.mapInArrow(run, "_id bigint, _v array<double>, _same binary")
