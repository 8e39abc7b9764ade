"""Usable vectors as Arrow blocks: validity, unit length, one row per id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64


def block(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the rows of a list column that are usable vectors."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    ok = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False)
    rows = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    flat = col.filter(ok).flatten()
    x = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def as_list(x: np.ndarray, kind: pa.DataType = pa.float32()) -> pa.Array:
    """A matrix as an Arrow list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel(), type=kind)
    )


def usable(df: DataFrame, id_col: str = "id", vec_col: str = "vector", dim: int = DIM) -> DataFrame:
    """``id, u``: one row per id with a usable vector, at unit length.

    Defined results: null ids, null vectors, vectors of another length than ``dim``, with null,
    NaN or infinite numbers or all zeros are left out; repeated rows give one row; an id with
    several different usable vectors keeps the smallest in array order; extra columns are ignored.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = block(b.column(1), dim)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), as_list(x.astype(np.float32))], ["id", "u"])

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(df[id_col].alias("id"), df[vec_col].alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    units = src.mapInArrow(unit, f"id {kind}, u array<float>")
    return units.groupBy("id").agg(F.min("u").alias("u"))
