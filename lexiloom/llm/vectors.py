"""What the operators on embeddings share: reading vectors, matrices of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, ranges


def packed_rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    at = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])


def usable(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of floats: which rows are neither null nor empty and all finite; all values; where each row's begin."""
    at = col.offsets.to_numpy()
    x = col.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls are NaN
    at = at - at[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    return ~col.is_null().to_numpy(zero_copy_only=False) & (np.diff(at) > 0) & (bad[at[1:]] == bad[at[:-1]]), x, at


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, row (a number of its own, as the ids may be null or repeat), vec (float32 bytes), dim; without null, empty and not finite vectors."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in it:
            ok, x, at = usable(b.column(1))
            n = np.diff(at)[ok]
            flat = x if ok.all() else x[ranges(at[:-1][ok], n)]
            ends = np.concatenate([[0], np.cumsum(n * 4)]).astype(np.int32)
            vec = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(np.arange(row, row + len(n))), vec, pa.array(n, pa.int32())], ["id", "row", "vec", "dim"])
            row += len(n)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return src.mapInArrow(run, "id long, row long, vec binary, dim int")


def usual_dim(v: DataFrame) -> int:
    """The most frequent dimension, the least of equally frequent ones; 0 for none."""
    got = v.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
    return int(got.dim) if got else 0


def matrix(col: pa.Array, dim: int, kind: type = np.float32) -> np.ndarray:
    return binary_parts(col)[0].view(kind).reshape(-1, dim)
