"""Usable embeddings as packed rows, and samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 96
SAMPLE = 20_000


def usable_rows(lists: pa.Array, dim: int) -> np.ndarray:
    """Which rows hold ``dim`` finite values that are not all zero."""
    n = np.diff(lists.offsets.to_numpy())
    ok = (n == dim) & np.asarray(lists.is_valid())
    i = np.flatnonzero(ok)
    if len(i):
        x = lists.take(pa.array(i)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ok[i] = np.isfinite(x).all(1) & (x != 0).any(1)
    return ok


def usable(df: DataFrame, id_col: str, embedding_col: str, dim: int = DIM) -> DataFrame:
    """(id, v): the usable embeddings, v being their stored values as packed float32.

    Rows with a null id, a null vector or element, another length, NaN, an infinity or only zeros are left out.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = np.flatnonzero(usable_rows(b.column(1), dim))
            if len(i):
                x = b.column(1).take(pa.array(i)).flatten().to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(0).take(pa.array(i)), packed(x.reshape(-1, dim))], names=["id", "v"])

    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).cast("array<float>").alias("e")).where("id is not null and e is not null")
    return d.mapInArrow(kernel, "id long, v binary")


def packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, "f4")
    offsets = np.arange(len(x) + 1, dtype="i4") * (x.shape[1] * 4)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def unpacked(v: pa.Array, dim: int = DIM) -> np.ndarray:
    """The stored values, a row for each."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    if not len(v):
        return np.zeros((0, dim), "f4")
    o = np.frombuffer(v.buffers()[1], "i4", len(v) + 1, v.offset * 4)
    return np.frombuffer(v.buffers()[2], "f4", (o[-1] - o[0]) // 4, int(o[0])).reshape(len(v), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, by way of double precision; huge and tiny ones neither overflow nor vanish."""
    x = x.astype("f8")
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y beside each other, in double precision over the stored values."""
    x, y = x.astype("f8"), y.astype("f8")
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def sample(points: DataFrame, n: int, size: int = SAMPLE) -> np.ndarray:
    """About ``size`` unit vectors, chosen by the hash of the id, in order of the id."""
    every = max(1, n // size)
    t = points.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", "v").toArrow()
    order = np.argsort(t["id"].to_numpy(), kind="stable")
    place, out, at = np.empty(len(order), "i8"), None, 0
    place[order] = np.arange(len(order))
    for v in t["v"].chunks:  # in double precision a part at a time, as the driver is small
        for lo in range(0, len(v), 8192):
            x = unit(unpacked(v.slice(lo, 8192)))
            out = np.empty((len(order), x.shape[1]), "f4") if out is None else out
            out[place[at : at + len(x)]] = x
            at += len(x)
    return out if out is not None else np.zeros((0, DIM), "f4")
