"""Dense vectors as array<double> Columns, and their exchange format."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite values that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalized(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def similarity(distance: Column, clamped: bool = False) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance) if clamped else 1 - distance


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(b: pd.Series) -> pd.Series:
    """Vectors from little-endian float32 blobs."""
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())
