"""What the operators on integer vectors share: vectors with whole components, exact products in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def floored(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v) with every component x as floor(scale * x), x as a double, beyond a long its ends. Rows whose
    vector is null or holds a null or non-finite component are left out."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: _finite(x.cast("double")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` longs each, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def largest(x: np.ndarray) -> int:
    """The largest magnitude in x, as a Python number."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def exact(bound: int) -> type:
    """The number type in which results up to ``bound`` come out exact: doubles where they do, as they are fastest."""
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
