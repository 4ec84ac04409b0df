"""Vector kernels. Distances are squared L2, never rooted; integer inputs give exact BIGINT results.

Arrow-batched: a batch's lists are flattened once and numpy does the arithmetic. `*_expr` are the same formulas as
built-in higher-order functions, for plans that must stay inside the JVM (they are interpreted, and slower).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matrix(lists: pa.Array, dtype) -> np.ndarray:
    flat = np.asarray(lists.flatten(), dtype=dtype)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _checked(a: pa.Array, b: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    x, y = _matrix(a, dtype), _matrix(b, dtype)
    if x.shape != y.shape:
        raise ValueError(f"vectors of {x.shape[1]} and {y.shape[1]} components")
    return x, y


@F.arrow_udf(T.LongType())
def l2_u8(a: pa.Array, b: pa.Array) -> pa.Array:
    """Squared L2 of integer vectors, exact."""
    x, y = _checked(a, b, np.int64)
    return pa.array(((x - y) ** 2).sum(1, dtype=np.int64))


@F.arrow_udf(T.DoubleType())
def l2_f32(a: pa.Array, b: pa.Array) -> pa.Array:
    """Squared L2 of float vectors, in doubles."""
    x, y = _checked(a, b, np.float64)
    return pa.array(((x - y) ** 2).sum(1, dtype=np.float64))


@F.arrow_udf(T.LongType())
def dot_u8(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = _checked(a, b, np.int64)
    return pa.array((x * y).sum(1, dtype=np.int64))


def l2_expr(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def dot_expr(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def quantise(v) -> Column:
    """Components of [-1, 1] as integers of 0..255."""
    return F.transform(v, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


def shift(v) -> Column:
    """0..255 to -128..127 and, applied to the result plus 256, back; distances stay the same."""
    return F.transform(v, lambda x: x - 128)


def unshift(v) -> Column:
    return F.transform(v, lambda x: x + 128)


def score_of(distance) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def distance_of(score) -> Column:
    return F.lit(1.0) / score - F.lit(1.0)


def projection(v) -> Column:
    """Dot product with a fixed direction, ((37 i) mod 17) - 8 at component i."""
    return F.aggregate(F.transform(v, lambda x, i: x * ((i * 37) % 17 - 8)), F.lit(0).cast("bigint"), lambda s, x: s + x)
