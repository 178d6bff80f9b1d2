"""Vector functions over ARRAY<FLOAT>, summed in DOUBLE."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n).cast("float"))


def _by_size(values: pd.Series, kind: str, make) -> pd.Series:
    """Makes binary values of vectors, those of one length as one matrix; None for null, empty and zero vectors."""
    out = np.full(len(values), None, object)
    sizes = np.array([0 if v is None else len(v) for v in values])
    for size in np.unique(sizes[sizes > 0]):
        mine = np.flatnonzero(sizes == size)
        some = [values.iloc[i] for i in mine]
        x = np.frombuffer(b"".join(some), kind).reshape(len(mine), -1) if kind != "list" else np.stack(some)
        out[mine] = make(x)
    return pd.Series(out, dtype=object)


def _packed_rows(x: np.ndarray) -> list[bytes | None]:
    x = x.astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = n > 0
    unit = np.divide(x, n[:, None], where=good[:, None], out=np.zeros_like(x)).astype("<f4")
    return [r.tobytes() if g else None for r, g in zip(unit, good, strict=True)]


def coarse_rows(x: np.ndarray) -> list[bytes]:
    step = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    whole = np.rint(x / step[:, None]).astype(np.int8)
    return [r.tobytes() + s.tobytes() for r, s in zip(whole, step.astype("<f4"), strict=True)]


def packed(a: Column) -> Column:
    """The unit vector, four little-endian bytes a number; null for null and zero vectors."""
    return F.pandas_udf(lambda vectors: _by_size(vectors, "list", _packed_rows), "binary")(a)


def coarse(packed: Column) -> Column:
    """A packed vector in whole steps, a byte a number, and the step behind them."""
    return F.pandas_udf(lambda vectors: _by_size(vectors, "<f4", coarse_rows), "binary")(packed)
