"""Tables of vectors as integers, for operators that must be exact.

A vector's components become integers floor(scale * x), packed four little-endian
bytes each into one binary value, so every distance and sum below is the same on
any machine and in any order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import tidy

#: Doubles hold all integers below this.
EXACT_DOUBLE = 1 << 53


def largest_component(dims: int) -> int:
    """The largest integer a component may be so that four times a squared distance of ``dims`` components is a long; larger ones are held at it."""
    return min((1 << 31) - 1, int((2**60 / max(1, dims)) ** 0.5) // 2)


def integer_rows(df: DataFrame, vector_col: str, scale: int, dims: int | None = None) -> DataFrame:
    """(row, n, packed): the rows of ``df`` whose vector is whole, as integers.

    Rows go whose vector is null, empty, or holds null, NaN or an infinity; with
    ``dims`` also those of any other number of components.  ``row`` is a struct of
    all other columns, so no name can clash; ``n`` is the number of components.
    """
    others = [c for c in df.columns if c != vector_col]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{vector_col}`").alias("v"))
    schema = T.StructType([rows.schema["row"], T.StructField("n", T.IntegerType()), T.StructField("packed", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten()  # of the rows that are not null
            missing = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
            x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x) if missing is None else missing | ~np.isfinite(x))])
            good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            if dims is not None:
                good &= sizes == dims
            limit = np.repeat([largest_component(int(s)) for s in sizes], sizes) if len(set(sizes)) > 1 else largest_component(int(sizes[0]) if len(sizes) else 1)
            whole = np.floor(x * scale, where=np.isfinite(x), out=np.zeros_like(x))
            data = np.clip(whole, -limit, limit).astype("<i4")[np.repeat(good, sizes)]
            offsets = np.concatenate([[0], np.cumsum(sizes[good] * 4)]).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
            kept = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept, pa.array(sizes[good].astype(np.int32)), packed], schema=pa.schema([("row", kept.type), ("n", pa.int32()), ("packed", pa.binary())]))

    return rows.mapInArrow(tidy(each), schema)


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """A batch of packed vectors of ``dims`` components as a matrix, one copy."""
    first, last = (np.frombuffer(column.buffers()[1], np.int32)[column.offset + i] for i in (0, len(column))) if len(column) else (0, 0)
    return np.frombuffer(column.buffers()[2], np.uint8, last - first, first).view("<i4").reshape(len(column), dims) if len(column) else np.zeros((0, dims), np.int32)


def exact(*of: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which squared distances between their rows are exact: doubles where they fit, as they are faster."""
    most = max([int(np.abs(m).max()) for m in of if m.size] or [0])
    dims = max(m.shape[-1] for m in of)
    return [m.astype(np.float64 if 4 * most * most * dims < EXACT_DOUBLE else np.int64) for m in of]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, or to one row."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def sums_of(groups: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each of ``n`` groups, and their componentwise sums."""
    order = np.argsort(groups, kind="stable")
    counts = np.bincount(groups, minlength=n)
    out = np.zeros((n, x.shape[1]), np.int64)
    full = np.flatnonzero(counts)
    if len(full) and x.shape[1]:
        out[full] = np.add.reduceat(x[order].astype(np.int64), (np.cumsum(counts) - counts)[full])
    return counts, out


def floor_means(old: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); rows without a count stay as they were."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], old)
