"""Vector codes of a byte a part, with entries found by annular norm pruning.

A vector is cut into parts, and each part is coded by the nearest entry of its
own codebook.  Entries are sorted by norm.  A part starts at the entry whose norm
is next to its own; as no entry whose norm differs by more than the best distance
so far can be nearer, a binary search gives the interval of norms that is left.
The interval is looked at from the inside out and cut anew by what was found,
until all of it was seen.  Its ends are included, so equal
distances are all compared and go to the lower index.

Codebooks are means of what is assigned to their entries: each task adds up
counts and sums, and only these, a row an entry and component, go to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.integer_vectors import EXACT_DOUBLE, exact, floor_means, integer_rows, squared, sums_of, unpacked
from lectern.llm.shared import Scratch, prepare_workers, tidy

#: Entries on each side of a part's norm that are looked at before the interval is cut anew.
STEP = 16
#: Rows, of like norms, whose distances are worked out together.
ROWS_TOGETHER = 256
#: A distance beyond all others, in doubles and longs.
FAR = 1 << 62


def parts_of(dims: int, parts: int) -> list[slice]:
    """Consecutive parts, equal ones where ``parts`` divides ``dims``; else the first have one component more."""
    ends = np.cumsum([dims // parts + (i < dims % parts) for i in range(parts)])
    return [slice(int(a), int(b)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codebook:
    """Entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        (e,) = exact(entries)
        norms = np.sqrt(np.einsum("ij,ij->i", e, e).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.order], norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance) of each row, and how many distances it took."""
        x, e = exact(x, self.entries)
        q, s = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", e, e)
        n = np.sqrt(q.astype(np.float64))
        index, best, taken = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), 0
        # rows of like norms have like intervals, so the distances of some together are one product of matrices
        by_norm = np.argsort(n, kind="stable")
        for start in range(0, len(x), ROWS_TOGETHER):
            rows = by_norm[start : start + ROWS_TOGETHER]
            index[rows], best[rows], some = self._nearest(x[rows], q[rows], n[rows], e, s)
            taken += some
        return index, best.astype(np.int64), taken

    def _nearest(self, x: np.ndarray, q: np.ndarray, n: np.ndarray, e: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        ranked = (-2.0 * len(e) * x, e.T, len(e) * s + self.order) if x.dtype == np.float64 and 4 * float(max(q.max(), s.max())) * len(e) < EXACT_DOUBLE else None
        at = np.minimum(np.searchsorted(self.norms, n), len(e) - 1)
        best, index, taken = squared(x, e[at]), self.order[at], len(x)

        def look(a: int, b: int) -> int:
            """Looks at entries a to b, of each row at those within its interval."""
            reach = np.sqrt(best.astype(np.float64))
            # norms and roots are rounded: an interval that is wider by more than that loses nothing
            slack = 1e-9 * (n + reach + 1)
            low, high = np.searchsorted(self.norms, n - reach - slack, side="left"), np.searchsorted(self.norms, n + reach + slack, side="right")
            a, b = max(a, int(low.min())), min(b, int(high.max()))
            if a >= b:
                return 0
            if int(low.max()) <= a and int(high.min()) >= b:
                inside, seen = None, len(x) * (b - a)
            else:
                place = np.arange(a, b)
                inside = (place >= low[:, None]) & (place < high[:, None])
                seen = int(inside.sum())
            if ranked is not None:
                # distance and index as one number: of equal distances the lowest index is the least
                d = ranked[0] @ ranked[1][:, a:b]
                d += ranked[2][a:b]
                if inside is not None:
                    d[~inside] = FAR
                least, which = np.divmod(d.min(axis=1) + q * len(e), len(e))
                which = which.astype(np.int64)
            else:
                d = q[:, None] + s[a:b] - 2 * (x @ e[a:b].T)
                if inside is not None:
                    d[~inside] = FAR
                least = d.min(axis=1)
                which = np.where(d == least[:, None], self.order[a:b], len(e)).min(axis=1)
            better = (least < best) | (least == best) & (which < index)
            best[better], index[better] = least[better], which[better]
            return seen

        first, last = max(0, int(at.min()) - STEP), min(len(e), int(at.max()) + STEP + 1)
        for a, b in ((first, last), (0, first), (last, len(e))):  # from the inside out, the interval cut anew each time
            taken += look(a, b)
        return index, best, taken


@dataclass
class Codes:
    """``vectors`` (row, code, error) and the final codebooks, a matrix of entries a part."""

    vectors: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """sha256 of all components, by part, entry and place in the part."""
        said = ",".join(str(v) for book in self.codebooks for v in book.ravel().tolist())
        return hashlib.sha256(said.encode()).hexdigest()


def _gathered(vectors: DataFrame, books: list[np.ndarray], cuts: list[slice], dims: int) -> list[np.ndarray]:
    """The codebooks after one round: means of what is assigned to their entries."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in sent.value]
        counts = [np.zeros(len(b), np.int64) for b in sent.value]
        sums = [np.zeros(b.shape, np.int64) for b in sent.value]
        for batch in batches:
            x = unpacked(batch.column(0), dims)
            for p, cut in enumerate(cuts):
                n, s = sums_of(held[p].nearest(x[:, cut])[0], x[:, cut], len(counts[p]))
                counts[p] += n
                sums[p] += s
        for p, (n, s) in enumerate(zip(counts, sums, strict=True)):
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), p, np.int32)), pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(list(s[full]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    told = vectors.select("packed").mapInArrow(tidy(each), "part int, entry int, n long, sums array<long>")
    # the count goes first, as one more component
    rows = told.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect()
    counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
    for r in rows:
        if r["at"]:
            sums[r.part][r.entry, r["at"] - 1] = r.x
        else:
            counts[r.part][r.entry] = r.x
    return [floor_means(b, n, s) for b, n, s in zip(books, counts, sums, strict=True)]


def compress(spark: SparkSession, df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes | None:
    """Codes of the vectors of ``df``, whose components become integers floor(scale * x).

    Rows go whose vector is null, empty or holds null or non-finite components, and
    those whose number of components is not the one most rows have (of equally many
    rows: the larger).  Each codebook starts as its part of the vectors with the
    ``entries`` least ids (at most 256; rows of equal ids in the order of their vectors, rows without
    one last; fewer rows give fewer entries).  Each round assigns every part to the
    nearest entry (ties: lower index) and moves entries to the componentwise floor of
    the mean of their parts; unused ones stay.  Then parts are assigned once more:
    ``code`` has two hex digits a part, ``error`` is the squared distance summed over
    parts.  Repeated rows are vectors of their own.  None for a table without
    vectors.  Components beyond ``largest_component`` are held at it.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, as a code has a byte a part")
    prepare_workers(spark)
    scratch = Scratch(spark)
    vectors = scratch.keep(integer_rows(df, vector_col, scale), "vectors")
    common = vectors.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return None
    dims = common.n
    vectors = vectors.where(F.col("n") == dims)
    start = vectors.select(F.col(f"row.`{id_col}`").alias("id"), "packed").orderBy(F.asc_nulls_last("id"), "packed").limit(entries).collect()
    first = np.stack([np.frombuffer(r.packed, "<i4") for r in start]).astype(np.int64)
    cuts = parts_of(dims, parts)
    books = [first[:, cut] for cut in cuts]
    for _ in range(rounds):
        books = _gathered(vectors, books, cuts, dims)
    sent = spark.sparkContext.broadcast(books)
    schema = T.StructType([vectors.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in sent.value]
        for batch in batches:
            x = unpacked(batch.column(1), dims)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, cut in enumerate(cuts):
                code[:, p], d, _ = held[p].nearest(x[:, cut])
                error += d
            said = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([said[i : i + 2 * parts] for i in range(0, len(said), 2 * parts)], pa.string()), pa.array(error)], names=["row", "code", "error"])

    coded = scratch.keep(vectors.select("row", "packed").mapInArrow(tidy(each), schema), "codes")
    scratch.drop("vectors")
    return Codes(coded, books)
