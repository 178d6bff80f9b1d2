"""Cells of a base's points: a vector index that grows with the base.

A point lies in the cell of its nearest centre, and tables have a folder a cell,
so a search reads the cells of the centres nearest to its query.  A base begins
with one cell.  A cell that has grown too large is divided by k-means on a bounded
sample of its points, and only its points move.  How many cells a search has to look into for a given recall depends
on the vectors: it is measured, on points of the base itself, each time cells were divided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells a base has at most (their centres are held by the driver and sent to all tasks), and children of one division.
MOST_CELLS, MOST_CHILDREN = 4096, 64
#: Numbers of the sample from which centres are made, at most, and points of it for each centre.
MOST_SAMPLED, SAMPLED_EACH = 16_000_000, 256
#: The recall that is asked for, the points that stand for queries in measuring it, and the neighbours of each.
RECALL, QUERIES, NEIGHBOURS = 0.95, 64, 10
#: The share of a cell in one child from which on dividing it is given up.
TOO_UNEVEN = 0.9
#: The cell of points without a direction, which no search finds.
NOWHERE = -1


def matrix(packed: pd.Series | list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a packed vector of so many numbers, these vectors)."""
    good = np.array([v is not None and len(v) == 4 * dims for v in packed], bool)
    held = b"".join(v for v, g in zip(packed, good, strict=True) if g)
    return np.flatnonzero(good), np.frombuffer(held, "<f4").reshape(-1, dims)


def spherical_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(unit centres, members of each) by k-means on unit vectors; no centre is without members or equal to another but for rounding."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros((len(c), x.shape[1]), np.float64)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(c))
        full = np.flatnonzero(counts)
        sums[full] = np.add.reduceat(x[order].astype(np.float64), (np.cumsum(counts) - counts)[full])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c).astype(np.float32)
    c = c[~np.any(np.tril(c @ c.T, -1) > 1 - 1e-5, axis=1)]
    counts = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    return c[counts > 0], counts[counts > 0]


@dataclass
class Cells:
    """Numbers, centres and sizes of cells; ``limits`` are the sizes from which on they are divided."""

    numbers: list[int]
    centres: np.ndarray | None
    counts: dict[int, int]
    limits: dict[int, int]
    cell_points: int
    next: int = 1
    probes: int = 1
    recall: float | None = None
    measured: int = 1  # cells when the recall was measured
    changed: bool = field(default=True, repr=False)  # since the centres were written

    @staticmethod
    def one(cell_points: int) -> Cells:
        return Cells([0], None, {}, {0: cell_points}, cell_points)

    def facts(self) -> dict:
        """What a manifest says of the cells; their centres are in a file of their own."""
        return {"numbers": self.numbers, "counts": [self.counts.get(n, 0) for n in self.numbers], "limits": [self.limits[n] for n in self.numbers], "cell_points": self.cell_points, "next": self.next, "probes": self.probes, "recall": self.recall, "measured": self.measured}

    @staticmethod
    def read(spark: SparkSession, path: str, facts: dict) -> Cells:
        numbers = facts["numbers"]
        held = {r["cell"]: r.centre for r in spark.read.parquet(path).collect()} if len(numbers) > 1 else {}
        centres = np.stack([np.frombuffer(held[n], "<f4") for n in numbers]) if held else None
        return Cells(numbers, centres, dict(zip(numbers, facts["counts"], strict=True)), dict(zip(numbers, facts["limits"], strict=True)), *(facts[k] for k in ("cell_points", "next", "probes", "recall", "measured")), changed=False)

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [] if self.centres is None else [(n, c.astype("<f4").tobytes()) for n, c in zip(self.numbers, self.centres, strict=True)]
        spark.createDataFrame(rows, "cell int, centre binary").coalesce(1).write.parquet(path)

    # --- which cell

    def of(self, packed: Column) -> Column:
        """The number of the cell of each packed vector."""
        numbers, centres = np.array(self.numbers, np.int32), self.centres

        def each(vectors: pd.Series) -> pd.Series:
            out = np.full(len(vectors), NOWHERE, np.int32)
            if centres is None:
                out[np.array([v is not None for v in vectors], bool)] = numbers[0]
            else:
                good, x = matrix(vectors, centres.shape[1])
                out[good] = numbers[(x @ centres.T).argmax(axis=1)]
            return pd.Series(out)

        return F.pandas_udf(each, "int")(packed)

    def of_children(self, cell: Column, packed: Column, children: dict[int, tuple[list[int], np.ndarray]]) -> Column:
        """The child in which each point of a divided cell lies."""

        def each(cells: pd.Series, vectors: pd.Series) -> pd.Series:
            out = np.full(len(vectors), NOWHERE, np.int32)
            for parent, (numbers, centres) in children.items():
                mine = np.flatnonzero(cells.to_numpy() == parent)
                good, x = matrix(vectors.iloc[mine], centres.shape[1])
                out[mine[good]] = np.array(numbers, np.int32)[(x @ centres.T).argmax(axis=1)]
            return pd.Series(out)

        return F.pandas_udf(each, "int")(cell, packed)

    def near(self, query: list[float]) -> list[int]:
        """All cells, those of the centres nearest to a query first."""
        if self.centres is None:
            return list(self.numbers)
        return [self.numbers[i] for i in np.argsort(-(self.centres @ np.asarray(query, np.float32)), kind="stable")]

    # --- growing

    def grown(self, added: dict[int, int]) -> list[int]:
        """Counts new points in; the cells that are to be divided.  Points that were removed count until then."""
        for cell, n in added.items():
            if cell != NOWHERE:
                self.counts[cell] = self.counts.get(cell, 0) + n
        return [c for c in self.numbers if self.counts.get(c, 0) > self.limits[c]] if len(self.numbers) < MOST_CELLS else []

    def replace(self, children: dict[int, tuple[list[int], np.ndarray]], counts: dict[int, int]) -> None:
        """Puts children in their parents' place."""
        kept = [i for i, n in enumerate(self.numbers) if n not in children]
        old = self.centres[kept] if self.centres is not None else None
        self.centres = np.concatenate([*([old] if old is not None and len(old) else []), *(c for _, c in children.values())])
        self.numbers = [self.numbers[i] for i in kept] + [n for some, _ in children.values() for n in some]
        self.counts = {n: counts.get(n, self.counts.get(n, 0)) for n in self.numbers}
        # a child may be as large as a cell may be; one that is larger is divided when it has doubled
        self.limits = {n: self.limits.get(n) or max(self.cell_points, 2 * self.counts[n] if self.counts[n] > self.cell_points else 0) for n in self.numbers}
        self.changed = True

    def measure(self, points: DataFrame) -> None:
        """How many cells hold ``RECALL`` of the nearest neighbours of points of the base, over all cells; measured when there are half as many cells again."""
        if self.centres is None or len(self.numbers) < 1.5 * self.measured and self.recall is not None:
            self.probes = max(self.probes, math.ceil(self.probes * len(self.numbers) / max(1, self.measured))) if self.centres is not None else 1
            return
        width = 4 * self.centres.shape[1]
        some = points.where(F.octet_length("packed") == width).select("point_id", "packed").orderBy(F.xxhash64("point_id"), "point_id").limit(QUERIES).collect()
        queries = np.stack([np.frombuffer(r.packed, "<f4") for r in some])
        mine = np.array([r.point_id for r in some], object)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pc.equal(pc.binary_length(batch.column(2)), width))
                if not len(batch):
                    continue
                _, x = matrix(batch.column(2).to_pylist(), width // 4)
                ids, cells = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
                scores = queries @ x.T
                scores[mine[:, None] == ids[None]] = -np.inf
                k = min(NEIGHBOURS, len(ids))
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                which = np.repeat(np.arange(len(queries), dtype=np.int32), k)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(cells[top.ravel()].astype(np.int32)), pa.array(np.take_along_axis(scores, top, axis=1).ravel().astype(np.float64))], names=["query", "cell", "score"])

        found = points.select("point_id", "cell", "packed").mapInArrow(each, "query int, cell int, score double").where(F.col("score") > float("-inf"))
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cell"))
        near = found.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS).select("query", "cell").collect()
        place = [{c: i for i, c in enumerate(self.near(q))} for q in queries]
        depth = np.sort([place[r["query"]].get(r["cell"], len(self.numbers) - 1) for r in near])
        self.probes = int(depth[max(0, math.ceil(RECALL * len(depth)) - 1)]) + 1 if len(depth) else 1
        self.recall = float((depth < self.probes).mean()) if len(depth) else 1.0
        self.measured = len(self.numbers)


def divide(cells: Cells, points: DataFrame, large: list[int]) -> dict[int, tuple[list[int], np.ndarray]]:
    """Children (numbers, centres) of the cells that can be divided; others, of equal points mostly, may double before they are tried again."""
    out: dict[int, tuple[list[int], np.ndarray]] = {}
    for cell in large:
        room = MOST_CELLS - len(cells.numbers) - sum(len(n) - 1 for n, _ in out.values()) + 1
        k = min(MOST_CHILDREN, room, max(2, math.ceil(2 * cells.counts[cell] / cells.cell_points)))
        mine = points.where((F.col("cell") == cell) & F.col("packed").isNotNull()).select("packed")
        first = mine.first()
        x = np.zeros((0, 1), np.float32)
        if first is not None and k > 1:
            dims = len(first.packed) // 4
            rows = mine.orderBy(F.xxhash64("packed")).limit(min(SAMPLED_EACH * k, max(k, MOST_SAMPLED // dims))).collect()
            _, x = matrix([r.packed for r in rows], dims)
        centres, members = spherical_means(x, k) if len(x) else (x, np.zeros(0))
        if len(centres) < 2 or members.max() > TOO_UNEVEN * members.sum():
            cells.limits[cell] = 2 * max(cells.counts[cell], cells.limits[cell])
            continue
        out[cell] = list(range(cells.next, cells.next + len(centres))), centres
        cells.next += len(centres)
    return out
