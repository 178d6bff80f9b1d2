"""Centroid clustering by sort-means, exact on integers.

Each round orders, for every centroid, all others by their distance from it.  A
vector starts at the centroid it was assigned to before and goes through that
one's order; it stops at the first centroid that is strictly farther from there
than twice the vector's own distance to it, as by the triangle inequality none
from there on can be as near.  What equals the bound is still looked at, so ties
are decided by number alone.

A round is one pass: the written vectors with their last assignment are read,
assigned anew and written, and each task adds the counts and sums of its clusters
as rows of their own.  Only these sums, one row a cluster and component, go to
the driver.
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

from lectern.llm.integer_vectors import exact, floor_means, integer_rows, squared, sums_of, unpacked
from lectern.llm.shared import Scratch, prepare_workers, tidy

ROWS, SUMS = 0, 1


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all of them by distance from it (itself first), and those squared distances."""
    (c,) = exact(centroids)
    far = np.stack([squared(c, row) for row in c])
    far[np.arange(len(c)), np.arange(len(c))] = -1  # before any equal to it
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(far, order, axis=1), 0)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, equal distances to the smaller number; and how many distances it took."""
    x, c = exact(x, centroids)
    cluster, best = before.copy(), squared(x, c[before])
    taken = len(x)
    for a in np.unique(before):
        mine = np.flatnonzero(before == a)
        # centroids that are no farther than twice the distance, squared
        reach = np.searchsorted(far[a], 4 * best[mine], side="right")
        mine = mine[np.argsort(-reach, kind="stable")]
        reach = np.sort(reach)[::-1]
        for place in range(1, int(reach[0]) if len(reach) else 0):
            some = mine[: np.searchsorted(-reach, -place, side="left")]
            j = order[a, place]
            d = squared(x[some], c[j])
            taken += len(some)
            better = (d < best[some]) | (d == best[some]) & (j < cluster[some])
            cluster[some[better]], best[some[better]] = j, d[better]
    return cluster, best.astype(np.int64), taken


@dataclass
class Clustering:
    """``vectors`` (row, cluster, distance), the centroids, and the distance summed over each cluster."""

    vectors: DataFrame
    centroids: np.ndarray
    inertia: np.ndarray

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def _round(spark: SparkSession, vectors: DataFrame, centroids: np.ndarray, scratch: Scratch, name: str) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Assigns all vectors and writes them: (vectors, counts, sums, inertia of the clusters)."""
    k, dims = centroids.shape
    sent = spark.sparkContext.broadcast((centroids, *orders(centroids)))
    row = vectors.schema["row"]
    schema = T.StructType([row, *(T.StructField(n, t) for n, t in (("packed", T.BinaryType()), ("cluster", T.IntegerType()), ("distance", T.LongType()), ("n", T.LongType()), ("sums", T.ArrayType(T.LongType())), ("kind", T.IntegerType())))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, order, far = sent.value
        counts, sums, inertia, kind = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            x = unpacked(batch.column(1), dims)
            cluster, distance, _ = assign(x, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), c, order, far)
            n, s = sums_of(cluster, x, k)
            counts, sums = counts + n, sums + s
            np.add.at(inertia, cluster, distance)
            none = [pa.nulls(len(batch), t) for t in (pa.int64(), pa.list_(pa.int64()))]
            yield _batch([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), *none, pa.array(np.full(len(batch), ROWS, np.int32))])
        if kind is not None:
            full = np.flatnonzero(counts)
            none = [pa.nulls(len(full), t) for t in (kind, pa.binary())]
            yield _batch([*none, pa.array(full.astype(np.int32)), pa.array(inertia[full]), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64())), pa.array(np.full(len(full), SUMS, np.int32))])

    vectors.select("row", "packed", "cluster").mapInArrow(tidy(each), schema).write.partitionBy("kind").parquet(scratch.path(name))
    written = spark.read.schema(schema).parquet(scratch.path(name))
    told = written.where(F.col("kind") == SUMS)
    counts, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in told.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("d")).collect():
        counts[r.cluster], inertia[r.cluster] = r.n, r.d
    for r in told.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        sums[r.cluster, r.at] = r.x
    return written.where(F.col("kind") == ROWS).select("row", "packed", "cluster", "distance"), counts, sums, inertia


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["row", "packed", "cluster", "distance", "n", "sums", "kind"])


def cluster(spark: SparkSession, df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, salt: str = "2:") -> Clustering | None:
    """Clusters the vectors of ``df`` of exactly ``dims`` components, none null or non-finite, as integers floor(scale * x).

    Centroids start as the ``k`` vectors of the least sha256 of ``salt`` and the id, in
    that order; rows of equal ids are in the order of their vectors, rows without an id come last.
    Each round assigns every vector to the nearest centroid (ties: smaller number)
    and moves the centroids of clusters that aren't empty to the componentwise floor
    of the mean; then vectors are assigned once more.  Repeated rows are vectors of
    their own; with fewer than ``k`` vectors there are as many centroids.  None for a
    table without such vectors.  Components beyond ``largest_component(dims)`` are held
    at it.  ``row`` of the result holds all columns but the vector, which are written
    once a round: hand over only those that are needed.
    """
    prepare_workers(spark)
    scratch = Scratch(spark)
    vectors = scratch.keep(integer_rows(df, vector_col, scale, dims), "vectors")
    least = F.sha2(F.concat(F.lit(salt), F.col(f"row.`{id_col}`").cast("string")), 256)
    start = vectors.select(least.alias("h"), "packed").orderBy(F.asc_nulls_last("h"), "packed").limit(k).collect()
    if not start:
        return None
    centroids = np.stack([np.frombuffer(r.packed, "<i4") for r in start]).astype(np.int64)
    vectors, last = vectors.withColumn("cluster", F.lit(0)), "vectors"
    for i in range(rounds + 1):
        vectors, counts, sums, inertia = _round(spark, vectors, centroids, scratch, f"round-{i}")
        scratch.drop(last)
        last = f"round-{i}"
        if i < rounds:
            centroids = floor_means(centroids, counts, sums)
    return Clustering(vectors.select("row", "cluster", "distance"), centroids, inertia)
