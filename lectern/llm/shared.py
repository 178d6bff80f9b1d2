"""Tables in the folder that driver and executors share, and helpers on graphs.

Long plans are cut by writing a table to the folder named by
``spark.checkpoint.dir`` and reading it back: the files survive lost executors
and are computed once.  A folder of our own is set only where none is set and
Spark is one process.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import bound_batches, shared_folder, ship_package


def prepare_workers(spark: SparkSession) -> None:
    """Bounds the batches of this session's Python operators by size, as texts may be long, and sends them this package."""
    ship_package(spark)
    bound_batches(spark)


def tidy(each):
    """Wraps a batch function so that a worker gives freed memory back when its task ends; workers outlive tasks."""

    def run(batches):
        try:
            yield from each(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not in every C library
                pass

    return run


class Scratch:
    """Written tables of one run, each dropped when it is no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` once and returns a reader of what was written."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(c: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; null for null."""
    return F.crc32(c.cast("string").cast("binary")) % mod


def large_strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())


#: Rows of one file of a round's tables, about.
ROWS_OF_A_FILE = 250_000


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (u, v) with the smallest node it reaches.

    Alternating large-star and small-star steps: each is a minimum aggregation
    (combined map-side, so a node of very many edges costs one row a task) and
    an equi-join, with no neighbour lists in memory.  The minima are written
    before they are joined, so the join deals out both sides itself and a node of
    very many edges can be split.  Stops when a round leaves the edges as they were.
    """
    e = scratch.keep(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0"
    )

    def keep(df: DataFrame, table: str) -> DataFrame:
        # files and tasks follow the edges that are left, not the session's setting
        return scratch.keep(df.coalesce(1 + was[0] // ROWS_OF_A_FILE), f"{name}-{table}")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(e)
    for i in range(1, most_rounds):
        if not was[0]:
            break
        # large star: larger neighbours of a node go to the least of it and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours, and the node itself, go to the least of them
        big = keep(big.where("u <> v").distinct(), "big")
        low = keep(big.groupBy("u").agg(F.min("v").alias("m")), "low")
        out = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = keep(out.distinct(), str(i))
        now = state(new)
        scratch.drop(f"{name}-{i - 1}", f"{name}-least", f"{name}-big", f"{name}-low")
        e, same = new, now == was
        was = now
        if same:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
