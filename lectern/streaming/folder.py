"""Incremental ingest of a folder: files that have come since the last run, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.engine import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """A stream of (path, content)."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    return stream.load(folder).select("path", "content")


def ingest_available(engine: Engine, kb: str, folder: str, checkpoint: str, per_batch: int = 1000) -> list[dict]:
    """Takes in what is there and not yet done, then stops; what each batch did.

    The checkpoint remembers files; a batch that runs again after a failure finds
    its content in the catalog and adds nothing twice.
    """
    done: list[dict] = []

    def batch(found: DataFrame, number: int) -> None:
        added, bad, same = engine.ingest(kb, found)
        done.append({"batch": number, "added": len(added), "failed": len(bad), "skipped": len(same)})

    query = new_files(engine.spark, folder, per_batch=per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done
