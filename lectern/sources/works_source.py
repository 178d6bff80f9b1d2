"""Works of a bibliographic service as a data source: ``spark.read.format("works")``.

The keys that are asked for lie in a folder of files, each a range of them; a file
is a partition, so a lost task asks for its own keys again and for no others.  Each
partition asks no faster than its share of the rate that is allowed, tries again what
may pass, and leaves out what the service doesn't have or can't give.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.errors import ServiceUnavailable
from lectern.services import RECORD_SECONDS, Transport, send, urllib_transport
from lectern.session import shared_folder

SCHEMA = "doi string, message string"
#: Keys of a partition, about, and answers of a batch.
KEYS_OF_A_PARTITION, BATCH = 2000, 200


class KeyRange(InputPartition):
    """A file of keys."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WorksReader(DataSourceReader):
    def __init__(self, files: list[str], transport: Transport, per_second: float, retries: int):
        self.files, self.transport, self.per_second, self.retries = files, transport, per_second, retries

    def partitions(self) -> list[KeyRange]:
        return [KeyRange(path) for path in self.files]

    def ask(self, doi: str) -> str | None:
        """A work's message as JSON; a miss is None."""
        url = f"https://api.crossref.org/works/{quote(doi, safe='')}"
        try:
            status, data = send(self.transport, "GET", url, {"User-Agent": "lectern"}, None, RECORD_SECONDS, self.retries)
            message = json.loads(data).get("message") if status == 200 else None
        except (ServiceUnavailable, ValueError, AttributeError):
            return None
        return json.dumps(message) if isinstance(message, dict) else None

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(partition.path)
        gap = len(self.files) / self.per_second if self.per_second else 0.0
        with store.open_input_file(path) as f:
            keys = pq.ParquetFile(f)
            for batch in keys.iter_batches(BATCH, columns=["doi"]):
                dois, messages, due = batch.column(0).to_pylist(), [], time.monotonic()
                for doi in dois:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + gap
                    messages.append(self.ask(doi))
                held = [m is not None for m in messages]
                yield pa.RecordBatch.from_arrays([pa.array(dois, pa.string()).filter(pa.array(held)), pa.array([m for m in messages if m is not None], pa.string())], names=["doi", "message"])


def register(spark: SparkSession, transport: Transport = urllib_transport) -> None:
    """Makes "works" a format of this session, over a transport.

    Options: ``files``, a JSON list of Parquet files with a column doi; ``per_second``,
    requests of all partitions together (0: as fast as they go); ``retries``.
    """

    class WorksSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "works"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> WorksReader:
            return WorksReader(json.loads(self.options["files"]), transport, float(self.options.get("per_second", 0)), int(self.options.get("retries", 2)))

    spark.dataSource.register(WorksSource)


def works(spark: SparkSession, dois: DataFrame, transport: Transport = urllib_transport, per_second: float = 0, retries: int = 2) -> DataFrame:
    """(doi, message) of a column of DOIs, each asked once, as ``metadata.cascade`` takes it; misses are left out."""
    register(spark, transport)
    folder = f"{shared_folder(spark)}/works-{uuid.uuid4().hex}"
    keys = dois.select("doi").where("doi IS NOT NULL").distinct()
    parts = max(1, -(-keys.count() // KEYS_OF_A_PARTITION))
    keys.repartitionByRange(parts, "doi").sortWithinPartitions("doi").write.parquet(folder)
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").orderBy("path").collect()]
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("works").option("files", json.dumps(files)).option("per_second", per_second).option("retries", retries).load()
