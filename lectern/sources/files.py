"""Folder scans, staging of files by content, parsing through a cache table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.session import bound_batches

#: A parser takes a file's bytes and gives its markdown.
Parser = Callable[[bytes], str]


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of all files of a folder tree that fit the pattern, as Spark's readers see it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(_escaped(folder)).select("path", "content")


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modified) of all files of a folder tree that fit the pattern; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(_escaped(folder))
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def deal(listed: DataFrame, per_batch: int, batch_bytes: int, target: str) -> tuple[DataFrame, int]:
    """Deals listed files out to batches of about so many files and bytes, and writes (batch, path, length, modified) in order of batches.

    A file's batch follows from its path, so dealing again gives the same.  Returns
    the reader of what was written and the number of batches.
    """
    told = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    batches = max(1, -(-told.n // per_batch), -(-told.bytes // batch_bytes))
    dealt = listed.select(F.pmod(F.xxhash64("path"), F.lit(batches)).cast("int").alias("batch"), "path", "length", "modified")
    dealt.repartitionByRange("batch", "path").sortWithinPartitions("batch", "path").write.mode("overwrite").parquet(target)
    return listed.sparkSession.read.schema(dealt.schema).parquet(target), batches


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of the files of these paths."""
    return spark.read.format("binaryFile").load([_escaped(p) for p in paths]).select("path", "content")


def _escaped(path: str) -> str:
    """A path whose signs of patterns stand for themselves."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def stage(files: DataFrame, magic: bytes = b"%PDF-") -> DataFrame:
    """(path, content, content_hash, name, problem): hash and stem of each file; ``problem`` says why one can't be taken."""
    starts = F.substring("content", 1, len(magic)) == F.lit(bytearray(magic))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    problem = F.when(suffix != ".pdf", F.lit("not a pdf file")).when(~starts, F.lit("not a pdf header"))
    return files.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.url_decode(F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), r"\+", "%2B")).alias("name"), problem.alias("problem"))


def new_content(staged: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose content the catalog lacks, one of each content by path; files that repeat content)."""
    facts = staged.drop("content")  # which are not read to tell files apart
    first = facts.groupBy("content_hash").agg(F.min("path").alias("path"))
    new = facts.join(first, ["content_hash", "path"], "left_semi").join(documents.select("content_hash"), "content_hash", "left_anti")
    return staged.join(new.select("path"), "path", "left_semi"), facts.join(new.select("path"), "path", "left_anti")


def parse(staged: DataFrame, cache: DataFrame, parser: Parser, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(content_hash, markdown, error) of all files, and what is to be added to the cache; only what the cache lacks is parsed.

    ``keep`` writes what was parsed and reads it back, so a parser is asked once.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for digest, content in zip(f["content_hash"], f["content"], strict=True):
                try:
                    rows.append((digest, parser(bytes(content)), None))
                except Exception as e:  # a file that can't be parsed fails alone
                    rows.append((digest, None, f"parse: {e}"))
            yield pd.DataFrame(rows, columns=["content_hash", "markdown", "error"])

    bound_batches(staged.sparkSession)
    schema = f"{schemas.PARSE_CACHE}, error string"
    missed = keep(staged.select("content_hash", "content").dropDuplicates(["content_hash"]).join(cache, "content_hash", "left_anti").mapInPandas(each, schema), "parsed")
    hits = cache.join(staged.select("content_hash").distinct(), "content_hash", "left_semi").withColumn("error", F.lit(None).cast("string"))
    return hits.unionByName(missed), missed


def pick_output(entries: DataFrame, stem: str) -> DataFrame:
    """The best of a parser's output files (path, content): ``<stem>/auto/<stem>.md``, else the first .md by path that isn't blank."""
    return pick_outputs(entries.withColumn("stem", F.lit(stem))).drop("stem")


def pick_outputs(entries: DataFrame) -> DataFrame:
    """``pick_output`` for each ``stem`` of (stem, path, content), in one aggregation."""
    preferred = F.col("path").endswith(F.concat("stem", F.lit("/auto/"), "stem", F.lit(".md")))
    good = entries.where(F.col("path").endswith(".md") & (F.trim("content") != ""))
    best = good.groupBy("stem").agg(F.min(F.struct(~preferred, "path", "content")).alias("b"))
    return best.select("stem", "b.path", "b.content")


def answer_text(answers: DataFrame, stem: str) -> DataFrame:
    """(markdown) of parser answers (MAP<name, MAP<field, text>>): the stem's entry, else the only one; first field that isn't empty."""
    entry = F.coalesce(F.try_element_at("results", F.lit(stem)), F.when(F.size("results") == 1, F.map_values("results")[0]))
    fields = [F.nullif(F.try_element_at(entry, F.lit(name)), F.lit("")) for name in ("md_content", "markdown", "md")]
    return answers.select(F.coalesce(*fields).alias("markdown"))


def text_parser(content: bytes) -> str:
    """The offline parser: what follows a PDF header line is the markdown."""
    return content.partition(b"\n")[2].decode("utf-8") if content.startswith(b"%PDF-") else content.decode("utf-8")
