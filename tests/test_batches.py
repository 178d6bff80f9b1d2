"""Batches that go to Python workers are bounded by bytes, whatever the session had before."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators.annotate import annotate, outline
from lectern.operators.chunk import ChunkConfig, chunk
from lectern.session import BATCH_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.unset(SETTING)
    yield spark
    assert spark.conf.get(SETTING) == str(BATCH_BYTES)


def papers(spark):
    return spark.createDataFrame([(1, "# Results\n\nWe found it there again.\n\nAnd more of it was found."), (2, None), (3, "")], "doc_id long, text string")


def test_chunk(unbounded):
    annotated = annotate(papers(unbounded))
    unbounded.conf.unset(SETTING)
    got = chunk(annotated, ChunkConfig(1, 30, 0)).collect()
    assert [(r.doc_id, r.chunk_index, r.content) for r in got] == [(1, 0, "We found it there again."), (1, 1, "And more of it was found.")]


def test_chunk_of_texts_without_blocks(unbounded):
    failed = annotate(papers(unbounded)).withColumn("blocks", F.when(F.col("doc_id") == 1, F.col("blocks")))
    assert {r.doc_id for r in chunk(failed, ChunkConfig(1, 30, 0)).collect()} == {1}


def test_parse(unbounded):
    from lectern.sources import files

    staged = unbounded.createDataFrame([("a", b"%PDF-1\nx"), ("b", b"y")], "content_hash string, content binary")
    got, _ = files.parse(staged, unbounded.createDataFrame([], "content_hash string, markdown string"), files.text_parser)
    assert sorted((r.content_hash, r.markdown) for r in got.collect()) == [("a", "x"), ("b", "y")]


def test_embed(unbounded):
    from lectern.operators.models import HashingEmbedder, embed_column

    got = unbounded.range(3).select(embed_column(F.lit("one two"), HashingEmbedder()).alias("v")).collect()
    assert [r.v for r in got] == [HashingEmbedder().embed(["one two"])[0]] * 3


def test_annotate_and_outline(unbounded):
    def wrong(blocks):
        raise ValueError("no")

    got = outline(annotate(papers(unbounded))).collect()
    assert [(r.doc_id, r.section, r.char_count) for r in got] == [(1, "Results", len("We found it there again.And more of it was found."))]
    failed = annotate(papers(unbounded).where("doc_id = 1"), resolve=wrong).collect()
    assert [(r.doc_id, r.blocks, r.error) for r in failed] == [(1, None, "annotate: no")]


def test_annotated_ids_of_other_types(unbounded):
    for kind in ("string", "int", "struct<a:int>", "date"):
        value = F.lit("2020-01-01") if kind == "date" else F.struct(F.lit(1).alias("a")) if kind.startswith("struct") else F.lit("7")
        docs = unbounded.range(1).select(value.cast(kind).alias("doc_id"), F.lit("# A\n\nb").alias("text"))
        (got,) = annotate(docs).select("doc_id", F.size("blocks").alias("n"), F.to_json("blocks").alias("blocks")).collect()
        assert got.doc_id == docs.first().doc_id and got.n == 2 and json.loads(got.blocks)[1]["text"] == "b"
