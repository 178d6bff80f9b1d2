"""Chunks of body text: groups of one section and heading path, packed into windows with overlap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern import schemas
from lectern.session import bound_batches

# What ends a sentence.
SENTENCE_ENDS = (". ", "? ", "! ", ".\n", "?\n", "!\n")


@dataclass(frozen=True)
class ChunkConfig:
    min_chunk: int = 300
    max_chunk: int = 1500
    overlap: int = 100

    def __post_init__(self):
        # with more overlap a window may end where it began
        if self.max_chunk < 1 or not 0 <= self.overlap <= min(self.max_chunk - 1, self.max_chunk // 2 + 2):
            raise ValueError(f"overlap must be from 0 to {min(self.max_chunk - 1, self.max_chunk // 2 + 2)} for max_chunk {self.max_chunk}")


def windows(text: str, cfg: ChunkConfig) -> Iterator[str]:
    """Pieces of a long paragraph, cut after the last sentence end beyond half a window if there is one."""
    start = 0
    while start < len(text):
        piece = text[start : start + cfg.max_chunk]
        end = start + len(piece)
        if end < len(text):
            cuts = [at + len(mark) for mark in SENTENCE_ENDS if (at := piece.rfind(mark)) > len(piece) // 2]
            end = start + max(cuts, default=len(piece))
        if stripped := text[start:end].strip():
            yield stripped
        start = end - cfg.overlap if end < len(text) else end


def pack(paragraphs: Iterable[str], cfg: ChunkConfig) -> list[str]:
    """Paragraphs packed greedily up to the limit; small chunks are then joined with what follows, over the limit if need be."""
    packed: list[str] = []
    open_ = False  # whether the last chunk may take another paragraph
    for p in paragraphs:
        if len(p) > cfg.max_chunk:
            packed += windows(p, cfg)
            open_ = False
        elif open_ and len(packed[-1]) + 2 + len(p) <= cfg.max_chunk:
            packed[-1] += "\n\n" + p
        else:
            packed.append(p)
            open_ = True
    out: list[str] = []
    for chunk in packed:
        if out and len(out[-1]) < cfg.min_chunk:
            out[-1] += "\n\n" + chunk
        else:
            out.append(chunk)
    return out


def with_paths(blocks: Iterable[dict]) -> Iterator[tuple[tuple[str, str], str]]:
    """((section, heading path), text) of each body block; a heading ends those of its level and below."""
    path: list[tuple[int, str]] = []
    for b in blocks:
        if b["is_heading"]:
            path = [p for p in path if p[0] < b["heading_level"]] + [(b["heading_level"], b["text"])]
        else:
            yield (b["section"], " > ".join(text for _, text in path)), b["text"]


def chunk_blocks(blocks: Iterable[dict], cfg: ChunkConfig) -> list[dict]:
    """Chunks of the kept blocks of a document, numbered through."""
    out: list[dict] = []
    for (section, path), group in groupby(with_paths(blocks), key=lambda x: x[0]):
        paragraphs = [p for p in (p.strip() for text in group for p in text[1].split("\n\n")) if p]
        out += [{"chunk_index": len(out) + i, "content": c, "section": section, "heading_path": path} for i, c in enumerate(pack(paragraphs, cfg))]
    return out


def chunk(annotated: DataFrame, cfg: ChunkConfig | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_index, content, section, heading_path) of annotated documents; a document is a row, so nothing is shuffled."""
    cfg = cfg or ChunkConfig()

    bound_batches(annotated.sparkSession)
    fields = list(to_arrow_schema(StructType.fromDDL(schemas.CHUNKS)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunk_blocks(blocks.as_py() or (), cfg) for blocks in batch.column(1)]
            of = pa.array([i for i, chunks in enumerate(found) for _ in chunks], pa.int64())
            columns = [pa.array([c[f.name] for chunks in found for c in chunks], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *columns], names=["id", *(f.name for f in fields)])

    narrow = F.transform(F.filter("blocks", lambda b: b["kept"]), lambda b: F.struct(b["is_heading"].alias("is_heading"), b["heading_level"].alias("heading_level"), b["section"].alias("section"), b["text"].alias("text")))
    rows = annotated.select(F.col(id_col).alias("id"), narrow.alias("kept"))
    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, {schemas.CHUNKS}").withColumnRenamed("id", id_col)
