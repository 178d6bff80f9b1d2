"""Tables of a knowledge base, with explicit types."""

from __future__ import annotations

from typing import NamedTuple

DOCUMENTS = "doc_id string, title string, abstract string, year int, journal string, doi string, first_author string, author_count int, authors array<string>, keywords array<string>, source_path string, content_hash string, added_at timestamp, parse_status string"
POINTS = "point_id string, doc_id string, chunk_index int, content string, section string, heading_path string, embedding array<float>, norm double, packed binary, coarse binary, title string, title_norm string, year int, journal string, journal_norm string, first_author string, first_author_norm string, author_count int, doi string, source_file string, content_hash string, added_at string, added_ts double"
DOC_TEXT = "doc_id string, full_text string"
DOC_SECTIONS = "doc_id string, ord int, section string, char_count long, text string"
PARSE_CACHE = "content_hash string, markdown string"
BLOCKS = "idx int, raw_text string, text string, is_heading boolean, heading_level int, role string, section string, subsection string, confidence double, rationale string, kept boolean"
CHUNKS = "chunk_index int, content string, section string, heading_path string"
METADATA = "title string, year int, journal string, doi string, authors array<string>, abstract string, source string, keywords array<string>"

DECISIONS = "key string, items string"
GRAMS = "gram string, field int, doc_id string"


class Table(NamedTuple):
    """A table's columns and how it is stored.

    ``key``: by what rows are replaced and removed; ``order``: how rows lie in files;
    ``looked_up``: columns with Bloom filters; ``cell``: the column of folders;
    ``leader``: a table with a row for each key, which says what keys are there.
    """

    schema: str
    key: str
    order: tuple[str, ...]
    looked_up: tuple[str, ...]
    cell: str | None = None
    leader: str | None = None


#: Tables of a knowledge base by name.
TABLES = {
    "documents": Table(DOCUMENTS, "doc_id", ("doc_id",), ("doc_id", "content_hash")),
    "points": Table(POINTS + ", cell int", "doc_id", ("doc_id", "chunk_index"), ("doc_id", "point_id"), "cell"),
    "doc_text": Table(DOC_TEXT, "doc_id", ("doc_id",), ("doc_id",)),
    "doc_sections": Table(DOC_SECTIONS, "doc_id", ("doc_id", "ord"), ("doc_id",)),
    "parse_cache": Table(PARSE_CACHE, "content_hash", ("content_hash",), ("content_hash",)),
    "decisions": Table(DECISIONS, "key", ("key",), ("key",)),
    "grams": Table(GRAMS, "doc_id", ("gram", "doc_id"), ("gram",), leader="documents"),
}
