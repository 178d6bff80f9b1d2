"""From staged files to the rows of a knowledge base's tables, as one plan per table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.ids import doc_id, point_id
from lectern.functions.text import clean_markdown
from lectern.functions.vectors import coarse, norm, packed
from lectern.operators.annotate import annotate, outline
from lectern.operators.catalog import searched_fields
from lectern.operators.chunk import ChunkConfig, chunk
from lectern.operators.decisions import Decisions
from lectern.operators.grams import gram_rows
from lectern.operators.metadata import Answers, cascade, enrich_abstracts, guarded
from lectern.operators.models import Embedder, HashingEmbedder, embed_column
from lectern.operators.resolver import apply


@dataclass
class Recipe:
    """What ingestion is to use: models, lookup tables and the clock are injected."""

    config: ChunkConfig = field(default_factory=ChunkConfig)
    embedder: Embedder = field(default_factory=HashingEmbedder)
    works: Answers | None = None
    headers: Answers | None = None  # one that asks gets (content_hash, content)
    abstracts: list[Answers] = field(default_factory=list)
    file_doi: Callable[[bytes], str | None] | None = None  # from a file's bytes, where its text has no DOI
    resolve: Callable | None = None
    resolver: Decisions | None = None
    keywords: Callable[[str, str], list[str]] | None = None
    now: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))


def catalog_rows(parsed: DataFrame, recipe: Recipe, contents: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Documents (with ``markdown``) of parsed files (content_hash, path, name, markdown).

    ``contents`` (content_hash, content) is for what asks by a file's bytes; ``keep``
    writes answers and reads them back, so each service is asked once.
    """
    asking = lambda answers, name, rows=lambda df: df: (lambda df: keep(answers(rows(df)), name)) if callable(answers) else answers
    if recipe.file_doi and contents is not None:
        parsed = parsed.join(keep(contents.select("content_hash", file_dois(F.col("content"), recipe.file_doi).alias("file_doi")), "file_dois"), "content_hash", "left")
    headers = None if callable(recipe.headers) and contents is None else asking(recipe.headers, "headers", lambda ids: contents.join(ids, "content_hash", "left_semi"))
    found = cascade(parsed, asking(recipe.works, "works"), headers)
    if recipe.abstracts:
        found = keep(found, "found")
        found = enrich_abstracts(found, [asking(a, f"abstracts-{i}") for i, a in enumerate(recipe.abstracts)])
    if recipe.keywords:
        found = found.withColumn("made", keywords_column(F.col("title"), F.substring("abstract", 1, 6000), recipe.keywords))
        found = found.withColumn("keywords", F.when(F.size("made") >= 2, F.col("made")).otherwise(F.col("keywords"))).drop("made")
    rows = parsed.select("content_hash", "path", "name", "markdown").join(found, "content_hash")
    file_name = F.concat("name", F.lit(".pdf"))
    return rows.select(
        doc_id(F.col("doi"), F.col("title"), file_name).alias("doc_id"), "title", "abstract", "year", "journal", "doi",
        F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("first_author"), F.size("authors").alias("author_count"), "authors",
        F.array_sort(F.array_distinct("keywords")).alias("keywords"), F.col("path").alias("source_path"), "content_hash",
        F.lit(recipe.now()).cast("timestamp").alias("added_at"), F.lit("parsed").alias("parse_status"), "markdown", file_name.alias("source_file"),
    )


def file_dois(content: Column, find: Callable[[bytes], str | None]) -> Column:
    """The DOI of each file by its bytes, by Arrow batches; none where that fails."""
    return F.pandas_udf(lambda files: pd.Series([guarded(find, lambda: None)(bytes(c)) if c is not None else None for c in files], dtype=object), "string")(content)


def keywords_column(title: Column, abstract: Column, make: Callable[[str, str], list[str]]) -> Column:
    """Keywords of each row with a title and an abstract, by Arrow batches; none where the model fails."""

    def one(title: str | None, abstract: str | None) -> list[str]:
        try:
            return make(title, abstract) if title and abstract else []
        except Exception:  # a document is complete without keywords
            return []

    def each(titles: pd.Series, abstracts: pd.Series) -> pd.Series:
        return pd.Series([one(t, a) for t, a in zip(titles, abstracts, strict=True)], dtype=object)

    return F.pandas_udf(each, "array<string>")(title, abstract)


def tables_of(documents: DataFrame, recipe: Recipe, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, known: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of all tables for new documents (with ``markdown`` and ``source_file``), and (doc_id, error) of those that failed.

    A document that can't be annotated or embedded fails alone and is in no table.
    ``keep`` writes a frame and reads it back, so models are asked once; ``known``
    gives the resolver's decisions that are held on a frame of keys.
    """
    cleaned = documents.withColumn("cleaned", clean_markdown(F.col("markdown")))
    more, decided, new_decisions = cleaned, None, None
    if recipe.resolver and known:
        more, new_decisions = recipe.resolver.decide(cleaned.select("doc_id", "cleaned"), "doc_id", "cleaned", known, keep)
        decided = "items", apply
    annotated = keep(annotate(more, "doc_id", "cleaned", resolve=recipe.resolve, decided=decided), "annotated")
    chunks = chunk(annotated.where("error IS NULL"), recipe.config).withColumn("embedding", embed_column(F.col("content"), recipe.embedder, isolate=True))
    empty = lambda c: F.coalesce(c, F.lit(""))
    payload = documents.select("doc_id", "title", F.lower("title").alias("title_norm"), "year", empty("journal").alias("journal"), F.lower(empty("journal")).alias("journal_norm"), "first_author", F.lower("first_author").alias("first_author_norm"), "author_count", empty("doi").alias("doi"), "source_file", "content_hash", F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at"), (F.unix_micros("added_at") / 1e6).alias("added_ts"))
    points = keep(chunks.join(payload, "doc_id").withColumn("point_id", point_id(F.col("doc_id"), F.col("chunk_index"))).withColumn("norm", norm(F.col("embedding"))).withColumn("packed", packed(F.col("embedding"))).withColumn("coarse", coarse(F.col("packed"))), "points")
    failed = annotated.where("error IS NOT NULL").select("doc_id", "error").unionByName(points.where("embedding IS NULL").select("doc_id", F.lit("embed: the model failed on a chunk").alias("error")).distinct())
    tables = {"documents": documents, "points": points, "doc_text": cleaned.select("doc_id", F.col("cleaned").alias("full_text")), "doc_sections": outline(annotated.where("error IS NULL")), "grams": gram_rows(documents, searched_fields())}
    tables = {name: df.join(failed.select("doc_id"), "doc_id", "left_anti") for name, df in tables.items()}
    return tables | ({"decisions": new_decisions} if new_decisions is not None else {}), failed
