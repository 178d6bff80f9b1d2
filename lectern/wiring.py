"""What settings stand for: parsers, models and connectors of an engine."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, SparkSession

from lectern.errors import ConfigError
from lectern.operators import decisions
from lectern.operators.ingest import Recipe
from lectern.operators.metadata import chat_keywords
from lectern.operators.models import Chat, Embedder, HashingEmbedder, OverlapReranker, Reranker
from lectern.services import HttpChat, HttpEmbedder, HttpReranker, Transport, abstracts_table, headers_table, urllib_transport
from lectern.sources import files, parsers, works_source
from lectern.sources.settings import Settings


def parser(settings: Settings, transport: Transport = urllib_transport) -> files.Parser:
    """The parser of files; a library that isn't there is an error at once."""
    if settings.parser_backend == "service":
        return parsers.service_parser(settings.parser_url, transport=transport)
    if settings.parser_backend == "command":
        return parsers.command_parser(shlex.split(settings.parser_command))
    if settings.parser_backend == "library":
        module, _, name = settings.parser_library.partition(":")
        call = getattr(parsers.optional(module), name, None)
        if not callable(call):
            raise ConfigError(f"setting parser_library: {settings.parser_library!r} can't be imported")
        return parsers.library_parser(call)
    return files.text_parser


def embedder(settings: Settings, transport: Transport = urllib_transport) -> Embedder:
    if settings.embed_backend == "api":
        return HttpEmbedder(settings.embed_base_url, settings.embed_model, settings.embed_api_key, transport, batch=settings.embed_batch)
    dims = settings.embed_model.rpartition("-")[2]
    return HashingEmbedder(int(dims) if dims.isdecimal() else 64)


def reranker(settings: Settings, transport: Transport = urllib_transport) -> Reranker:
    if settings.rerank_backend == "api":
        return HttpReranker(settings.rerank_base_url, settings.rerank_model, settings.rerank_api_key, transport, batch=settings.rerank_batch)
    return OverlapReranker()


def chat(settings: Settings, transport: Transport = urllib_transport) -> Chat | None:
    if settings.chat_backend == "api":
        return HttpChat(settings.chat_base_url, settings.chat_model, settings.chat_api_key, transport)
    return None


def recipe(spark: SparkSession, settings: Settings, transport: Transport = urllib_transport) -> Recipe:
    """How documents are taken in.  Connectors are asked only if they are enabled; their failures are misses."""
    model = chat(settings, transport)

    def works(dois: DataFrame) -> DataFrame:
        return works_source.works(spark, dois, transport, settings.connector_per_second)

    def headers(contents: DataFrame) -> DataFrame:
        return headers_table(contents, settings.header_url, transport)

    def abstracts(found: DataFrame) -> DataFrame:
        return abstracts_table(found, transport)

    return Recipe(
        embedder=embedder(settings, transport),
        works=works if settings.crossref_enabled else None,
        headers=headers if settings.header_url else None,
        abstracts=[abstracts] if settings.crossref_enabled else [],
        file_doi=parsers.local_doi if parsers.optional("fitz") else None,
        resolver=decisions.Decisions(model) if model and settings.annotation_resolver_enabled else None,
        keywords=chat_keywords(model) if model and settings.keywords_enabled else None,
    )
