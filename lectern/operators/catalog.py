"""The document catalog: lookups, sorted pages, searches, nested records.

A page and its total come from one filtered frame; sorting with offset and
limit plans as TakeOrderedAndProject, so no more than the pages up to the one
asked for leave a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import contains_ci, fulltext

ROW = ("doc_id", "title", "year", "journal", "first_author", "doi", "added_at")
SORTS = {
    "added": [F.desc, "added_at"],
    "title": [F.asc_nulls_first, "title"],
    "year": [F.asc_nulls_first, "year"],
}


def paged(rows: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def after(sort: str, value: object, doc_id: str) -> Column:
    """Whether a row comes after the one with this sort value and id, in the order of ``list_documents``."""
    how, name = SORTS[sort]
    c, later = F.col(name), F.col("doc_id") > doc_id
    if how is F.desc:  # nulls come last
        return c.isNull() & later if value is None else (c < F.lit(value)) | (c == F.lit(value)) & later | c.isNull()
    return c.isNull() & later | c.isNotNull() if value is None else (c > F.lit(value)) | (c == F.lit(value)) & later


def documents_after(documents: DataFrame, sort: str = "added", last: tuple[object, str] | None = None, page_size: int = 20) -> DataFrame:
    """The page of ``list_documents`` that follows the row of a sort value and id (None: the first).

    However far on it is, a task keeps a page of rows and no more; with page
    numbers it has to sort out all rows before.
    """
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    how, column = SORTS[sort]
    rows = documents if last is None else documents.where(after(sort, *last))
    return paged(rows, [how(column), F.asc("doc_id")], 1, page_size).select(*ROW)


def list_documents(documents: DataFrame, sort: str = "added", page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of all documents: newest first, or by title or year ascending with nulls first; ties by id."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    how, column = SORTS[sort]
    return paged(documents, [how(column), F.asc("doc_id")], page, page_size).select(*ROW)


def searched_fields() -> list[Column]:
    """What a full-text query looks into."""
    return [F.col("title"), F.col("abstract"), F.array_join(F.col("keywords"), " ")]


def search_filter(query: str | None = None, title: str | None = None, authors: str | None = None, journal: str | None = None, year_from: int | None = None, year_to: int | None = None) -> Column:
    """The conjunction of what is asked for; empty texts ask for nothing, a zero year bounds."""
    parts = []
    if query and (c := fulltext(searched_fields(), query)) is not None:
        parts.append(c)
    if title:
        parts.append(contains_ci(F.col("title"), title))
    if authors:
        parts.append(F.coalesce(F.exists("authors", lambda a: contains_ci(a, authors)), F.lit(False)))
    if journal:
        parts.append(contains_ci(F.col("journal"), journal))
    if year_from is not None:
        parts.append(F.col("year") >= year_from)
    if year_to is not None:
        parts.append(F.col("year") <= year_to)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search_documents(documents: DataFrame, page: int = 1, page_size: int = 10, **asked) -> tuple[DataFrame, DataFrame]:
    """(the page, newest first; one row with the total)."""
    hits = documents.where(search_filter(**asked))
    return paged(hits, [F.desc("added_at"), F.asc("doc_id")], page, page_size).select(*ROW), hits.agg(F.count("*").alias("total"))


def get_document(documents: DataFrame, doc_id: str) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id).withColumn("keywords", F.array_sort("keywords"))


def find_by_hash(documents: DataFrame, content_hash: str) -> DataFrame:
    return documents.where(F.col("content_hash") == content_hash)


def nested(documents: DataFrame, authors: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with author names in order of position and sorted keywords, from child tables (key, position, name) and (key, keyword)."""
    a = authors.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("authors"))
    k = keywords.groupBy(key).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    empty = F.array().cast("array<string>")
    out = documents.join(a, key, "left").join(k, key, "left")
    return out.withColumn("authors", F.coalesce("authors", empty)).withColumn("keywords", F.coalesce("keywords", empty))


def counts(documents: DataFrame, points: DataFrame, by: str | None = None, key: str = "doc_id") -> DataFrame:
    """(by, doc_count, chunk_count): documents and their points, in all or for each value of a column of documents."""
    docs = documents.select(key, *([by] if by else []))
    chunks = points.groupBy(key).agg(F.count("*").alias("n"))
    return docs.join(chunks, key, "left").groupBy(*([by] if by else [])).agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"))
