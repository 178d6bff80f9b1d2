"""An inverted index of trigrams for full-text search.

A row says that three letters stand one after another in a field of a document.
Rows are sorted by their letters, so the list of one trigram is a run of rows in
few files, and a filter on it reads little else.  A phrase lies only in documents
that are in the lists of all its trigrams: the rarest lists are intersected, and
what is left, by a left-semi join, is all that is looked at whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import fulltext, phrase_terms
from lectern.operators.retrieval import one_of

#: Code points of a field that are cut into trigrams at once; bounds the array of a long text.
PIECE = 16_384
#: Lists of a phrase that are intersected; what these leave is looked at whole.
MOST_LISTS = 4
#: Rows of a list up to which it is sent to all tasks; (field, doc_id) of so many are some tens of MB.
MOST_SENT = 200_000
#: Documents up to which they are named in a filter; more are joined.
MOST_NAMED = 1000


def trigrams(text: str) -> list[str]:
    """The distinct trigrams of a phrase, by code points."""
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def gram_rows(documents: DataFrame, fields: list[Column], key: str = "doc_id") -> DataFrame:
    """(gram, field, key): trigrams of each field in lower case, the fields numbered from 0.

    Null fields and those of fewer than three letters have none.  A text that is cut
    into pieces may have a trigram more than once, in as many rows.
    """
    fold = [F.lower(F.coalesce(c, F.lit(""))) for c in fields]
    told = documents.select(F.col(key).alias(key), F.posexplode(F.array(*fold)).alias("field", "text")).where(F.length("text") >= 3)
    # pieces overlap by two letters
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 3) / PIECE)), lambda i: F.substring(F.col("text"), (i * PIECE + 1).cast("int"), F.lit(PIECE + 2)))
    pieces = told.select(key, "field", F.explode(F.when(F.length("text") > PIECE + 2, cut).otherwise(F.array("text"))).alias("text"))
    return pieces.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)(?=(...))"), F.lit(1)))).alias("gram"), "field", key)


def build(spark: SparkSession, documents: DataFrame, fields: list[Column], path: str, key: str = "doc_id") -> DataFrame:
    """Writes an index to a folder and returns its reader; rows are dealt by range, so the list of a frequent trigram is several files."""
    rows = gram_rows(documents, fields, key)
    writer = rows.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write
    writer.option("parquet.bloom.filter.enabled#gram", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _of_phrase(index: DataFrame, grams: list[str], counts: dict[str, int], key: str) -> DataFrame:
    """(key) of documents with a field in all of the phrase's rarest lists."""
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:MOST_LISTS]
    found = index.where(F.col("gram") == rarest[0]).select("field", key).distinct()
    small = counts[rarest[0]] <= MOST_SENT
    for g in rarest[1:]:
        more = index.where(F.col("gram") == g).select("field", key)
        found = more.join(F.broadcast(found) if small else found, ["field", key], "left_semi").distinct()
    return found.select(key).distinct()


def candidates(index: DataFrame, query: str | None, key: str = "doc_id") -> DataFrame | None:
    """(key) of documents that may hold every phrase of a query; None if the query asks for nothing that an index can tell."""
    phrases = [t.lower() for t in phrase_terms(query) or () if len(t) >= 3]
    if not phrases:
        return None
    of = {p: trigrams(p) for p in phrases}
    every = sorted({g for some in of.values() for g in some})
    counts = dict.fromkeys(every, 0) | {r.gram: r.n for r in index.where(one_of("gram", every)).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    if not all(counts.values()):
        return index.select(key).limit(0)
    # the phrase with the shortest list first
    order = sorted(phrases, key=lambda p: min(counts[g] for g in of[p]))
    return reduce(lambda a, b: a.join(b, key, "left_semi"), (_of_phrase(index, of[p], counts, key) for p in order))


def search(documents: DataFrame, fields: list[Column], index: DataFrame, query: str | None, key: str = "doc_id") -> DataFrame:
    """The documents for which ``fulltext`` holds, found by the index."""
    holds = fulltext(fields, query)
    if holds is None:
        return documents
    return narrowed(documents, index, query, key).where(holds)


def narrowed(documents: DataFrame, index: DataFrame, query: str | None, key: str = "doc_id") -> DataFrame:
    """The documents that may hold a query's phrases: few are named in a filter, so files that lack them are passed over; more are joined."""
    found = candidates(index, query, key)
    if found is None:
        return documents
    few = [r[0] for r in found.limit(MOST_NAMED + 1).collect()]
    if len(few) <= MOST_NAMED:
        return documents.where(one_of(key, few)) if few else documents.limit(0)
    return documents.join(found, key, "left_semi")
