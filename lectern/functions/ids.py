"""Identifiers: content hashes, document ids, point ids."""

from __future__ import annotations

import uuid
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of point ids (the RFC 4122 one of URLs).
URL_SPACE = uuid.NAMESPACE_URL.hex


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def point_id(doc_id: Column, chunk_index: Column) -> Column:
    """The version 5 UUID of ``doc_id#chunk_index``, from built-ins."""
    name = F.concat(doc_id.cast("string"), F.lit("#"), chunk_index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def lookup_key(value: object) -> str:
    return " ".join(str(value or "").split()).casefold()


def make_doc_id(doi: str | None, title: str | None, source: str | None) -> str:
    """``doc-`` and 20 hex digits of a hash of the DOI, else of title and source file, else of the source file."""
    if key := lookup_key(doi).lower():
        basis = f"doi:{key}"
    elif key := lookup_key(title):
        basis = f"title:{key}|source:{lookup_key(source)}"
    else:
        basis = f"source:{lookup_key(source)}"
    return f"doc-{blake2b(basis.encode(), digest_size=10).hexdigest()}"


def doc_id(doi: Column, title: Column, source: Column) -> Column:
    """``make_doc_id`` by row; BLAKE2 and case folding have no built-in, so one Arrow call per document."""

    def each(doi: pd.Series, title: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([make_doc_id(*x) for x in zip(doi, title, source, strict=True)])

    return F.pandas_udf(each, "string")(doi, title, source)
