"""Fields of works from JSON answers, by built-ins: each answer is a VARIANT, and paths that lead nowhere give nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse

# Where a work's year stands, the first that is there.
YEARS = ("published-print", "published-online", "published", "issued", "created")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a value is of a kind, as its schema begins; nothing is of none."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column) -> Column:
    """A text, or nothing of any other value."""
    return F.when(_is(v, "STRING"), _at(v, "$", "string"))


def _first(v: Column) -> Column:
    """A text itself, or the first value of a list as text."""
    return F.coalesce(_text(v), F.when(_is(v, "ARRAY"), _at(v, "$[0]", "string")))


def _each(v: Column) -> Column:
    return F.coalesce(F.when(_is(v, "ARRAY"), _at(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _author(v: Column) -> Column:
    named = F.concat_ws(" ", F.nullif(_text(_at(v, "$.given")), F.lit("")), F.nullif(_text(_at(v, "$.family")), F.lit("")))
    return F.when(_is(v, "STRING"), F.trim(_text(v))).when(_is(v, "OBJECT"), named)


def _year(v: Column) -> Column:
    of = [_at(v, f"$['{name}']['date-parts'][0][0]") for name in YEARS]
    return F.coalesce(*(F.when(_is(y, "BIGINT"), _at(y, "$", "int")) for y in of))


def fields(body: Column) -> dict[str, Column]:
    """title, year, journal, doi, authors, abstract and keywords of a work's JSON text; of what is no JSON object all are empty."""
    v = F.try_parse_json(body)
    clean = lambda c: F.nullif(collapse(c), F.lit(""))
    some = lambda names: F.filter(names, lambda n: n != "")
    return {
        "title": collapse(_first(_at(v, "$.title"))),
        "year": _year(v),
        "journal": clean(_first(_at(v, "$['container-title']"))),
        "doi": clean(_text(_at(v, "$.DOI"))),
        "authors": some(F.transform(_each(_at(v, "$.author")), _author)),
        "abstract": clean(_text(_at(v, "$.abstract"))),
        "keywords": F.filter(F.transform(_each(_at(v, "$.subject")), _text), lambda k: k.isNotNull()),
    }
