"""Column builders for text: folding, search predicates, cleaning, blocks, paging.

All are built-in functions, so they stay inside generated code.  Python's
white space and word classes are Unicode-aware, hence ``(?U)`` in the patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def ascii_fold(c: Column) -> Column:
    """Lower-cases A-Z only, as LIKE without case does."""
    return F.translate(c, UPPER, LOWER)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, " "))


def heading_key(c: Column) -> Column:
    return F.lower(collapse(c))


def contains_ci(c: Column, value: str) -> Column:
    """A substring test without case for ASCII letters; null doesn't match."""
    return F.coalesce(F.contains(ascii_fold(c), F.lit(value.translate(str.maketrans(UPPER, LOWER)))), F.lit(False))


def phrase_terms(query: str | None) -> list[str] | None:
    """The phrases of a full-text query; None if it asks for nothing."""
    terms = [t for t in (w.replace('"', "") for w in (query or "").split()) if t]
    return terms or None


def fulltext(columns: list[Column], query: str | None) -> Column | None:
    """Every phrase of three letters or more lies in some column, without case.

    Shorter phrases are passed over beside longer ones and match nothing alone;
    a query without phrases filters nothing (None).
    """
    terms = phrase_terms(query)
    if terms is None:
        return None
    long = [t for t in terms if len(t) >= 3]
    if not long:
        return F.lit(False)
    folded = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(c, F.lower(F.lit(t))) for c in folded)) for t in long))


def clean_markdown(c: Column) -> Column:
    """Without images, figure and table lines, HTML and pipe tables; blank text is empty, else one line feed ends it."""
    # where an opening has no end, no later one has: what is left is passed over at once
    t = F.regexp_replace(c, r"(?dU)!\[(?>.*?\]\()(?>.*?\))\s*+|(!\[.*+)", "$1")
    t = F.regexp_replace(t, r"(?dmiuU)^(?:Figure|Fig\.)\s+S?\d+.*$", "")
    t = F.regexp_replace(t, r"(?is)<table(?>.*?</table>)|(<table.*+)", "$1")
    t = F.array_join(F.filter(F.split(t, "\n"), lambda line: ~F.startswith(strip(line), F.lit("|"))), "\n")
    t = F.regexp_replace(t, r"(?dmiuU)^Table\s+S?\d+.*$", "")
    t = F.concat(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), F.lit("\n"))
    return F.when(strip(c) == "", F.lit("")).otherwise(t)


def split_blocks(c: Column) -> Column:
    """Blocks parted by blank lines, stripped, none empty."""
    return F.filter(F.transform(F.split(c, "\n{2,}"), lambda b: strip(b)), lambda b: b != "")


def placed_blocks(c: Column) -> Column:
    """The blocks as (idx, block, ratio): how far down the text each stands, from 0 to 1."""
    # bound to a variable, as an expression would be made again for every block
    placed = lambda blocks: F.transform(blocks, lambda b, i: F.struct(i.alias("idx"), b.alias("block"), (i / F.greatest(F.size(blocks) - 1, F.lit(1))).alias("ratio")))
    return F.transform(F.array(split_blocks(c)), placed)[0]


def heading_level(block: Column) -> Column:
    return F.length(F.regexp_extract(block, r"(?dU)^(#{1,6})\s+(.+)", 1))


def block_text(block: Column) -> Column:
    """A heading's first line without its signs, else the block."""
    return F.when(heading_level(block) > 0, strip(F.regexp_extract(block, r"(?dU)^(#{1,6})\s+(.+)", 2))).otherwise(block)


# The patterns behind the signals of a block.
SIGNALS = {
    "starts_with_figure_token": r"^(?:fig(?:ure)?\.?)\s*[A-Za-z]?\d+",
    "starts_with_table_token": r"^(?:table)\s*[A-Za-z]?\d+",
    "has_affiliation_keywords": r"\b(department|university|institute|school|hospital|laboratory|centre|center)\b",
    "has_received_dates": r"\b(received|accepted|published|editorial decision|revised)\b",
    "has_reference_markers": r"^(?:\(?\d+\)?[\].:]?\s+|[A-Z][A-Za-z' -]+,\s*[A-Z]\.)",
    "looks_like_summary_heading": r"\b(summary|research article summary|significance)\b",
    "looks_like_caption_body": r"\b(shown from top to bottom|scale bar|cells were treated|left to right)\b",
}
CASED_SIGNALS = frozenset(["has_reference_markers"])


def signals(text: Column) -> dict[str, Column]:
    """The eight booleans of a block."""
    out = {name: F.rlike(text, F.lit(("(?dU)" if name in CASED_SIGNALS else "(?diuU)") + pattern)) for name, pattern in SIGNALS.items()}
    compact = F.replace(text, F.lit(" "), F.lit(""))
    return out | {"looks_like_short_label": (F.length(compact) <= 12) & F.rlike(compact, F.lit(r"^[A-Za-z0-9_.:-]+\z"))}


def page_count(text: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")


def page(text: Column, number: int, size: int) -> Column:
    """A page of code points, numbered from one."""
    return F.substring(text, (number - 1) * size + 1, size)


def year_sniff(text: Column, within: int = 1000) -> Column:
    """The first year 19xx or 20xx among the first code points."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.substring(text, 1, within), r"(?U)\b(?:19|20)\d{2}\b", 0), F.lit("")), F.lit("9999")).cast("int")


def strip_tags(c: Column) -> Column:
    """Markup as spaces, white space collapsed (character references stay)."""
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def keyword_list(raw: Column) -> Column:
    """Parts of a keyword text: collapsed, bullets and edge signs off, none empty, generic or over 80, first of each key, ten at most."""
    text = collapse(raw)
    parts = F.when(F.rlike(F.coalesce(raw, F.lit("")), F.lit("[\n;,]")), F.split(F.coalesce(raw, F.lit("")), "[\n;,|]+")).otherwise(F.array(text))
    bare = F.transform(parts, lambda p: F.btrim(F.regexp_replace(collapse(p), r"(?U)^(?:[-*•]|\d+[.)])\s*", ""), F.lit(" .,:;/-_")))
    good = F.filter(bare, lambda p: (p != "") & (F.length(p) <= 80) & ~F.lower(p).isin(*GENERIC_KEYWORDS))
    keyed = F.filter(F.transform(good, lambda p: F.struct(_key(p).alias("key"), p.alias("text"))), lambda x: x["key"] != "")
    none = F.array().cast("array<struct<key:string,text:string>>")
    # one pass, in which no more than ten are held
    held = F.aggregate(keyed, none, lambda held, x: F.when((F.size(held) < 10) & ~F.exists(held, lambda h: h["key"] == x["key"]), F.concat(held, F.array(x))).otherwise(held))
    return F.transform(held, lambda x: x["text"])


# Words that are no keywords.
GENERIC_KEYWORDS = ("abstract", "article", "keyword", "keywords", "paper", "research", "review", "study")


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
