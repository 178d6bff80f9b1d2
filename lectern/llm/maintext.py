"""Main-text extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Weights are log-likelihood ratios
counted on labelled pages.  A tag scores below zero.  A word scores by where it
stands (in a paragraph, a link, a long or short run; inside an article or main
element, outside one, or on a page without) and by the names of the parts
around it (elements, classes, ids, roles): above zero, but below in parts whose
names say that they are something else.  One linear scan finds the contiguous
region of the highest score; it is grown to whole blocks and over neighbouring
blocks of its container whose words score above zero.  Parts inside the region
whose names score too low (adverts, sharing bars, comments ...) are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.references import unescape
from lectern.llm import markup
from lectern.llm.labelled_pages import labelled_pages
from lectern.llm.shared import prepare_workers, tidy

# Element names by what they mean for text.
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul"])
UNSEEN = frozenset(["button", "canvas", "datalist", "head", "iframe", "input", "label", "map", "noembed", "noframes", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video", "audio"])
IN_HEAD = frozenset(["base", "link", "meta", "noscript", "object", "script", "style", "template", "title"])
WHOLE = frozenset(["article", "main"])
PARAGRAPHS = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"])
NAMING = frozenset(["article", "aside", "dialog", "footer", "form", "header", "main", "menu", "nav", "search", "section"])
CONTAINERS = frozenset(["article", "center", "div", "main", "section", "table", "td"])
#: First parts of names that say what a thing has or is about, and last parts that say nothing of their own.
ABOUT = frozenset(["author", "category", "format", "has", "hide", "is", "js", "no", "not", "show", "status", "tag", "toggle", "type", "with", "without"])
PLACES = frozenset(["area", "block", "body", "bottom", "box", "container", "content", "inner", "item", "items", "left", "list", "main", "outer", "right", "section", "top", "wrap", "wrapper"])

#: Words of a run from which on it counts as long.
LONG_RUN = 8
#: Words that a name must have been seen with for half its weight.
DOUBT = 40
#: The score of the names around a word below which it is not main text, and the bounds of what names add.
APART, LEAST_NAMES, MOST_NAMES = -1.0, -6.0, 1.0
#: The weight of a tag that no labelled page has.
OTHER_TAG = -0.3


@lru_cache(maxsize=16384)
def _readings(name: str) -> tuple[str, ...]:
    """What a class, id or role may be known as, the most telling first."""
    parts = re.findall("[a-z]{2,}", re.sub("([a-z])([A-Z])", r"\1-\2", name).lower())
    if not parts:
        return ()
    out = ["-".join(parts)]
    while len(parts) > 1 and parts[-1] in PLACES:
        parts = parts[:-1]
        out.append("-".join(parts))
    if len(parts) > 1 and parts[0] not in ABOUT:
        out.append(parts[-1])
    return tuple("." + x for x in out)


def _names(tag: str, attributes: str, inside: bool) -> tuple[bool, list[tuple[str, ...]], str]:
    """(hidden, the readings of each name that an element gives itself, its label on labelled pages)."""
    hidden, out, label = False, [], ""
    if tag in NAMING:
        out.append((f"{tag}@in" if inside and tag not in WHOLE else tag,))
    for key, value in markup.attributes(attributes) if attributes else ():
        if key in ("class", "id", "role"):
            out += [r for x in dict.fromkeys(value.split()) if (r := _readings(x) if len(x) < 100 else ())]
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
            hidden = True
        elif key in ("data-main", "data-not"):
            label = key
    return hidden, out, label


@dataclass
class Weights:
    kinds: dict[str, float]  # of words, by where they stand
    names: dict[str, float]
    tags: dict[str, float]

    def of_names(self, readings: Iterable[tuple[str, ...]]) -> float:
        known = (next((self.names[r] for r in x if r in self.names), 0.0) for x in readings)
        return max(LEAST_NAMES, min(MOST_NAMES, sum(known)))


@dataclass
class Items:
    """A page's items in order: runs of words and tags, with what scoring and region finding need of each."""

    kinds: list[str] = field(default_factory=list)  # of words, or a tag with its <
    words: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    wholes: list[bool] = field(default_factory=list)  # inside an article or main
    names: list[float] = field(default_factory=list)  # the score of the names around
    holders: list[int] = field(default_factory=list)  # number of the innermost container
    depths: list[int] = field(default_factory=lambda: [0])  # of each container; 0 is the page
    extents: list[list[int]] = field(default_factory=lambda: [[0, -1]])  # its first and end items
    labels: list[str] = field(default_factory=list)  # data-main, data-not or nothing
    around: list[tuple[str, ...]] = field(default_factory=list)  # all names, kept for training only


def parse(page: str, weights: Weights | None = None) -> Items:
    """Cuts a page into items, in linear time; unclosed and stray tags are taken as browsers do, near enough."""
    out = Items()
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # depths at which a name is open
    # what holds from a depth on: (depth, value)
    hidden: list[int] = []
    whole: list[int] = []
    named: list[tuple[int, float, tuple[str, ...]]] = [(-1, 0.0, ())]
    holders: list[tuple[int, int]] = [(-1, 0)]
    labels: list[tuple[int, str]] = [(-1, "")]
    block = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()].pop()
        for held in (hidden, whole):
            while held and held[-1] >= depth:
                held.pop()
        for held in (named, labels):
            while held[-1][0] >= depth:
                held.pop()
        while holders[-1][0] >= depth:
            out.extents[holders.pop()[1]][1] = len(out.kinds)

    def add(kind: str, words: int, text: str | None) -> None:
        out.kinds.append(kind)
        out.words.append(words)
        out.texts.append(text)
        out.blocks.append(block)
        out.wholes.append(bool(whole))
        out.names.append(named[-1][1])
        out.holders.append(holders[-1][1])
        out.labels.append(labels[-1][1])
        if weights is None:
            out.around.append(named[-1][2])

    for what, value, attributes in markup.tokens(page):
        if what == markup.TEXT:
            if hidden:
                continue
            text = unescape(value) if "&" in value else value
            words = len(text.split())
            if words or text.isspace():
                place = "link" if places.get("a") else "par" if not PARAGRAPHS.isdisjoint(stack[-5:]) else "plain"
                add(f"{place}-{'long' if words >= LONG_RUN else 'short'}", words, text)
        elif what == markup.CLOSE:
            if places.get(value):
                close(places[value][-1])
            elif value == "br" and not hidden:
                add("<br", 0, " ")
            block += value in BLOCKS
            if not hidden:
                add("</" + value, 0, None)
        elif what == markup.OPEN:
            if places.get("head") and value not in IN_HEAD:  # a head without an end tag
                close(places["head"][-1])
            if value in BLOCKS:
                block += 1
                if places.get("p") and value != "option":  # a block ends an open paragraph
                    close(places["p"][-1])
                if value in ("li", "dt", "dd", "tr", "option") and stack and stack[-1] == value:
                    close(len(stack) - 1)
            if value in markup.VOID:
                if not hidden:
                    add("<" + value, 0, " " if value in ("br", "hr") else None)
                continue
            if attributes.endswith("/") and value in ("path", "circle", "rect"):
                continue
            depth = len(stack)
            stack.append(value)
            places.setdefault(value, []).append(depth)
            unseen, names, label = _names(value, attributes, bool(whole)) if attributes or value in NAMING else (False, [], "")
            if unseen or value in UNSEEN:
                hidden.append(depth)
            if names and value not in ("html", "body"):
                known = tuple(r for x in names for r in x)
                score = max(LEAST_NAMES, min(MOST_NAMES, named[-1][1] + weights.of_names(names))) if weights else 0.0
                named.append((depth, score, named[-1][2] + known if weights is None else ()))
            if value in WHOLE and named[-1][1] > APART and not hidden:
                whole.append(depth)
            if value in CONTAINERS:
                out.depths.append(out.depths[holders[-1][1]] + 1)
                out.extents.append([len(out.kinds), -1])
                holders.append((depth, len(out.depths) - 1))
            if label:
                labels.append((depth, label))
            if not hidden:
                add("<" + value, 0, " " if value in ("td", "th") else None)
    close(0)
    out.extents[0][1] = len(out.kinds)
    return out


def _place(items: Items, i: int, has_whole: bool) -> str:
    return ("in-" if items.wholes[i] else "out-" if has_whole else "") + items.kinds[i]


def _ratios(inside: Counter, outside: Counter) -> dict[str, float]:
    """The log of how much more often a thing is inside than all things are, drawn to 0 for rare ones."""
    share = sum(inside.values()) / max(sum(inside.values()) + sum(outside.values()), 1)
    logit = lambda p: math.log(p / (1 - p))
    return {k: logit((inside[k] + DOUBT * share) / (inside[k] + outside[k] + DOUBT)) - logit(share) for k in inside.keys() | outside.keys()}


def train(pages: list[str]) -> Weights:
    """Weights from pages whose main parts are marked."""
    kinds, names, tags = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    for page in pages:
        items = parse(page)
        has_whole = any(items.wholes)
        for i, (kind, words, label) in enumerate(zip(items.kinds, items.words, items.labels, strict=True)):
            other = label != "data-main"
            if kind[0] == "<":
                tags[other][kind] += 1
            else:
                kinds[other][_place(items, i, has_whole)] += min(words, 30)
                for name in dict.fromkeys(items.around[i]):
                    names[other][name] += min(words, 30)
    words = _ratios(*kinds)
    # outside an article that the page has, and in links, a word may speak against main text; else it speaks for it
    signed = {k: r if k.startswith("out-") or "link" in k else max(r, 0.05) for k, r in words.items()}
    return Weights(signed, _ratios(*names), {k: max(-1.5, min(r, -0.02)) for k, r in _ratios(*tags).items()})


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return train(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous region of the highest sum, the first of equals; empty if none is above zero."""
    best, held, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if held <= 0:
            held, start = 0.0, i
        held += s
        if held > best:
            best, found = held, (start, i + 1)
    return found


def item_scores(items: Items, weights: Weights, by_names: bool = True) -> list[float]:
    """The score of each item: words times a word's score, or a tag's weight."""
    has_whole, out = any(items.wholes), []
    for i, (kind, words) in enumerate(zip(items.kinds, items.words, strict=True)):
        if kind[0] == "<":
            out.append(weights.tags.get(kind, OTHER_TAG))
            continue
        score = weights.kinds.get(_place(items, i, has_whole), 0.05)
        if by_names:
            score = min(score + items.names[i], -0.1) if items.names[i] < APART else score + items.names[i]
        out.append(words * score)
    return out


def _grown(items: Items, scores: list[float], first: int, end: int) -> tuple[int, int]:
    """A region with the rest of its first and last blocks, and the neighbouring blocks of its container whose words score above zero."""
    holder = min((items.holders[i] for i in range(first, end)), key=items.depths.__getitem__)
    least, most = items.extents[holder] if holder else (first, end)

    def grow(at: int, step: int, stop: int) -> int:
        """From an item on, over blocks; the last item that belongs to the region."""
        i, kept, block, score = at, at, items.blocks[at], 1.0
        while i != stop:
            i += step
            if i == stop or items.blocks[i] != block:
                if score < 0:
                    break
                if score > 0:
                    kept = i - step
                if i == stop:
                    break
                block, score = items.blocks[i], 0.0
            # inside an article, growth passes over parts that will be left out
            if items.words[i] and items.blocks[i] != items.blocks[at] and not (items.wholes[i] and items.names[i] < APART):
                score += scores[i]
        return kept

    own_first, own_end = first, end
    while own_first and items.blocks[own_first - 1] == items.blocks[first]:
        own_first -= 1
    while own_end < len(items.blocks) and items.blocks[own_end] == items.blocks[end - 1]:
        own_end += 1
    return min(own_first, grow(first, -1, least - 1)), max(own_end, grow(end - 1, 1, most) + 1)


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The main text: blocks in page order, parted by one line feed, white space inside a block as one space.

    Null, empty and textless pages have an empty one.
    """
    if not page:
        return ""
    weights = default_weights() if weights is None else weights
    items = parse(page, weights)
    scores = item_scores(items, weights)
    apart = [n < APART for n in items.names]
    first, end = best_region(scores)
    if first == end:  # no part is main text by its names: then by all else
        apart = [False] * len(apart)
        scores = item_scores(items, weights, by_names=False)
        first, end = best_region(scores)
    if first == end:
        return ""
    first, end = _grown(items, scores, first, end)
    # between the region's first and last words of main text, parts with other names are left out
    kept = [i for i in range(first, end) if items.words[i] and not apart[i]]
    blocks: list[str] = []
    parts: list[str] = []
    at = None
    for i in range(first, end):
        if (text := items.texts[i]) is None or apart[i] and kept and kept[0] < i < kept[-1]:
            continue
        if items.blocks[i] != at:
            blocks.append("".join(parts))
            parts, at = [], items.blocks[i]
        parts.append(text)
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(pages: DataFrame, html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """Every row of ``pages`` with its main text.

    Returns ``row`` (a struct of all columns, so no name can clash) and ``text``
    (empty for null, empty and textless pages).  Repeated rows each have their
    result; an empty table gives an empty result.
    """
    weights = default_weights() if weights is None else weights
    prepare_workers(pages.sparkSession)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(0).field(html_col)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return rows.mapInArrow(tidy(each), schema)
