"""HTML cut into text and tags in one linear pass, whatever the page holds.

Tags are taken as browsers do, near enough: a quoted attribute may hold ``>``;
a tag whose quotes leave no ``>`` outside them ends at the first one all the
same; comments and raw elements (scripts, styles, titles ...) without an end go
to the end of the page; a ``<`` that begins no tag is text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

# Elements whose content is text to their end tag, and those without content.
RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])

#: A tag without quotes, whose end is its first >.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_INSIDE = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+""")
_QUOTED = re.compile(r""""[^"]*+"|'[^']*+'""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")

TEXT, OPEN, CLOSE, CONTENT = range(4)


@lru_cache(maxsize=64)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])[^>]*+>?", re.I)


class _Ends:
    """Finds the ends of tags.

    From a tag's name on the page is outside quotes, inside double or inside
    single ones.  A quote mark changes two of the three for one another, so ways
    that differ once differ for good: no more than three ways can come to the end
    of the page without a ``>`` outside quotes.  These are kept, and a tag that
    begins on one of them need not be followed again.
    """

    def __init__(self, page: str):
        self.page = page
        self.lost: list[tuple[int, list[int], list[int]]] = []

    def find(self, at: int) -> int:
        """The place of the tag's ``>``, or the page's length."""
        page = self.page
        if not any(self._on(way, at) for way in self.lost):
            end = _INSIDE.match(page, at).end()
            if end < len(page) and page[end] == ">":
                return end
            spans = [m.span() for m in _QUOTED.finditer(page, at, end)]
            self.lost.append((end, [a for a, _ in spans], [b for _, b in spans]))
        end = page.find(">", at)
        return len(page) if end < 0 else end

    @staticmethod
    def _on(way: tuple[int, list[int], list[int]], at: int) -> bool:
        end, opened, closed = way
        i = bisect_left(opened, at) - 1
        return at <= end and (i < 0 or closed[i] <= at)


def tokens(page: str) -> Iterator[tuple[int, str, str]]:
    """(TEXT, text, ""), (OPEN, name, attributes), (CONTENT, name, what a raw element holds) and (CLOSE, name, "") in page order.

    Names are lower-cased; text is as it stands, character references included.
    Raw elements are closed after their content.
    """
    ends, n, begin, at = _Ends(page), len(page), 0, 0
    while (lt := page.find("<", at)) >= 0:
        if found := _PLAIN.match(page, lt):
            slash, tag, inside = found.groups()
            end = found.end()
        else:
            slash = page.startswith("/", lt + 1)
            name = _NAME.match(page, lt + 1 + slash)
            if not name and not page.startswith(("!", "?", "/"), lt + 1):
                at = lt + 1
                continue
            if name:
                stop = ends.find(name.end())
                tag, inside, end = name[0], page[name.end() : stop], min(stop + 1, n)
            else:  # a comment or the like
                mark = "-->" if page.startswith("<!--", lt) else ">"
                stop = page.find(mark, lt + 2)
                tag, inside, end = "", "", n if stop < 0 else stop + len(mark)
        if lt > begin:
            yield TEXT, page[begin:lt], ""
        at = begin = end
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            yield CLOSE, tag, ""
            continue
        yield OPEN, tag, inside
        if tag in RAW:
            stop = _end_tag(tag).search(page, at)
            yield CONTENT, tag, page[at : stop.start() if stop else n]
            yield CLOSE, tag, ""
            at = begin = stop.end() if stop else n
    if begin < n:
        yield TEXT, page[begin:], ""


def attributes(inside: str) -> list[tuple[str, str]]:
    """(name, value) of a tag's attributes in order, names lower-cased; values as they stand."""
    return [(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTRIBUTE.finditer(inside)]
