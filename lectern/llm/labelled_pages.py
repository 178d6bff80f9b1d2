"""Labelled pages for the extractor, made by rule from a seed.

A page is put together as sites do it: menus, notices and forms above; a main
part in an article, a main element, a named or an unnamed container, with
paragraphs, lists, tables and, at times, adverts, sharing bars or related links
inside; comments, side columns and footers after it.  Parts that aren't main
text are named by an element, by a class or id, or not at all.  ``data-main``
marks the main part, ``data-not`` what inside it isn't.
"""

from __future__ import annotations

import random

# Names of parts, as class and id attributes have them.
CONTENT_NAMES = ["content", "main", "main-content", "article", "article-body", "article-content", "article-text", "post", "post-body", "post-content", "post-text", "entry", "entry-content", "entry-body", "hentry", "story", "story-body", "story-content", "body-copy", "page-content", "text", "body-text", "blog-post", "news-item", "prose", "markdown-body", "mw-parser-output", "paragraph", "chapter", "lead", "abstract", "section", "related-work"]
NEUTRAL_NAMES = ["container", "wrapper", "wrap", "page", "row", "col", "inner", "outer", "site", "layout", "grid", "block", "box", "column", "center", "left", "right", "body", "root", "app", "primary", "clearfix", "fluid", "item", "single", "type-post", "status-publish", "category-social", "category-news", "tag-share", "tag-comments", "with-sidebar", "has-sidebar", "no-sidebar", "has-comments", "no-comments", "comments-open", "share-enabled", "menu-open", "has-menu", "nav-fixed", "with-ads", "has-footer"]
OTHER_NAMES = {
    "menu": ["nav", "navbar", "navigation", "menu", "main-menu", "top-menu", "menubar", "site-nav", "topnav", "subnav", "breadcrumb", "breadcrumbs", "toc", "table-of-contents", "pagination", "pager", "skip-link", "dropdown", "toolbar", "tabs"],
    "header": ["header", "site-header", "page-header", "masthead", "topbar", "banner", "logo", "branding"],
    "notice": ["notice", "notices", "cookie", "cookies", "cookie-notice", "cookie-banner", "consent", "gdpr", "paywall", "popup", "modal", "overlay", "alert", "notification", "disclaimer"],
    "advert": ["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsored-content", "promo", "promoted", "promotion", "ad-slot"],
    "form": ["search", "search-form", "login", "signup", "subscribe", "subscription", "newsletter", "contact-form", "poll"],
    "share": ["share", "sharing", "share-bar", "social", "social-links", "social-media", "follow", "addtoany", "byline", "author-bio", "author-box", "post-meta", "tags", "tag-links", "post-tags", "meta-info", "print-link"],
    "comment": ["comment", "comments", "comment-list", "commentlist", "comments-area", "disqus", "disqus-thread", "reply", "replies", "respond", "discussion", "reader-comments", "user-comments", "reviews"],
    "side": ["sidebar", "sidebar-left", "side-column", "widget", "widgets", "widget-area", "secondary", "rail", "right-rail", "related", "related-posts", "related-articles", "recommended", "recommendations", "read-more", "popular", "trending", "most-read", "teaser", "more-stories"],
    "footer": ["footer", "site-footer", "page-footer", "bottom-bar", "copyright", "colophon", "legal", "credits", "footer-links"],
}
TAGS = {"menu": "nav", "header": "header", "side": "aside", "footer": "footer", "form": "form"}


def _words(rng: random.Random, few: int, many: int) -> str:
    return " ".join(["word"] * rng.randint(few, many))


def _links(rng: random.Random) -> str:
    links = [f"<a href=x>{_words(rng, 1, 4)}</a>" for _ in range(rng.randint(2, 12))]
    return f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>" if rng.random() < 0.6 else rng.choice([" ", " | ", "<br>"]).join(links)


def _named(rng: random.Random, names: list[str]) -> str:
    held = [rng.choice(names)] + [rng.choice(NEUTRAL_NAMES) for _ in range(rng.choice([0, 0, 1]))]
    return f' class="{" ".join(rng.sample(held, len(held)))}"' if rng.random() < 0.75 else f" id={held[0]}"


def _paragraph(rng: random.Random) -> str:
    text = [_words(rng, 1, rng.choice([6, 20, 40, 60]))]
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):
        tag = rng.choice(["a href=x", "a href=x", "b", "i", "em", "strong", "span", "code"])
        text += [f"<{tag}>{_words(rng, 1, 4)}</{tag.split()[0]}>", _words(rng, 1, 15)]
    return " ".join(text)


def _other(rng: random.Random, kind: str, marked: str = "") -> str:
    """A part that isn't main text."""
    if kind in ("menu", "share"):
        inside = _links(rng)
    elif kind == "comment":
        inside = f"<h3>{_words(rng, 1, 3)}</h3>" * rng.randint(0, 1) + "".join(f"<div>{'<span>' + _words(rng, 1, 3) + '</span>'}<p>{_words(rng, 2, 50)}</p>{'<a href=x>word</a>' * rng.randint(0, 2)}</div>" for _ in range(rng.randint(1, 8)))
    elif kind == "form":
        inside = f"<p>{_words(rng, 1, 12)}</p>" * rng.randint(0, 1) + "<label>word</label><input><button>word</button>"
    elif kind == "side":
        inside = "".join(f"<h4>{_words(rng, 1, 4)}</h4>" + (_links(rng) if rng.random() < 0.7 else f"<p>{_words(rng, 3, 30)}</p>") for _ in range(rng.randint(1, 4)))
    else:
        inside = f"{rng.choice(['<p>', '', '<span>'])}{_words(rng, 2, 25)}" + (_links(rng) if rng.random() < 0.3 else "")
    tag = TAGS.get(kind) if rng.random() < 0.45 else None
    name = "" if tag and rng.random() < 0.6 else _named(rng, OTHER_NAMES[kind])
    if marked == "" and not tag and kind not in ("advert", "form") and rng.random() < 0.3:
        name = ""
    tag = tag or rng.choice(["div", "div", "div", "section", "p" if kind in ("advert", "notice", "footer") and "<p" not in inside and "<ul" not in inside else "div"])
    return f"<{tag}{name}{marked}>{inside}</{tag}>"


def _block(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.62:
        return f"<p>{_paragraph(rng)}</p>"
    if kind < 0.74:
        h = rng.randint(2, 4)
        return f"<h{h}>{_words(rng, 1, 7)}</h{h}>"
    if kind < 0.82:
        tag = rng.choice(["ul", "ol"])
        return f"<{tag}>{''.join(f'<li>{_paragraph(rng)}</li>' for _ in range(rng.randint(2, 7)))}</{tag}>"
    if kind < 0.86:
        return f"<blockquote><p>{_paragraph(rng)}</p></blockquote>"
    if kind < 0.89:
        return f"<table>{''.join('<tr>' + ''.join(f'<td>{_words(rng, 1, 5)}</td>' for _ in range(3)) + '</tr>' for _ in range(rng.randint(2, 6)))}</table>"
    if kind < 0.91:
        return f"<figure><img src=x><figcaption>{_words(rng, 2, 15)}</figcaption></figure>"
    if kind < 0.93:
        return f"<pre>{_words(rng, 3, 30)}</pre>"
    return f"<div>{_paragraph(rng)}</div>"


def _main(rng: random.Random) -> str:
    title = f"<h1>{_words(rng, 1, 9)}</h1>" if rng.random() < 0.75 else ""
    if title and rng.random() < 0.25:
        title = f"<header>{title}</header>"
    style = rng.random()
    if style < 0.1:
        blocks = [f"{_paragraph(rng)}<br>" * rng.randint(1, 2) for _ in range(rng.randint(2, 10))]
    elif style < 0.16:
        blocks = [f"<div>{_paragraph(rng)}</div>" for _ in range(rng.randint(2, 12))]
    else:
        blocks = [_block(rng) for _ in range(rng.choice([1, 2, 4, 8, 15, 30]))]
    for kind in ("advert", "share", "side", "form", "menu", "comment", "footer"):
        if rng.random() < 0.13:
            blocks.insert(len(blocks) if kind in ("comment", "footer") else rng.randint(0, len(blocks)), _other(rng, kind, " data-not"))
    if rng.random() < 0.3:
        cut = sorted(rng.randint(0, len(blocks)) for _ in range(rng.randint(0, 3)))
        blocks = [f"<section{_named(rng, CONTENT_NAMES + NEUTRAL_NAMES) if rng.random() < 0.4 else ''}>{''.join(blocks[a:b])}</section>" for a, b in zip([0, *cut], [*cut, len(blocks)], strict=True)]
    out = title + "".join(blocks)
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 6])):
        out = f"<div{_named(rng, NEUTRAL_NAMES) if rng.random() < 0.5 else ''}>{out}</div>"
    return out


def made_page(rng: random.Random) -> str:
    shape = rng.random()
    name = lambda p: _named(rng, CONTENT_NAMES) if rng.random() < p else ""
    if shape < 0.3:
        main = f"<article{name(0.5)} data-main>{_main(rng)}</article>"
    elif shape < 0.4:
        main = f"<main{name(0.3)} data-main>{_main(rng)}</main>"
    elif shape < 0.46:
        main = "".join(f"<article{name(0.5)} data-main>{_main(rng)}</article>" for _ in range(rng.randint(2, 4)))
    elif shape < 0.75:
        main = f"<div{name(1)} data-main>{_main(rng)}</div>"
    elif shape < 0.8:
        main = f"<table><tr><td data-main>{_main(rng)}</td></tr></table>"
    else:
        main = f"<div data-main>{_main(rng)}</div>"
    before = [_other(rng, kind) for kind, p in (("menu", 0.7), ("header", 0.6), ("notice", 0.3), ("advert", 0.3), ("form", 0.3), ("menu", 0.2), ("side", 0.15)) if rng.random() < p]
    after = [_other(rng, kind) for kind, p in (("share", 0.3), ("comment", 0.35), ("side", 0.45), ("advert", 0.2), ("menu", 0.2), ("notice", 0.2), ("footer", 0.75)) if rng.random() < p]
    if "<article" in main and rng.random() < 0.15:
        after.append("".join(f"<article class=teaser><h3>{_words(rng, 1, 6)}</h3><p>{_words(rng, 3, 15)}</p></article>" for _ in range(3)))
    rng.shuffle(before)
    rng.shuffle(after)
    for _ in range(rng.choice([0, 0, 1, 2])):
        main = f"<div{_named(rng, NEUTRAL_NAMES) if rng.random() < 0.8 else ''}>{main}</div>"
    page = "".join([*before, main, *after])
    if rng.random() < 0.3:
        page = f"<div{_named(rng, NEUTRAL_NAMES)}>{page}</div>"
    return f"<html><head><title>word</title><style>p{{}}</style></head><body>{page}<script>x</script></body></html>"


def labelled_pages(n: int = 3000, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [made_page(rng) for _ in range(n)]
