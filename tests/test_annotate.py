import pytest

from lectern.operators import annotate as A
from lectern.operators import resolver as R
from lectern.operators.chunk import ChunkConfig, chunk, chunk_blocks, pack, windows
from tests.papers import ARTICLE, MAJOR, REVIEW


def kept(text):
    return [(b.text[:20], b.heading, b.level, b.section, round(b.confidence, 2)) for b in A.annotate_text(text) if A.is_kept(b)]


def test_article_with_second_level_headings():
    got = kept(ARTICLE)
    assert [x[3] for x in got if x[1]] == ["Other", "Abstract", "Introduction", "Results", "Methods", "References"]
    assert ("We found that foldin", False, 0, "Results", 0.88) in got
    assert got[0] == ("A Study of Paper Fol", True, 1, "Other", 0.92)
    # references are no body
    assert not any(x[0].startswith("1. Berg") for x in got)


def test_authors_are_front_matter_and_not_kept():
    roles = {b.text[:9]: b.role for b in A.annotate_text(ARTICLE)}
    assert roles["Anna Berg"] == "front_matter" and roles["A Study o"] == "title" and roles["Table 1"[:9]] == "table_caption"


def test_second_level_headings_leave_no_active_role():
    second, first = A.annotate_text(ARTICLE), A.annotate_text(MAJOR)
    assert {b.role for b in second if b.key == "results"} == {"subsection_heading"}
    assert {b.role for b in first if b.key == "results"} == {"section_heading"}


def test_review_gets_sections_from_cues():
    sections = {b.text[:6]: b.section for b in A.annotate_text(REVIEW)}
    assert sections["Summar"] == "Abstract" and sections["Biblio"] == "References"


def test_numbered_heading_resolves_by_cue():
    blocks = A.annotate_text("# A rather long title of a paper\n\n## 1. Introduction\n\nSome text of it.\n\n## 2. Methods of work\n\nMore text.")
    assert [b.section for b in blocks if b.heading] == ["Other", "Introduction", "Methods"]
    assert blocks[1].confidence == 0.62


def test_heading_keeps_its_first_line_only():
    (b,) = A.blocks_of("# Head\nglued text")
    assert b.text == "Head" and b.raw == "# Head\nglued text"


@pytest.mark.parametrize("text", ["", "   \n\n ", None])
def test_empty_texts_have_no_blocks(text):
    assert A.annotate_text(text) == []


def test_other_decoder_and_unknown_one():
    assert {b.section for b in A.annotate_text(MAJOR, "rules")} >= {"Results", "Methods"}
    with pytest.raises(KeyError):
        A.annotate_text(MAJOR, "none")


def test_frames_agree_with_the_core(spark):
    docs = spark.createDataFrame([(1, ARTICLE), (2, REVIEW), (3, ""), (4, None)], "doc_id int, text string")
    annotated = A.annotate(docs)
    assert A.block_rows(annotated).where("doc_id = 1").count() == len(A.annotate_text(ARTICLE))
    out = A.outline(annotated).where("doc_id = 1").orderBy("ord").collect()
    body = [b for b in A.annotate_text(ARTICLE) if A.is_kept(b) and not b.heading]
    assert sum(r.char_count for r in out) == sum(len(b.text) for b in body)
    assert [r.section for r in out][:2] == ["Other", "Abstract"] and out[0].char_count == 0
    chunks = chunk(annotated, ChunkConfig(20, 100, 10)).where("doc_id = 1").orderBy("chunk_index").collect()
    assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and chunks[0].heading_path.endswith("Abstract")


def test_repair_reports_captions_and_low_confidence():
    issues, low = A.repair_issues(A.annotate_text("# Results\n\n(A) this is a panel text\n\nplain body text here"))
    assert low and [i[0] for i in issues] == ["caption_body_demoted"]


class Chat:
    def __init__(self, items):
        self.items, self.calls = items, 0

    def complete(self, prompt, json_schema):
        self.calls += 1
        return {"items": self.items}


def test_resolver_overrides_doubtful_blocks_and_caches():
    text = "plain one two three\n\nsome words of no section at all in here\n\nlast words"
    item = {"block_index": 1, "decision": "override", "section_type": "Results", "confidence": 0.9, "rationale": "r"}
    bad = {**item, "block_index": 0, "section_type": "Nowhere"}
    chat, cache = Chat([item, bad]), {}
    blocks = A.annotate_text(text, resolve=R.resolver(chat, cache))
    assert blocks[1].section == "Results" and blocks[0].section == "Other"
    A.annotate_text(text, resolve=R.resolver(chat, cache))
    assert chat.calls == 1
    weak = A.annotate_text(text, resolve=R.resolver(Chat([{**item, "confidence": 0.5}])))
    assert weak[1].section == "Other" and R.resolver(None) is None


@pytest.mark.parametrize("cfg", [(10, 100, 0), (20, 280, 70), (100, 400, 0)])
def test_windows_cover_the_text(cfg):
    config = ChunkConfig(*cfg)
    text = "One two three four. Five six? Seven eight nine ten! " * 20
    pieces = list(windows(text, config))
    assert all(len(p) <= config.max_chunk for p in pieces) and pieces[0].startswith("One") and text.strip().endswith(pieces[-1])
    at = 0
    for p in pieces:
        at = text.index(p, max(0, at - config.overlap - 2))
        at += len(p)


def test_small_chunks_join_forward_and_trailing_ones_stay():
    assert pack(["a" * 5, "b" * 30, "c" * 5], ChunkConfig(10, 32, 0)) == ["a" * 5 + "\n\n" + "b" * 30, "c" * 5]


def test_groups_keep_sections_apart():
    blocks = [{"is_heading": h, "heading_level": lvl, "section": s, "text": t} for h, lvl, s, t in [(True, 1, "A", "H"), (False, 0, "A", "x"), (True, 2, "A", "I"), (False, 0, "A", "y"), (True, 1, "B", "J"), (False, 0, "B", "z")]]
    assert [(c["section"], c["heading_path"], c["content"]) for c in chunk_blocks(blocks, ChunkConfig(1, 10, 0))] == [("A", "H", "x"), ("A", "H > I", "y"), ("B", "J", "z")]


@pytest.mark.parametrize("cfg", [(10, 10, 10), (10, 0, 0), (10, 100, -1), (10, 100, 53)])
def test_unsafe_configs_are_refused(cfg):
    with pytest.raises(ValueError):
        ChunkConfig(*cfg)


def test_phrases_are_what_the_patterns_are():
    """Also with letters that count as ASCII ones without case; the pattern isn't tried on a text without a phrase."""
    import re

    from lectern.operators import vocabulary as V

    plain = r"\b(in summary|left to right|kinds|this study shows)\b"
    found = V.Phrases(plain)
    texts = ["In Summary", "inſummary", "in ſummary", "İn summary", "ın summary", "within summary", "left to right-", "left to\nright", "Kinds", "kind", "", "xkinds kinds", "This ſtudy showſ", "this study showsx"]
    assert [bool(found.search(t)) for t in texts] == [bool(re.search(plain, t, re.I)) for t in texts]
    assert any(found.search(t) for t in texts[2:]) and not all(found.search(t) for t in texts)
    found.pattern = None
    assert found.search("a long text without any of them " * 100) is None
    with pytest.raises(ValueError):
        V.Phrases(r"\b(we (?:used|found))\b")
    assert A.is_preamble("KEY  WORDS : x") and A.is_preamble("to a.b@c.de") and not A.is_preamble("a @ b")
