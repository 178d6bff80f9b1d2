"""Blocks of cleaned markdown with roles and sections, and the section outline.

Both passes over a document carry a state from block to block, so one document
is annotated by one Python call, batched by Arrow; a document is a row, so
nothing is shuffled.  Roles and sections are ordered rules, first match wins.
What a rule asks of other blocks (the next mapped heading, the sample of
following body text, heading counts...) is computed once per document.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from lectern import schemas
from lectern.functions.text import CASED_SIGNALS, SIGNALS
from lectern.operators import vocabulary as V
from lectern.session import bound_batches

ROLES = ("unknown", "title", "front_matter", "section_heading", "subsection_heading", "figure_caption", "table_caption", "body_paragraph", "reference_entry", "ack_meta", "summary_box", "supplementary_meta")
MAJOR_ROLES = frozenset(["section_heading", "ack_meta", "supplementary_meta", "summary_box"])
_HEADING = re.compile(r"^(#{1,6})\s+(.+)")
# what begins with ^ is asked of a text's start only
_STARTS = {name: re.compile(pattern, 0 if name in CASED_SIGNALS else re.I).match for name, pattern in SIGNALS.items() if pattern.startswith("^")}
_SIGNALS = _STARTS | {name: V.Phrases(pattern).search for name, pattern in SIGNALS.items() if name not in _STARTS}
_SHORT = re.compile(r"[A-Za-z0-9_.:-]+")


@lru_cache(64)
def squeeze(text: str) -> str:
    return " ".join(text.split())


def key_of(text: str) -> str:
    return squeeze(text).lower()


@dataclass
class Block:
    index: int
    raw: str
    text: str
    level: int  # 0: a paragraph
    ratio: float
    anchor: int | None
    line_count: int
    signals: SimpleNamespace
    key: str
    role: str = "unknown"
    confidence: float = 0.0
    role_confidence: float = 0.0
    rationale: str = ""
    section: str = "Other"
    subsection: str = ""

    @property
    def heading(self) -> bool:
        return self.level > 0


@dataclass
class Facts:
    """What rules ask of a document as a whole."""

    blocks: list[Block]
    marker: int = 0
    counts: Counter = field(default_factory=Counter)
    next_direct: list[str] = field(default_factory=list)
    previous_direct: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)
    review_like: bool = False
    has_title: bool = False


def signals_of(text: str) -> SimpleNamespace:
    found = {name: bool(search(text)) for name, search in _SIGNALS.items()}
    compact = text.replace(" ", "")
    return SimpleNamespace(**found, looks_like_short_label=len(compact) <= 12 and bool(_SHORT.fullmatch(compact)))


def blocks_of(text: str) -> list[Block]:
    raws = [b for b in (x.strip() for x in re.split(r"\n{2,}", text)) if b]
    out: list[Block] = []
    anchor = None
    for i, raw in enumerate(raws):
        m = _HEADING.match(raw)
        body = m[2].strip() if m else raw
        out.append(Block(i, raw, body, len(m[1]) if m else 0, i / max(len(raws) - 1, 1), anchor, sum(bool(x.strip()) for x in raw.splitlines()), signals_of(body), key_of(body)))
        if m:
            anchor = i
    return out


# --- tests of single texts


def is_summary_label(text: str) -> bool:
    text = squeeze(text)
    return key_of(text.replace(" ", "") if V.SPACED_CAPITALS.fullmatch(text) else text) in V.SUMMARY_LABELS


def lists_names(text: str) -> bool:
    names = len(V.WIDE_NAME.findall(text))
    return names >= 2 or names == 1 and ("*" in text or any(c.isdigit() for c in text))


def is_preamble(text: str) -> bool:
    text = squeeze(text)
    return bool(text) and bool(V.PREAMBLE_START.match(text) or "@" in text and V.ADDRESS.search(text) or V.PREAMBLE.search(text) or lists_names(text))


def has_joiner(text: str) -> bool:
    return "," in text or " and " in text.lower() or "*" in text or bool(re.search(r"\d", text))


def is_author_line(text: str, name: re.Pattern = V.PLAIN_NAME) -> bool:
    text = squeeze(text)
    return "@" in text or len(name.findall(text)) >= 2 and has_joiner(text)


def is_major_free(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return 2 <= len(text.split()) <= 12 and bool(letters) and sum(c.isupper() for c in letters) / len(letters) >= 0.6


def is_substantive(text: str) -> bool:
    text = squeeze(text)
    return len(text) >= 80 and not V.METADATA_BODY.search(text) and "@" not in text and "www." not in text.lower() and sum(c.isalpha() for c in text) >= 50


def numbered_section(text: str) -> str:
    """The section that a numbered label such as "2 Methods" names, else Other."""
    m = V.NUMBERED_LABEL.match(squeeze(text))
    if not m:
        return "Other"
    label = m[1].lower()
    return next((s for start, s in (("abstract", "Abstract"), ("introduction", "Introduction"), ("result", "Results"), ("discussion", "Discussion"), ("method", "Methods"), ("materials", "Methods"), ("conclusion", "Conclusion")) if label.startswith(start)), "Other")


def cued_section(key: str) -> str:
    return next((section for section, cues in V.HEADING_CUES if any(c in key for c in cues)), "Other")


# --- roles


def _near_preamble(doc: Facts, i: int) -> bool:
    return any(b.signals.has_affiliation_keywords or b.signals.has_received_dates or is_preamble(b.text) for b in doc.blocks[i + 1 : i + 5])


def _leads_as_title(b: Block, doc: Facts) -> bool:
    text = squeeze(b.text)
    return bool(text) and b.index < min(doc.marker, 12) and 40 <= len(b.text) <= 260 and not is_preamble(text) and text[-1] not in ".;!?" and not is_summary_label(text) and sum(c in ".;:!?" for c in text) <= 1 and _near_preamble(doc, b.index)


def _dated_or_placed(b: Block) -> bool:
    return b.signals.has_affiliation_keywords or b.signals.has_received_dates


Rule = tuple[Callable[[Block, str, Facts], bool], str, float, str]
HEADING_RULES: list[Rule] = [
    (lambda b, active, doc: b.signals.starts_with_figure_token, "figure_caption", 0.99, "figure token"),
    (lambda b, active, doc: b.signals.starts_with_table_token, "table_caption", 0.99, "table token"),
    (lambda b, active, doc: b.key in V.FRONT_HEADINGS, "front_matter", 0.96, "front matter text"),
    (lambda b, active, doc: b.key in V.ACK_HEADINGS, "ack_meta", 0.96, "thanks"),
    (lambda b, active, doc: b.key in V.SUPPLEMENT_HEADINGS, "supplementary_meta", 0.96, "supplement"),
    (lambda b, active, doc: b.signals.looks_like_summary_heading, "summary_box", 0.92, "summary word"),
    (lambda b, active, doc: b.key in V.CANONICAL_HEADINGS and b.level <= 1, "section_heading", 0.95, "known heading"),
    (lambda b, active, doc: b.key in V.CANONICAL_HEADINGS, "subsection_heading", 0.95, "known lower heading"),
    (lambda b, active, doc: b.index == 0 and b.ratio <= 0.08 and (len(b.text) >= 20 or _near_preamble(doc, 0)), "title", 0.97, "leads the document"),
    (lambda b, active, doc: active in ("section_heading", "summary_box", "supplementary_meta"), "subsection_heading", 0.78, "under a major heading"),
    (lambda b, active, doc: 0.05 <= b.ratio <= 0.92, "subsection_heading", 0.62, "free heading"),
    (lambda b, active, doc: True, "unknown", 0.35, "undecided"),
]
PARAGRAPH_RULES: list[Rule] = [
    (lambda b, active, doc: b.signals.looks_like_caption_body, "figure_caption", 0.92, "caption words"),
    (lambda b, active, doc: b.signals.starts_with_table_token, "table_caption", 0.95, "table token"),
    (lambda b, active, doc: b.signals.has_reference_markers and b.ratio >= 0.6, "reference_entry", 0.86, "numbered in the tail"),
    (lambda b, active, doc: active == "ack_meta", "ack_meta", 0.95, "under thanks"),
    (lambda b, active, doc: active == "supplementary_meta", "supplementary_meta", 0.94, "under a supplement"),
    (lambda b, active, doc: active == "unknown" and b.index <= doc.marker and is_summary_label(b.text), "summary_box", 0.91, "summary label"),
    (lambda b, active, doc: active == "unknown" and b.index <= doc.marker and (_dated_or_placed(b) or is_preamble(b.text)), "front_matter", 0.9, "preamble facts"),
    (lambda b, active, doc: active == "unknown" and b.index <= doc.marker and _leads_as_title(b, doc), "title", 0.91, "preamble title"),
    (lambda b, active, doc: active == "summary_box" and is_preamble(b.text), "front_matter", 0.9, "facts in a summary"),
    (lambda b, active, doc: active == "unknown" and _dated_or_placed(b) and (b.ratio <= 0.35 or b.anchor == 0), "front_matter", 0.93, "front matter facts"),
    (lambda b, active, doc: b.signals.looks_like_short_label, "unknown", 0.42, "short label"),
    (lambda b, active, doc: True, "body_paragraph", 0.88, "body"),
]


def recover_roles(blocks: list[Block]) -> Facts:
    """Gives each block its role; the last major role so far is what rules see as active."""
    doc = Facts(blocks)
    structural = V.CANONICAL_HEADINGS | V.ACK_HEADINGS | V.SUPPLEMENT_HEADINGS
    doc.marker = next((b.index for b in blocks if (b.key in structural if b.heading else V.NUMBERED_MARKER.match(b.text) or is_summary_label(b.text))), len(blocks))
    active = "unknown"
    for b in blocks:
        _, b.role, b.confidence, b.rationale = next(rule for rule in (HEADING_RULES if b.heading else PARAGRAPH_RULES) if rule[0](b, active, doc))
        b.role_confidence = b.confidence
        if b.role in MAJOR_ROLES:
            active = b.role
    return doc


# --- sections


def _collect(doc: Facts) -> None:
    direct = [V.SECTION_OF_HEADING.get(b.key, "Other") if b.heading else "Other" for b in doc.blocks]
    n = len(direct)
    doc.counts = Counter(b.key for b in doc.blocks if b.heading)
    doc.previous_direct, doc.next_direct, doc.samples = ["Other"] * n, ["Other"] * n, [""] * n
    seen = "Other"
    for i in range(n):
        doc.previous_direct[i] = seen
        seen = direct[i] if direct[i] != "Other" else seen
    seen, ahead = "Other", []
    for i in reversed(range(n)):
        doc.next_direct[i], doc.samples[i] = seen, " ".join(ahead)
        b = doc.blocks[i]
        seen = direct[i] if direct[i] != "Other" else seen
        if b.heading:
            ahead = []
        elif b.role == "body_paragraph":
            ahead = [b.text, *ahead][:2]
    doc.review_like = not {"Results", "Methods"} & set(direct)
    doc.has_title = any(b.role == "title" for b in doc.blocks)


def _from_sample(sample: str) -> tuple[str, float, str] | None:
    return next(((s, c, "cue in the text below") for s, c, p in V.BODY_CUES if sample and p.search(sample)), None)


CARRIED = frozenset(["Methods", "Results", "Discussion", "Introduction", "Supplementary", "Acknowledgments", "Author_Info", "References"])


def by_position(current: str, ratio: float, abstract_seen: bool) -> str:
    if current in CARRIED:
        return current
    if abstract_seen and 0.08 <= ratio <= 0.78:
        return "Results"
    return "Introduction" if ratio < 0.2 else "Discussion" if ratio > 0.85 else "Other"


def _last_resort(b: Block, doc: Facts, current: str, abstract_seen: bool, weak: tuple[float, float], unresolved: str, what: str) -> tuple[str, float, str]:
    if (section := by_position(current, b.ratio, abstract_seen)) != "Other":
        return section, 0.66 if abstract_seen else weak[0], f"{what}: by place"
    if b.ratio <= 0.18:
        return "Introduction", weak[1], f"{what}: early"
    if b.ratio >= 0.8:
        return "Discussion", weak[1], f"{what}: late"
    return "Other", 0.42, unresolved


def infer_heading(b: Block, doc: Facts, current: str, abstract_seen: bool) -> tuple[str, float, str]:
    if (section := cued_section(b.key)) != "Other":
        return section, 0.84, "cue word"
    if current in ("Methods", "Results", "Discussion", "Introduction", "Conclusion"):
        return current, 0.82, "active section"
    following = doc.next_direct[b.index]
    if following == "Results" and b.ratio <= 0.2:
        return "Introduction", 0.74, "early before results"
    if following == "Methods" and b.ratio >= 0.55:
        return "Discussion", 0.73, "late before methods"
    if found := _from_sample(doc.samples[b.index]):
        return found
    if doc.review_like:
        if b.ratio <= 0.25:
            return "Introduction", 0.61, "early in a review"
        if b.ratio >= 0.82:
            return "Conclusion" if "conclusion" in b.key else "Discussion", 0.6, "late in a review"
        return "Discussion", 0.56, "inside a review"
    return _last_resort(b, doc, current, abstract_seen, (0.6, 0.56), "undecided", "heading")


def infer_body(b: Block, doc: Facts, abstract_seen: bool) -> tuple[str, float, str]:
    if (section := numbered_section(b.text)) != "Other":
        return section, 0.9, INLINE
    if found := _from_sample(doc.samples[b.index]):
        return found
    if (section := doc.previous_direct[b.index]) != "Other":
        return section, 0.78, "mapped heading above"
    if doc.next_direct[b.index] == "Results" and b.ratio <= 0.18:
        return "Introduction", 0.72, "early before results"
    if doc.review_like:
        if doc.has_title and 0.08 <= b.ratio <= 0.2 and is_substantive(b.text):
            return "Introduction", 0.72, "lede of a review"
        if b.ratio <= 0.2:
            return "Introduction", 0.6, "early in a review"
        if b.ratio >= 0.82:
            summing = "in summary" in b.text.lower()
            return ("Conclusion", 0.62, "late in a review") if summing else ("Discussion", 0.58, "late in a review")
        return "Discussion", 0.54, "inside a review"
    return _last_resort(b, doc, "Other", abstract_seen, (0.58, 0.54), "undecided", "body")


INLINE = "numbered label in body"


def _title_like(b: Block, doc: Facts) -> bool:
    before = doc.blocks[: b.index]
    if b.index > 2 or b.ratio > 0.25 or any(x.heading or x.role == "body_paragraph" and len(x.text) >= 30 for x in before):
        return False
    if len(b.key) < 12 or is_author_line(b.text) or V.PAGE_MARKER.fullmatch(b.key) or V.RUNNING_HEADER.search(b.text):
        return False
    return not any(w in b.key for w in ("copyright", "doi", "received"))


def decide_heading(b: Block, doc: Facts, current: str, abstract_seen: bool) -> tuple[str, str, float, str, bool]:
    """(section, subsection, confidence, rationale, whether the state moves on)."""
    author = is_author_line(b.text)
    if V.PAGE_MARKER.fullmatch(b.key) or V.RUNNING_HEADER.search(b.text) or doc.counts[b.key] >= 3 and b.index > 3 or author and b.ratio >= 0.2:
        return current, b.text if current != "Other" else "", 0.35, "running header", False
    if b.role == "front_matter" or b.role != "title" and author:
        return "Author_Info", "", 0.9, "names", False
    if b.role == "ack_meta":
        return "Acknowledgments", "", 0.95, "thanks", True
    if b.role == "supplementary_meta":
        return "Supplementary", "", 0.95, "supplement", True
    if b.role == "summary_box":
        section = "Abstract" if b.ratio <= 0.2 else "Other"
        return section, "", 0.9, "summary box", section != "Other"
    major = b.role == "section_heading" or is_major_free(squeeze(b.text))
    if (section := V.SECTION_OF_HEADING.get(b.key, "Other")) != "Other":
        return section, "" if major else b.text, 0.84 if b.role == "unknown" else 0.95, "mapped heading", True
    title_like = _title_like(b, doc)
    if b.role == "title" or title_like:
        return "Other", "", 0.92, "title", False
    section, confidence, rationale = infer_heading(b, doc, current, abstract_seen)
    major = major or doc.review_like and not abstract_seen and b.ratio >= 0.15 and not author
    taken = section != "Other" and confidence >= 0.72
    return section if taken else "Other", b.text if taken and not major else "", confidence, rationale, taken


@dataclass
class State:
    section: str = "Other"
    subsection: str = ""
    abstract_seen: bool = False

    def move(self, section: str, subsection: str = "") -> None:
        self.section, self.subsection = section, subsection


def _decode_shared(b: Block, s: State) -> bool:
    """The roles that both decoders treat alike; whether this was one."""
    if b.role == "front_matter":
        b.section, b.subsection, b.rationale = "Author_Info", "", "front matter"
    elif b.role in ("ack_meta", "supplementary_meta"):
        b.section, b.subsection = ("Acknowledgments" if b.role == "ack_meta" else "Supplementary"), ""
        b.rationale = "thanks region" if b.role == "ack_meta" else "supplement region"
        s.move(b.section)
    elif b.role == "reference_entry":
        inline = numbered_section(b.text)
        b.section, b.subsection = (inline if inline != "Other" else "References"), ""
        b.rationale = "numbered label" if inline != "Other" else "reference"
        s.move(b.section)
    elif b.role in ("figure_caption", "table_caption"):
        b.rationale, b.confidence = "caption", min(b.confidence, 0.8)
    else:
        return False
    return True


def decode_by_context(doc: Facts) -> None:
    """The default decoder."""
    _collect(doc)
    s = State()
    for b in doc.blocks:
        b.section, b.subsection, b.rationale = s.section, s.subsection, "inherited"
        if b.heading:
            b.section, b.subsection, confidence, b.rationale, moves = decide_heading(b, doc, s.section, s.abstract_seen)
            b.confidence = min(b.confidence, confidence)
            if moves:
                s.move(b.section, b.subsection)
                s.abstract_seen |= b.section == "Abstract"
        elif not _decode_shared(b, s) and b.role == "body_paragraph":
            if s.section not in ("Other", "Author_Info"):
                b.rationale = "inherited body"
                continue
            section, confidence, why = infer_body(b, doc, s.abstract_seen)
            b.confidence = min(b.confidence, confidence)
            if section != "Other" and confidence >= 0.7:
                b.section, b.rationale = section, "inferred body"
                if why == INLINE:
                    s.move(section)
                    b.subsection = ""
            else:
                b.section, b.rationale = "Other", why


def decode_by_rules(doc: Facts) -> None:
    """The alternative decoder: headings by map and position only."""
    s = State()
    for b in doc.blocks:
        b.section, b.subsection, b.rationale = s.section, s.subsection, "inherited"
        if b.role == "title":
            b.section, b.subsection, b.rationale, b.confidence = "Other", "", "title", min(b.confidence, 0.95)
        elif b.role == "summary_box":
            b.section, b.subsection, b.rationale = ("Abstract" if b.ratio <= 0.2 else "Other"), "", "summary box"
            s.move(b.section)
        elif b.role == "section_heading":
            b.section, b.subsection, b.rationale = V.SECTION_OF_HEADING.get(b.key, "Other"), "", "section heading"
            s.move(b.section)
            s.abstract_seen |= b.section == "Abstract"
        elif b.role == "subsection_heading":
            section = V.SECTION_OF_HEADING.get(b.key, "Other")
            b.rationale = "mapped lower heading"
            if section == "Other":
                section = by_position(s.section, b.ratio, s.abstract_seen)
                b.rationale, b.confidence = "inferred lower heading", min(b.confidence, 0.72)
            b.section, b.subsection = section, b.text
            s.move(section, b.text)
        elif not _decode_shared(b, s) and b.role == "body_paragraph":
            b.rationale = "inherited body"
            if s.section == "Other" and s.abstract_seen and b.ratio <= 0.75:
                b.section, b.rationale, b.confidence = "Results", "after the abstract", min(b.confidence, 0.68)


DECODERS = {"context": decode_by_context, "rules": decode_by_rules}


# --- repair and result


def is_caption_noise(text: str) -> bool:
    text = squeeze(text)
    return bool(V.CAPTION_START.match(text) or V.CAPTION_CUE.search(text))


def is_kept(b: Block) -> bool:
    """Headings stay, and of paragraphs the body ones that aren't captions."""
    return b.heading or b.role == "body_paragraph" and not is_caption_noise(b.text)


def repair_issues(blocks: list[Block]) -> tuple[list[tuple[str, int | None, str]], bool]:
    """(issues (type, paragraph number, detail), whether confidence is low)."""
    issues: list[tuple[str, int | None, str]] = []
    paragraphs = [b for b in blocks if not b.heading]
    body = [b for b in paragraphs if b.role == "body_paragraph"]
    for i, b in enumerate(paragraphs):
        if b.role == "body_paragraph" and is_caption_noise(b.text):
            issues.append(("caption_body_demoted", i, b.text[:160]))
    other = sum(b.section == "Other" for b in body)
    if body and other / len(body) >= 0.2:
        issues.append(("body_other_ratio_high", None, f"{other}/{len(body)}"))
    return issues, bool(issues) or any(b.role_confidence < 0.7 for b in blocks)


def annotate_text(text: str | None, decoder: str = "context", resolve: Callable[[list[Block]], None] | None = None, recover: Callable[[list[Block]], Facts] | None = None) -> list[Block]:
    """All blocks of a cleaned text, annotated; ``recover`` says their roles, ``resolve`` may change those of doubtful section."""
    doc = (recover or recover_roles)(blocks_of(text or ""))
    DECODERS[decoder](doc)
    if resolve:
        resolve(doc.blocks)
    return doc.blocks


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", decoder: str = "context", resolve: Callable[[list[Block]], None] | None = None, recover: Callable[[list[Block]], Facts] | None = None, decided: tuple[str, Callable[[list[Block], list[dict]], None]] | None = None) -> DataFrame:
    """(id, blocks, error): the annotated blocks of each cleaned text as an array of structs; ``kept`` marks those that count.

    A text that can't be annotated has an error and no blocks.  ``decided`` names a
    column of decisions (JSON) on the text's blocks, and what puts them into effect.
    """
    bound_batches(docs.sparkSession)

    def one(text: str | None, items: str | None) -> tuple[list[tuple] | None, str | None]:
        by = (lambda blocks: decided[1](blocks, json.loads(items))) if items else resolve
        try:
            return [(b.index, b.raw, b.text, b.heading, b.level, b.role, b.section, b.subsection, float(b.confidence), b.rationale, is_kept(b)) for b in annotate_text(text, decoder, by, recover)], None
        except Exception as e:  # a text that can't be annotated fails alone
            return None, f"annotate: {e}"

    structs = StructType.fromDDL(schemas.BLOCKS)
    fields = list(to_arrow_schema(structs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(text.as_py(), items.as_py()) for text, items in zip(batch.column(1), batch.column(2), strict=True)]
            ends = list(accumulate((len(rows or ()) for rows, _ in got), initial=0))
            columns = list(zip(*(row for rows, _ in got for row in rows or ()), strict=True)) or [()] * len(fields)
            blocks = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks, mask=pa.array([rows is None for rows, _ in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([error for _, error in got], pa.string())], names=["id", "blocks", "error"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(decided[0]) if decided else F.lit(None).cast("string")).alias("items"))
    schema = StructType([rows.schema["id"]]).add("blocks", ArrayType(structs)).add("error", "string")
    return rows.mapInArrow(each, schema).withColumnRenamed("id", id_col)


def block_rows(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each block."""
    return annotated.select(id_col, F.inline("blocks"))


def outline(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ord, section, char_count, text): sections by first appearance, headings included; body length and text without separator.

    Works on each row's array, so nothing is shuffled.
    """
    kept = F.filter("blocks", lambda b: b["kept"])
    rows = annotated.select(id_col, kept.alias("kept"))
    names = F.array_distinct(F.transform("kept", lambda b: b["section"]))
    text = F.array_join(F.transform(F.filter("kept", lambda b: (b["section"] == F.col("section")) & ~b["is_heading"]), lambda b: b["text"]), "")
    rows = rows.select(id_col, "kept", F.posexplode(names).alias("ord", "section"))
    return rows.select(id_col, "ord", "section", text.alias("text")).select(id_col, "ord", "section", F.length("text").cast("long").alias("char_count"), "text")


def histograms(annotated: DataFrame, id_col: str = "doc_id", low: float = 0.7) -> DataFrame:
    """(id, roles, sections, doubtful): how many blocks have each role and section, and the numbers of those of low confidence.

    Works on each row's array, so nothing is shuffled.
    """

    def counted(field: str) -> Column:
        names = F.transform("blocks", lambda b: b[field])
        pairs = F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.struct(n.alias("name"), F.size(F.filter(names, lambda x: x == n)).alias("n")))
        return F.map_from_entries(pairs)

    doubtful = F.transform(F.filter("blocks", lambda b: b["confidence"] < low), lambda b: b["idx"])
    return annotated.select(id_col, counted("role").alias("roles"), counted("section").alias("sections"), doubtful.alias("doubtful"))
