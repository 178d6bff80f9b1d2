"""Fixed words and patterns of the annotator and the metadata operators."""

import re
from functools import lru_cache

# What re.I takes for ASCII letters besides them.
_ALIKE = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))


@lru_cache(64)
def folded(text: str) -> str:
    """A text in which all letters that re.I takes for an ASCII letter are that letter, small."""
    if not text.isascii():
        for letter, plain in _ALIKE:
            text = text.replace(letter, plain)
    return text.lower()


class Phrases:
    """The pattern \\b(one|another)\\b without case, of plain phrases; it is tried only on texts that have one of them."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern, re.I)
        inner = re.fullmatch(r"\\b\(([a-z ,-]+(?:\|[a-z ,-]+)*)\)\\b", pattern)
        if not inner:
            raise ValueError(f"not a choice of plain phrases: {pattern}")
        self.phrases = inner[1].split("|")

    def search(self, text: str) -> re.Match | None:
        low = folded(text)
        for phrase in self.phrases:
            if phrase in low:
                return self.pattern.search(text)
        return None


# Heading texts by what they open.
SECTION_OF_HEADING = {
    "abstract": "Abstract", "summary": "Abstract", "graphical abstract": "Abstract",
    "introduction": "Introduction", "background": "Introduction",
    "results": "Results", "results and discussion": "Results",
    "discussion": "Discussion",
    "methods": "Methods", "materials and methods": "Methods", "methodology": "Methods", "experimental procedures": "Methods", "experimental section": "Methods",
    "conclusion": "Conclusion", "conclusions": "Conclusion",
    "references": "References", "references and notes": "References", "bibliography": "References",
    "supplementary material": "Supplementary", "supplementary materials": "Supplementary", "supplementary data": "Supplementary", "supplementary information": "Supplementary", "supporting information": "Supplementary",
    "acknowledgments": "Acknowledgments", "acknowledgements": "Acknowledgments", "funding": "Acknowledgments",
    "data and materials availability": "Author_Info", "data availability": "Author_Info", "code availability": "Author_Info",
}
SECTIONS = ("Abstract", "Introduction", "Results", "Discussion", "Methods", "Conclusion", "References", "Supplementary", "Acknowledgments", "Author_Info", "Other")
CANONICAL_HEADINGS = frozenset(["abstract", "introduction", "background", "results", "discussion", "results and discussion", "methods", "materials and methods", "methodology", "experimental procedures", "experimental section", "conclusion", "conclusions", "references", "references and notes", "bibliography"])
ACK_HEADINGS = frozenset(["acknowledgments", "acknowledgements", "funding", "author contributions", "competing interests", "conflict of interest", "data availability", "data and materials availability", "code availability"])
SUPPLEMENT_HEADINGS = frozenset(["supplementary material", "supplementary materials", "supplementary data", "supplementary information", "supporting information", "extended data"])
FRONT_HEADINGS = frozenset(["these authors contributed equally to this work."])
SUMMARY_LABELS = frozenset(["abstract", "summary", "article info"])

# Parts of heading texts that hint at a section, in the order they are tried.
HEADING_CUES = (
    ("Results", ["result", "results", "predict", "prediction", "identify", "identifies", "construction", "design", "characterization", "effect", "effects", "regulation", "regulates", "promotes", "reveals", "revealed", "find", "finds"]),
    ("Methods", ["method", "methods", "experimental", "procedure", "protocol", "assay", "simulation", "simulations", "analysis", "calculation", "calculations", "statistics", "statistical", "materials"]),
    ("Conclusion", ["conclusion"]),
    ("Discussion", ["discussion", "model", "implication", "implications", "perspective", "perspectives", "outlook", "dynamics", "structure", "location", "composition", "function"]),
    ("Introduction", ["overview", "background", "introduction", "context"]),
)

# Patterns of body texts that hint at a section, in the order they are tried, with confidences.
BODY_CUES = (
    ("Methods", 0.79, Phrases(r"\b(we used|we performed|we measured|we calculated|we applied|we analyzed|samples were|protein databases|principal component analysis|according to|experimental procedures|simulation were|simulation used|simulations were|simulations used)\b")),
    ("Results", 0.79, Phrases(r"\b(we found|we show|we observed|we identify|we identified|we sought|our results|these results|this study reveals|this study shows|this study demonstrates|as proof of principle|we next)\b")),
    ("Discussion", 0.77, Phrases(r"\b(reviewed in|it is now clear|suggests that|we anticipate|in summary|this review|together, these studies)\b")),
)

# Other patterns.
PAGE_MARKER = re.compile(r"\d+\s+of\s+\d+", re.I)
RUNNING_HEADER = re.compile(r"\b(science advances|j\.?\s*biol\.?\s*chem|asbmb|cold spring harb|focus)\b", re.I)
METADATA_BODY = Phrases(r"\b(doi|corresponding author|e-mail address|available online|copyright|all rights reserved)\b")
PLAIN_NAME = re.compile(r"(?:[A-Z][a-z]+(?:\s+[A-Z]\.)?\s+[A-Z][a-z]+(?:\d+|\*)?)")
WIDE_NAME = re.compile(r"[A-Z][A-Za-z'`-]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][A-Za-z'`-]+)+(?:\d+|\*)?")
NUMBERED_LABEL = re.compile(r"^\s*(?:\d+(?:\.\d+)*)[.)]?\s+(abstract|introduction|results?|discussion|methods?|materials and methods|conclusions?)\s*$", re.I)
NUMBERED_MARKER = re.compile(r"^\s*(?:\d+(?:\.\d+)*)[.)]?\s+(abstract|introduction|background|results?|discussion|methods?|materials and methods|conclusions?)\s*$", re.I)
SPACED_CAPITALS = re.compile(r"^(?:[A-Z]\s+){3,}[A-Z]$")
PREAMBLE_START = re.compile(r"(?:key\s*words?|keywords|correspondence|corresponding author)\s*:", re.I)
ADDRESS = re.compile(r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b")
PREAMBLE = Phrases(r"\b(contents lists available|journal homepage|sciencedirect|elsevier|check for updates|available online)\b")
CAPTION_START = re.compile(r"^(?:\([A-Z]\)|fig(?:ure)?\.?\s*[A-Za-z]?\d+|table\s*[A-Za-z]?\d+)", re.I)
CAPTION_CUE = Phrases(r"\b(shown from top to bottom|left to right|scale bar|image z-stacks|cells were treated)\b")
