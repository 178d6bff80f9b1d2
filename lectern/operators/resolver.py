"""Sections of doubtful blocks decided by an injected chat model; without one nothing changes."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from hashlib import blake2b

from pyarrow import fs

from lectern.operators import vocabulary as V
from lectern.operators.annotate import Block, is_author_line
from lectern.operators.models import Chat

DECISIONS = ("keep_current", "override", "abstain")
MOST_CANDIDATES, APPLY_FROM, VERSION = 24, 0.8, "resolver-v1"
SCHEMA = {
    "type": "object",
    "required": ["items"],
    "properties": {"items": {"type": "array", "items": {"type": "object", "required": ["block_index", "decision", "section_type", "confidence", "rationale"], "properties": {"block_index": {"type": "integer"}, "decision": {"enum": list(DECISIONS)}, "section_type": {"enum": list(V.SECTIONS)}, "confidence": {"type": "number"}, "clear_subsection": {"type": "boolean"}, "rationale": {"type": "string"}}}}},
}
SETTLED_ROLES = frozenset(["title", "ack_meta", "supplementary_meta", "front_matter", "reference_entry", "figure_caption", "table_caption"])


def candidates(blocks: list[Block], most: int = MOST_CANDIDATES) -> list[dict]:
    """The first blocks, in order, that are headings or body text in section Other and no titles, captions or running headers."""
    counts = Counter(b.key for b in blocks if b.key)
    lead = {b.key for b in blocks[:5]}
    out: list[dict] = []
    for i, b in enumerate(blocks):
        if len(out) == most:
            break
        running = bool(b.key) and bool(V.PAGE_MARKER.fullmatch(b.key) or b.ratio >= 0.2 and is_author_line(b.text, V.WIDE_NAME) or i >= 3 and len(b.key) <= 80 and b.key in lead or i > 3 and len(b.key) <= 60 and counts[b.key] >= 2)
        if b.section != "Other" or b.rationale == "title" or b.role in SETTLED_ROLES or running or not (b.heading or b.role == "body_paragraph"):
            continue
        headings = [(x.index, x.text) for x in blocks if x.heading]
        stop = next((j for j, _ in headings if j > i), len(blocks))
        excerpt = [x.text[:220] for x in blocks[i + 1 : stop] if x.role == "body_paragraph"][:2]
        out.append({"block_index": i, "role": b.role, "current_section": b.section, "current_subsection": b.subsection, "current_confidence": b.confidence, "text": b.text, "previous_heading": next((t for j, t in reversed(headings) if j < i), ""), "next_heading": next((t for j, t in headings if j > i), ""), "local_body_excerpt": "\n".join(excerpt)})
    return out


def prompt_of(asked: list[dict]) -> str:
    lines = ["Decide the section of each block of a scientific paper below: keep_current, override or abstain.", "Sections: " + ", ".join(V.SECTIONS), "Abstain when the evidence is weak; override only on strong local evidence.", ""]
    for c in asked:
        lines += [f"{k}: {c[k] or '(none)'}" if k != "current_confidence" else f"{k}: {c[k]:.2f}" for k in c] + [""]
    return "\n".join(lines)


def cache_key(asked: list[dict], version: str = VERSION, apply_from: float = APPLY_FROM) -> str:
    held = {"version": version, "apply_from": apply_from, "candidates": [c | {"current_confidence": round(c["current_confidence"], 4)} for c in asked]}
    return blake2b(json.dumps(held, ensure_ascii=False, sort_keys=True).encode(), digest_size=16).hexdigest()


def valid(item: object) -> bool:
    if not isinstance(item, dict):
        return False
    c = item.get("confidence")
    return isinstance(item.get("block_index"), int) and not isinstance(item.get("block_index"), bool) and item.get("decision") in DECISIONS and item.get("section_type") in V.SECTIONS and isinstance(c, int | float) and not isinstance(c, bool) and 0 <= c <= 1 and isinstance(item.get("rationale"), str)


def apply(blocks: list[Block], items: list[dict], apply_from: float = APPLY_FROM) -> None:
    """Puts valid decisions of enough confidence into effect; of several on a block the last counts."""
    for i, item in {x["block_index"]: x for x in items if valid(x)}.items():
        if not 0 <= i < len(blocks) or item["decision"] == "abstain" or item["confidence"] < apply_from:
            continue
        b = blocks[i]
        if item["decision"] == "keep_current":
            b.confidence, b.rationale = max(b.confidence, item["confidence"]), f"kept by model: {item['rationale']}"
        else:
            b.section, b.confidence, b.rationale = item["section_type"], item["confidence"], f"set by model: {item['rationale']}"
            b.subsection = "" if item.get("clear_subsection") else b.subsection


class FolderCache:
    """Decisions kept as files of a folder that all workers reach, one a key; they outlive workers and runs."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _at(self, key: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(f"{self.folder}/{key}.json")

    def get(self, key: str) -> list[dict] | None:
        store, path = self._at(key)
        try:
            with store.open_input_stream(path) as f:
                return json.loads(f.read())
        except (FileNotFoundError, ValueError):
            return None

    def __setitem__(self, key: str, items: list[dict]) -> None:
        store, path = self._at(key)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(json.dumps(items).encode())
        store.move(own, path)


def resolver(chat: Chat | None, cache: FolderCache | dict[str, list[dict]] | None = None) -> Callable[[list[Block]], None] | None:
    """What ``annotate`` takes as ``resolve``; any failure leaves the blocks as they are."""
    if chat is None:
        return None

    def resolve(blocks: list[Block]) -> None:
        asked = candidates(blocks)
        if not asked:
            return
        key = cache_key(asked)
        items = None if cache is None else cache.get(key)
        if items is None:
            try:
                got = chat.complete(prompt_of(asked), SCHEMA)
                got = json.loads(got) if isinstance(got, str) else got
                items = [x for x in got["items"] if valid(x)] if isinstance(got, dict) and isinstance(got.get("items"), list) else []
            except Exception:  # a model that fails decides nothing
                items = []
            if items and cache is not None:
                cache[key] = items
        apply(blocks, items)

    return resolve
