"""Character references of HTML, decoded whatever they hold."""

from __future__ import annotations

import html
import re

#: Decimal references of more digits than any character has.
_LONG = re.compile(r"&#([0-9]{8,}+)(;?)")


def _short(m: re.Match) -> str:
    digits = m[1].lstrip("0")
    return "�" if len(digits) > 7 else f"&#{digits or 0}{m[2]}"


def unescape(text: str) -> str:
    """``html.unescape`` that takes numbers of any length: what is beyond all characters is U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_LONG.sub(_short, text) if "&#" in text else text)
