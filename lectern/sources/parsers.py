"""Parsers of PDF files behind one interface: a library in the process, a command, or a service.

Each takes a file's bytes and gives its markdown (``files.Parser``); any failure
names the backend.  Libraries are optional: one that isn't installed is missing
only when it is asked for.
"""

from __future__ import annotations

import importlib
import inspect
import json
import subprocess
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

from lectern.errors import StageFailed
from lectern.operators.metadata import find_doi
from lectern.services import Transport, urllib_transport

SECONDS = 1800
#: Fields of a service's answer that may hold the markdown, in order.
FIELDS = ("md_content", "markdown", "md")


def optional(name: str) -> ModuleType | None:
    """A library, or None where it isn't installed."""
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def adapted(call: Callable, **values: object) -> object:
    """Calls with those of the values that the callable takes; all of them if it takes any."""
    known = inspect.signature(call).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in known.values()):
        return call(**values)
    return call(**{k: v for k, v in values.items() if k in known})


def _named(backend: str, parse: Callable[[bytes], str | None]) -> Callable[[bytes], str]:
    def run(content: bytes) -> str:
        try:
            text = parse(content)
            if not text or not text.strip():
                raise ValueError("no markdown came out")
        except Exception as e:
            raise StageFailed(f"parser {backend}: {e}") from e
        return text

    return run


def _best_output(folder: Path, stem: str) -> str | None:
    """The text of <stem>/auto/<stem>.md, else of the first .md by path that isn't blank."""
    paths = [folder / stem / "auto" / f"{stem}.md", *sorted(folder.rglob("*.md"))]
    return next((t for p in paths if p.is_file() and (t := p.read_text(encoding="utf-8")).strip()), None)


def library_parser(call: Callable, **values: object) -> Callable[[bytes], str]:
    """A function that writes its output to a folder; it gets what it takes of pdf_file, pdf_bytes, output_dir and ``values``."""

    def parse(content: bytes) -> str | None:
        with tempfile.TemporaryDirectory() as top:
            pdf, out = Path(top, "a.pdf"), Path(top, "out")
            pdf.write_bytes(content)
            out.mkdir()
            got = adapted(call, pdf_file=str(pdf), pdf_bytes=content, output_dir=str(out), **values)
            return got if isinstance(got, str) else _best_output(out, "a")

    return _named("library", parse)


def command_parser(command: list[str], seconds: float = SECONDS) -> Callable[[bytes], str]:
    """A command called with -p FILE -o FOLDER."""

    def parse(content: bytes) -> str | None:
        with tempfile.TemporaryDirectory() as top:
            pdf, out = Path(top, "a.pdf"), Path(top, "out")
            pdf.write_bytes(content)
            out.mkdir()
            done = subprocess.run([*command, "-p", str(pdf), "-o", str(out)], capture_output=True, text=True, timeout=seconds, check=False)
            if done.returncode:
                raise RuntimeError(f"exit {done.returncode}: {done.stderr.strip() or done.stdout.strip()}")
            return _best_output(out, "a")

    return _named("command", parse)


def service_parser(url: str, fields: dict[str, str] | None = None, transport: Transport = urllib_transport, seconds: float = SECONDS) -> Callable[[bytes], str]:
    """A service that takes a file by multipart POST and answers {results: {name: {field: markdown}}}."""

    def parse(content: bytes) -> str | None:
        mark = uuid.uuid4().hex
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in (fields or {"return_md": "true"}).items()]
        parts += [f'--{mark}\r\nContent-Disposition: form-data; name="files"; filename="a.pdf"\r\nContent-Type: application/pdf\r\n\r\n'.encode(), content, f"\r\n--{mark}--\r\n".encode()]
        status, data = transport("POST", f"{url.rstrip('/')}/file_parse", {"Content-Type": f"multipart/form-data; boundary={mark}"}, b"".join(parts), seconds)
        if status != 200:
            raise RuntimeError(f"HTTP {status}")
        results = json.loads(data).get("results") or {}
        entry = results.get("a") or (next(iter(results.values())) if len(results) == 1 else {})
        return next((entry[f] for f in FIELDS if isinstance(entry.get(f), str) and entry[f]), None)

    return _named("service", parse)


def local_doi(content: bytes, libraries: Callable[[str], ModuleType | None] = optional, pages: int = 2) -> str | None:
    """A PDF's DOI from the text of its first pages, where a library to read them is installed; else None."""
    fitz = libraries("fitz")
    if fitz is None:
        return None
    try:
        with fitz.open(stream=content, filetype="pdf") as pdf:
            text = "\n".join(pdf[i].get_text() for i in range(min(pages, len(pdf))))
    except Exception:  # a file that can't be read has no DOI
        return None
    return find_doi(text)
