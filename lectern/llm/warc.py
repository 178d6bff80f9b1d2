"""WARC derivatives: metadata and plain-text conversion records from responses.

Each response record gives a metadata record, whose JSON block holds the
source's WARC headers, the HTTP status and headers and what the HTML head and
links say, and (if it is HTML or plain text) a conversion record with the plain
text.  Both name the response in WARC-Refers-To and keep its target URI, date
and payload digest; ids are name-based on the response's id, so a rerun gives
the same records.  Each record is made from one row, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.references import unescape
from lectern.llm import markup
from lectern.llm.shared import prepare_workers, tidy

#: The date of responses made from pages, which have none.
PAGE_DATE = "2024-01-01T00:00:00Z"
#: Bytes up to which a compressed payload is opened; of larger ones no text is made, and the metadata record says so.
MOST_OPENED = 256 << 20
#: WARC headers in their order; a name may come more than once.
HEADERS = "array<struct<name:string,value:string>>"
RECORD = {"type": "string", "record_id": "string", "target_uri": "string", "date": "string", "refers_to": "string", "content_type": "string", "payload_digest": "string", "block_digest": "string", "headers": HEADERS, "block": "binary"}
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")

# Elements without visible text, what may stand in a head, and elements that end a line.
UNSEEN = frozenset(["script", "style", "template", "noscript", "iframe", "head", "textarea", "select", "svg", "title", "noembed", "noframes", "xmp"])
IN_HEAD = frozenset(["base", "link", "meta", "noscript", "object", "script", "style", "template", "title"])
LINES = frozenset(["address", "article", "aside", "blockquote", "body", "br", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "td", "th", "tr", "ul"])
LINKS = {"a": ("href",), "link": ("href",), "img": ("src",), "script": ("src",), "iframe": ("src",)}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)

#: Codings of Python's that no page is in: of names, of source text, and one that always fails.
NO_CHARSETS = frozenset(["idna", "punycode", "undefined", "unicode-escape", "unicode_escape", "raw-unicode-escape", "raw_unicode_escape"])

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, json.dumps(names))}>"


def read_page(page: str) -> tuple[dict, str]:
    """What a metadata record says of an HTML page (title, named metas and links in page order), and its plain text.

    The text is all that is visible: a line for each block, white space inside as
    one space, empty lines left out.
    """
    one_line = lambda s: " ".join(unescape(s).split())
    title, metas, links = None, [], []
    parts: list[str] = []
    unseen = None  # the element whose end is waited for
    for kind, name, value in markup.tokens(page):
        if kind == markup.TEXT:
            if not unseen:
                parts.append(name)
            continue
        if kind == markup.OPEN:
            if unseen == "head" and name not in IN_HEAD:
                unseen = None  # a head without an end tag ends where something else begins
            if name in LINKS:
                found = next(((k, v) for k, v in markup.attributes(value) if k in LINKS[name]), None)
                if found:
                    links.append({"path": f"{name.upper()}@/{found[0]}", "url": unescape(found[1])})
            elif name == "meta":
                held = dict(reversed(markup.attributes(value)))
                if held.get("name") and "content" in held:
                    metas.append({"name": held["name"], "content": one_line(held["content"])})
        elif kind == markup.CONTENT:
            if name == "title" and title is None:
                title = one_line(value)
            continue
        if unseen:
            if kind == markup.CLOSE and name == unseen:
                unseen = None
                parts.append(" ")
        elif kind == markup.OPEN and name in UNSEEN:
            unseen = name
        elif name in LINES:
            parts.append("\0")  # which no page text has after the replacement below
    text = "".join(x if x == "\0" else x.replace("\0", " ") for x in parts)
    text = unescape(text) if "&" in text else text
    lines = (" ".join(x.split()) for x in text.split("\0"))
    return {"Head": {"Title": title, "Metas": metas}, "Links": links}, "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    return read_page(page)[1]


def page_facts(page: str) -> dict:
    return read_page(page)[0]


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, _, payload = block.partition(b"\n\n")
    lines = head.decode("utf-8", "replace").splitlines()
    return lines[0] if lines else "", [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def unchunked(payload: bytes) -> bytes:
    """A payload without its chunked transfer coding; as it is from the first place that isn't coded so."""
    out, at = [], 0
    while (end := payload.find(b"\n", at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            break
        n, at = int(size, 16), end + 1
        if not n:
            return b"".join(out)
        out.append(payload[at : at + n])
        at += n
        at += 2 if payload[at : at + 2] == b"\r\n" else payload[at : at + 1] == b"\n"
    return b"".join([*out, payload[at:]])


def inflated(payload: bytes, bits: int, most: int) -> tuple[bytes | None, bool]:
    """(what is packed, whether it is whole) of all gzip members of a payload; None where it is larger than ``most``.

    Bytes after the last member are passed over.  A payload that is cut off, or
    damaged in a later member, gives what comes before.
    """
    out, size, at, step = [], 0, 0, 0
    while True:
        packed, step = zlib.decompressobj(bits), 512
        try:
            while not packed.eof and at < len(payload):
                part = packed.decompress(payload[at : at + step], most + 1 - size)
                out.append(part)
                size += len(part)
                if size > most:
                    return None, False
                at += len(payload[at : at + step]) - len(packed.unused_data)
                step = min(2 * step, 1 << 20)  # short members are not read far beyond their ends
        except zlib.error:
            if len(out) == 0 or not size:
                raise
            return b"".join(out), False
        if not packed.eof or not payload.startswith(b"\x1f\x8b", at):
            return b"".join(out), packed.eof


def opened(payload: bytes, http: Headers, most: int = MOST_OPENED) -> tuple[bytes | None, bool]:
    """(payload without transfer and content codings, whether it is whole); None if it can't be opened or would be larger than ``most``."""
    listed = lambda name: [x.strip().lower() for k, v in http if k.lower() == name for x in v.split(",") if x.strip()]
    whole = True
    if "chunked" in listed("transfer-encoding"):
        payload = unchunked(payload)
    for coding in reversed(listed("content-encoding")):
        if coding == "identity":
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            return None, whole
        for bits in (47,) if coding != "deflate" else (47, -15):
            try:
                payload, ended = inflated(payload, bits, most)
                break
            except zlib.error:
                continue
        else:
            return None, whole
        if payload is None:
            return None, whole
        whole &= ended
    return payload, whole


def decoded(data: bytes, charset: str) -> str:
    """The text of a payload; of a charset that is unknown or none of a text's, as UTF-8."""
    try:
        if codecs.lookup(charset).name in NO_CHARSETS:
            charset = "utf-8"
        return data.decode(charset, "replace")
    except (LookupError, ValueError):  # among them UnicodeError
        return data.decode("utf-8", "replace")


def serialize(headers: Headers, block: bytes) -> bytes:
    """One record as WARC/1.0 has it."""
    return b"".join([b"WARC/1.0\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers), b"\r\n", block, b"\r\n\r\n"])


def _block(source: BinaryIO, size: int) -> bytes | None:
    """So many bytes, taken as they come, as a length may say more than is there; None if there are fewer."""
    parts = []
    while size and (part := source.read(min(size, 1 << 20))):
        parts.append(part)
        size -= len(part)
    return None if size else b"".join(parts)


def parse(data: bytes | BinaryIO) -> Iterator[tuple[Headers, bytes]]:
    """The (headers, block) of every record of a WARC file, gzipped or not.

    Reads on record by record.  Lines that begin no record are passed over; a
    record that is cut off, or a damaged gzip member, ends it.
    """
    source = io.BufferedReader(io.BytesIO(data)) if isinstance(data, bytes) else data
    if source.peek(2)[:2] == b"\x1f\x8b":
        source = io.BufferedReader(gzip.GzipFile(fileobj=source))
    try:
        while line := source.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers: list[list[str]] = []
            while (line := source.readline()).strip():
                text = line.decode("utf-8", "replace")
                if text[0] in " \t" and headers:  # goes on with the line before
                    headers[-1][1] += " " + text.strip()
                    continue
                name, _, value = text.partition(":")
                headers.append([name.strip(), value.strip()])
            said = next((v for k, v in headers if k.lower() == "content-length" and re.fullmatch("[0-9]+", v)), "0").lstrip("0") or "0"
            size = int(said) if len(said) <= 15 else -1
            if size < 0 or not line or (block := _block(source, size)) is None:
                return
            yield [(k, v) for k, v in headers], block
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def _header_array(rows: list[Headers]) -> pa.Array:
    flat = [x for h in rows for x in h]
    pairs = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())], ["name", "value"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pairs)


def _header_rows(column: pa.ListArray) -> Iterator[Headers]:
    """The headers of each row; none for null, and none without a name or value."""
    flat, at = column.flatten(), 0
    pairs = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True))
    for n in column.value_lengths().to_pylist():
        yield [x for x in pairs[at : at + (n or 0)] if x[0] and x[1] is not None]
        at += n or 0


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (``path``, ``headers``, ``block``); a file is one task's row, so files are under 2 GB."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for headers, block in parse(io.BufferedReader(pa.BufferReader(data.as_buffer()))):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), _header_array([headers]), pa.array([block], pa.binary())], names=["path", "headers", "block"])

    prepare_workers(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tidy(each), f"path string, headers {HEADERS}, block binary")


def response_of(url: str | None, page: str | None, key: object) -> tuple[Headers, bytes]:
    """The headers and block of a response record made from a page: HTTP 200, UTF-8; null pages are empty."""
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url)), ("WARC-Date", PAGE_DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    return [*headers, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block


def derived(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata record and, of HTML and plain text, the conversion record of a response; of other records none."""
    of = {k.lower(): v for k, v in reversed(headers)}
    if of.get("warc-type", "").lower() != "response":
        return []
    source = of.get("warc-record-id") or record_id("unnamed", digest(block))
    status, http, payload = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "").lower()
    body, whole = opened(payload, http)
    text = decoded(body or b"", m[1] if (m := _CHARSET.search(kind)) else "utf-8")
    payload_digest = of.get("warc-payload-digest") or digest(payload)
    kept = [(k, of[k.lower()]) for k in ("WARC-Target-URI", "WARC-Date") if k.lower() in of]
    parts = status.split(None, 2)
    pairs = lambda rows: [{"name": k, "value": v} for k, v in rows]
    facts = {"Status": parts[1] if len(parts) > 1 else None, "Reason": parts[2] if len(parts) > 2 else None, "Headers": pairs(http), "Entity-Length": len(payload), "Entity-Digest": digest(payload)}
    if body is None:
        facts["Entity-Not-Opened"] = True
    elif not whole:
        facts["Entity-Cut-Off"] = True
    is_html = "html" in kind
    if is_html:
        facts["HTML-Metadata"], text = read_page(text)
    envelope = {"WARC-Header-Length": sum(len(k) + len(v) + 4 for k, v in headers), "WARC-Header-Metadata": pairs(headers), "Payload-Metadata": {"HTTP-Response-Metadata": facts}}
    out = [("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False).encode("utf-8", "replace"))]
    if body is not None and (is_html or kind.startswith("text/plain")):
        out.append(("conversion", "text/plain", text.encode("utf-8", "replace")))
    return [([("WARC-Type", name), ("WARC-Record-ID", record_id(name, source)), *kept, ("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(made)), ("Content-Type", content), ("Content-Length", str(len(made)))], made) for name, content, made in out]


def build_derivatives(responses: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Derived records of every response among records (``headers``, ``block`` binary).

    Returns ``key`` (a struct of the ``key_cols``, so no name can clash; null
    without any) and, per derived record: type, record_id, target_uri, date,
    refers_to, content_type, payload_digest (the source's), block_digest, headers
    (in order, for ``serialize``) and block.  Rows that aren't responses give
    none, nor do null headers; a null block is empty.  A payload that can't be
    opened has a metadata record only; of one that is cut off, what is there is taken,
    and the metadata record says so.  A charset that is unknown or no text's counts as UTF-8.  Repeated rows each give their records; an
    empty table gives an empty result.
    """
    prepare_workers(responses.sparkSession)
    keys = F.struct(*(F.col(f"`{k}`") for k in key_cols)) if key_cols else F.lit(None).cast("int")
    rows = responses.select(keys.alias("key"), "headers", "block")
    named = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To", "Content-Type", "WARC-Source-Payload-Digest", "WARC-Block-Digest")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, made = [], []
            for i, (headers, block) in enumerate(zip(_header_rows(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                new = derived(headers, bytes(block or b""))
                which += [i] * len(new)
                made += new
            found = [dict(h) for h, _ in made]
            columns = [pa.array([h.get(name) for h in found], pa.string()) for name in named]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *columns, _header_array([h for h, _ in made]), pa.array([b for _, b in made], pa.binary())], names=["key", *RECORD])

    key_type = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(tidy(each), f"key {key_type}, " + ", ".join(f"{k} {v}" for k, v in RECORD.items()))


def responses_of_pages(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record (``headers``, ``block``) for every page, with its key; null pages are empty ones."""
    prepare_workers(pages.sparkSession)
    rows = pages.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response_of(u, h, k) for k, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _header_array([h for h, _ in made]), pa.array([b for _, b in made], pa.binary())], names=["key", "headers", "block"])

    return rows.mapInArrow(tidy(each), f"key {rows.schema['key'].dataType.simpleString()}, headers {HEADERS}, block binary").withColumnRenamed("key", key_col)
