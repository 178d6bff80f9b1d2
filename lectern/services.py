"""Services over HTTP: model clients and bibliographic connectors, with the transport injected.

A transport is a call (method, url, headers, body, seconds) that gives (status,
body) or raises OSError.  The one that is used by default is urllib's; tests and
offline runs put their own in its place.  Clients are small and picklable, so a
worker makes its own connections.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.errors import ServiceUnavailable
from lectern.operators.metadata import abstract_of_index, doi_url_key, parse_pubmed_abstract, parse_tei, parse_work, plain_abstract, same_work
from lectern.operators.models import by_index, complete_json, in_batches, with_retries

Transport = Callable[[str, str, dict[str, str], bytes | None, float], tuple[int, bytes]]

MODEL_SECONDS, RECORD_SECONDS, HEADER_SECONDS = 120.0, 10.0, 60.0


class Transient(OSError):
    """A failure that may pass: no connection, or an error of the server's own."""


def urllib_transport(method: str, url: str, headers: dict[str, str], body: bytes | None, seconds: float) -> tuple[int, bytes]:
    try:
        with urlopen(Request(url, body, headers, method=method), timeout=seconds) as answer:
            return answer.status, answer.read()
    except HTTPError as e:
        return e.code, e.read()


def send(transport: Transport, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None, seconds: float = MODEL_SECONDS, retries: int = 3, wait: Callable[[float], None] | None = None) -> tuple[int, bytes]:
    """One request; lost connections and 5xx are tried again after 0.5, 1, 2 seconds, 4xx come back at once."""

    def once() -> tuple[int, bytes]:
        status, data = transport(method, url, headers or {}, body, seconds)
        if status >= 500:
            raise Transient(f"HTTP {status}")
        return status, data

    try:
        return with_retries(once, (OSError,), retries, **({"wait": wait} if wait else {}))
    except OSError as e:
        raise ServiceUnavailable(f"{url}: {e}") from e


@dataclass
class Client:
    """What clients of one kind of API share: address, key, model and transport."""

    base_url: str
    model: str
    api_key: str = ""
    transport: Transport = urllib_transport
    retries: int = 3
    wait: Callable[[float], None] | None = None

    def __post_init__(self):
        if not self.base_url:
            raise ValueError("a model service needs a base_url")

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})

    def post(self, path: str, body: dict) -> dict:
        status, data = send(self.transport, "POST", self.base_url.rstrip("/") + path, self.headers(), json.dumps(body).encode(), retries=self.retries, wait=self.wait)
        if status >= 400:
            raise ServiceUnavailable(f"{path}: HTTP {status}")
        try:
            got = json.loads(data)
        except ValueError as e:
            raise ServiceUnavailable(f"{path}: the answer is no JSON") from e
        if not isinstance(got, dict):
            raise ServiceUnavailable(f"{path}: the answer is no object")
        return got

    def healthy(self) -> bool:
        try:
            return send(self.transport, "GET", self.base_url.rstrip("/") + "/models", self.headers(), seconds=RECORD_SECONDS, retries=0)[0] < 400
        except ServiceUnavailable:
            return False


@dataclass
class HttpEmbedder(Client):
    dim: int = 0
    batch: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        def some(part: list[str]) -> list[list[float]]:
            try:
                return [list(map(float, v)) for v in by_index(self.post("/embeddings", {"model": self.model, "input": part}).get("data") or [], len(part), "embedding")]
            except (ValueError, TypeError, AttributeError) as e:
                raise ServiceUnavailable(f"embeddings: {e}") from e

        return in_batches(some, texts, self.batch)


@dataclass
class HttpReranker(Client):
    batch: int = 128

    def score(self, query: str, texts: list[str]) -> list[float]:
        def some(part: list[str]) -> list[float]:
            try:
                return [float(s) for s in by_index(self.post("/rerank", {"model": self.model, "query": query, "documents": part, "top_n": 0}).get("results") or [], len(part), "relevance_score")]
            except (ValueError, TypeError, AttributeError) as e:
                raise ServiceUnavailable(f"rerank: {e}") from e

        return in_batches(some, texts, self.batch)


@dataclass
class HttpChat(Client):
    def complete(self, prompt: str, json_schema: dict) -> object:
        asked = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": json_schema}}}
        try:
            return self.post("/chat/completions", asked)["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ServiceUnavailable("chat: the answer has no message") from e

    def complete_json(self, prompt: str, json_schema: dict) -> dict:
        return complete_json(self, prompt, json_schema, self.retries)


_made: dict[str, object] = {}


def shared(name: str, make: Callable[[], object]) -> object:
    """One client of a name in a process, made when first asked for."""
    if name not in _made:
        _made[name] = make()
    return _made[name]


def reset() -> None:
    """Forgets all shared clients."""
    _made.clear()


# --- bibliographic connectors: any failure is a miss


def _get(transport: Transport, url: str, seconds: float = RECORD_SECONDS) -> bytes | None:
    try:
        status, data = transport("GET", url, {"User-Agent": "lectern"}, None, seconds)
    except OSError:
        return None
    return data if status == 200 else None


def _json(data: bytes | None) -> dict:
    try:
        got = json.loads(data) if data else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def work_of_doi(doi: str | None, transport: Transport = urllib_transport) -> dict | None:
    """The fields of a DOI's work, or None."""
    message = _json(_get(transport, f"https://api.crossref.org/works/{quote(doi or '', safe='')}")).get("message") if doi else None
    return parse_work(message) if isinstance(message, dict) else None


def header_of_pdf(content: bytes, service: str, transport: Transport = urllib_transport) -> dict | None:
    """The fields of a PDF's header as a TEI service gives them, or None."""
    tei = tei_of_pdf(content, service, transport)
    return None if tei is None else parse_tei(tei)


def tei_of_pdf(content: bytes, service: str, transport: Transport = urllib_transport) -> str | None:
    """A PDF's header in TEI, or None."""
    mark = uuid.uuid4().hex
    body = f'--{mark}\r\nContent-Disposition: form-data; name="input"; filename="a.pdf"\r\nContent-Type: application/pdf\r\n\r\n'.encode() + content + f"\r\n--{mark}--\r\n".encode()
    try:
        status, data = transport("POST", f"{service.rstrip('/')}/api/processHeaderDocument", {"Content-Type": f"multipart/form-data; boundary={mark}", "Accept": "application/xml"}, body, HEADER_SECONDS)
    except OSError:
        return None
    return data.decode("utf-8", "replace") if status == 200 else None


def headers_table(contents: DataFrame, service: str, transport: Transport = urllib_transport) -> DataFrame:
    """(content_hash, tei) of files (content_hash, content), as ``metadata.cascade`` takes it; misses are left out."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [tei_of_pdf(bytes(c), service, transport) for c in f["content"]]
            yield pd.DataFrame({"content_hash": f["content_hash"], "tei": pd.Series(got, dtype=object, index=f.index)}).dropna()

    return contents.select("content_hash", "content").mapInPandas(each, "content_hash string, tei string")


def _fitting(answers: list[tuple[object, object, object]], title: str | None, year: int | None) -> str | None:
    """The abstract of the first answer (title, year, abstract) that is the same work."""
    for other, other_year, abstract in answers:
        whole = int(str(other_year)[:4]) if str(other_year or "")[:4].isdecimal() else None
        if (text := plain_abstract(abstract)) and same_work(title, year, plain_abstract(other), whole):
            return text
    return None


def _from_europe_pmc(doi: str, title: str, year: int | None, transport: Transport) -> str | None:
    query = f'DOI:"{doi}"' if doi else f'TITLE:"{title}"'
    found = _json(_get(transport, "https://www.ebi.ac.uk/europepmc/webservices/rest/search?" + urlencode({"query": query, "format": "json", "pageSize": 5, "resultType": "core"})))
    listed = found.get("resultList")
    answers = listed.get("result") if isinstance(listed, dict) else None
    return _fitting([(a.get("title"), a.get("pubYear"), a.get("abstractText")) for a in answers or () if isinstance(a, dict)] if isinstance(answers, list) else [], title, year)


def _from_pubmed(doi: str, title: str, year: int | None, transport: Transport) -> str | None:
    top = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
    found = _json(_get(transport, f"{top}esearch.fcgi?" + urlencode({"db": "pubmed", "term": f"{doi}[doi]", "retmode": "json"}))) if doi else {}
    listed = found.get("esearchresult")
    ids = listed.get("idlist") if isinstance(listed, dict) else None
    if not isinstance(ids, list) or not ids:
        return None
    xml = _get(transport, f"{top}efetch.fcgi?" + urlencode({"db": "pubmed", "id": ids[0], "retmode": "xml"}))
    return parse_pubmed_abstract(xml.decode("utf-8", "replace")) or None if xml else None


def _from_openalex(doi: str, title: str, year: int | None, transport: Transport) -> str | None:
    if doi:
        found = _json(_get(transport, f"https://api.openalex.org/works/https://doi.org/{doi_url_key(doi)}"))
        answers = [found] if found else []
    else:
        answers = _json(_get(transport, "https://api.openalex.org/works?" + urlencode({"search": title, "per-page": 5}))).get("results")
    return _fitting([(a.get("title"), a.get("publication_year"), abstract_of_index(a.get("abstract_inverted_index"))) for a in answers if isinstance(a, dict)] if isinstance(answers, list) else [], title, year)


ABSTRACT_SOURCES = (_from_europe_pmc, _from_pubmed, _from_openalex)


def find_abstract(doi: str | None, title: str | None, year: int | None, transport: Transport = urllib_transport) -> str | None:
    """The first abstract that a service has of a work; a failing service is passed over."""
    if not doi and not title:
        return None
    return next((text for ask in ABSTRACT_SOURCES if (text := ask(doi or "", title or "", year, transport))), None)


def abstracts_table(found: DataFrame, transport: Transport = urllib_transport) -> DataFrame:
    """(doi, abstract) of resolved rows without an abstract, asked by Arrow batches; see ``metadata.enrich_abstracts``."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [find_abstract(d, t, None if pd.isna(y) else int(y), transport) for d, t, y in zip(f["doi"], f["title"], f["year"], strict=True)]
            yield pd.DataFrame({"doi": f["doi"], "abstract": pd.Series(got, dtype=object)}).dropna()

    return found.where(F.col("abstract").isNull() & F.col("doi").isNotNull() & (F.col("source") != "unresolved")).select("doi", "title", "year").mapInPandas(each, "doi string, abstract string")


def works_table(dois: DataFrame, transport: Transport = urllib_transport) -> DataFrame:
    """(doi, message) of a column of DOIs, as ``metadata.cascade`` takes it; misses are left out."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_json(_get(transport, f"https://api.crossref.org/works/{quote(d, safe='')}")).get("message") for d in f["doi"]]
            yield pd.DataFrame({"doi": f["doi"], "message": pd.Series([json.dumps(m) if isinstance(m, dict) else None for m in got], dtype=object)}).dropna()

    return dois.select("doi").where("doi IS NOT NULL").distinct().mapInPandas(each, "doi string, message string")


