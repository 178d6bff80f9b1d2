"""Model interfaces and deterministic stand-ins that need no network."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lectern.session import bound_batches


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Chat(Protocol):
    def complete(self, prompt: str, json_schema: dict) -> object: ...


_WORD = re.compile(r"\w+")


class HashingEmbedder:
    """Signed hashed words, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for w in _WORD.findall((text or "").lower()):
            h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest())
            v[h % self.dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(v)
        return (v / size if size else v).astype(np.float32).tolist()


class OverlapReranker:
    """The share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        asked = set(_WORD.findall(query.lower()))
        return [len(asked & set(_WORD.findall((t or "").lower()))) / max(len(asked), 1) for t in texts]


def in_batches(call: Callable[[list], list], items: list, size: int) -> list:
    """Results of calls on at most ``size`` items, in order; each call gives one result per item."""
    out: list = []
    for i in range(0, len(items), size):
        part = items[i : i + size]
        got = call(part)
        if len(got) != len(part):
            raise ValueError(f"a model gave {len(got)} results for {len(part)} items")
        out += got
    return out


def by_index(results: list[dict], n: int, field: str) -> list:
    """The field of results in order of their ``index``, which must be 0 to n-1, each once."""
    held = {r.get("index"): r.get(field) for r in results}
    if len(results) != n or set(held) != set(range(n)):
        raise ValueError("results must have each index once")
    return [held[i] for i in range(n)]


def with_retries(call: Callable[[], object], transient: tuple[type[BaseException], ...], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> object:
    """Tries again after 0.5, 1, 2... seconds on errors that may pass."""
    for attempt in range(retries + 1):
        try:
            return call()
        except transient:
            if attempt == retries:
                raise
            wait(0.5 * 2**attempt)


def complete_json(chat: Chat, prompt: str, schema: dict, retries: int = 3) -> dict:
    """A JSON object from a chat model: asked with the schema, then with ever plainer demands."""
    said = prompt
    for _ in range(retries + 1):
        got = chat.complete(said, schema)
        try:
            got = json.loads(got) if isinstance(got, str) else got
        except ValueError:
            got = None
        if isinstance(got, dict):
            return got
        said = f"{prompt}\n\nAnswer with one JSON object and nothing else. Its schema:\n{json.dumps(schema, sort_keys=True)}"
    raise ValueError("the model gave no JSON object")


def embed_column(text: Column, embedder: Embedder, batch: int = 64, isolate: bool = False) -> Column:
    """Vectors of a text column; the embedder is set up once per worker and batch stream.

    With ``isolate`` a batch that fails is asked text by text, and a text that
    fails has a null vector.
    """

    def alone(text: str) -> list[float] | None:
        try:
            return in_batches(embedder.embed, [text], 1)[0]
        except Exception:  # this text fails, others don't
            return None

    def vectors(texts: list[str]) -> list:
        if not isolate:
            return in_batches(embedder.embed, texts, batch)
        try:
            return in_batches(embedder.embed, texts, batch)
        except Exception:
            return [alone(t) for t in texts]

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(vectors([t or "" for t in texts]), dtype=object)

    bound_batches(SparkSession.active())
    return F.pandas_udf(each, "array<float>")(text)
