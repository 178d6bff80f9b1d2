"""A model's decisions on doubtful sections, as a table.

What is to be asked of all documents are rows with a key each; a join with the
decisions that are held leaves the keys that nobody has asked yet, and only these
go to the model, each once.  The answers are written before they are used, and
published with the documents, so neither a second run nor a lost executor asks again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.annotate import annotate_text
from lectern.operators.models import Chat
from lectern.operators.resolver import SCHEMA, cache_key, candidates, prompt_of, valid


def asked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, asked): of each text with doubtful blocks what a model is to be asked, as JSON, and its key.

    A text that can't be annotated asks nothing.
    """

    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            found = candidates(annotate_text(text))
        except Exception:  # it fails by itself when it is annotated
            return None, None
        return (cache_key(found), json.dumps(found, ensure_ascii=False)) if found else (None, None)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(t) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "key": pd.Series([g[0] for g in got], dtype=object, index=f.index), "asked": pd.Series([g[1] for g in got], dtype=object, index=f.index)}).dropna(subset=["key"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(each, f"id {rows.schema['id'].dataType.simpleString()}, key string, asked string").withColumnRenamed("id", id_col)


@dataclass
class Decisions:
    """Asks a chat model; an answer that fails or has no valid item decides nothing and is not kept."""

    chat: Chat

    def answers(self, asked: DataFrame) -> DataFrame:
        """(key, items): valid items of each distinct key, as JSON."""
        chat = self.chat

        def one(said: str) -> str:
            try:
                got = chat.complete(prompt_of(json.loads(said)), SCHEMA)
                got = json.loads(got) if isinstance(got, str) else got
                return json.dumps([x for x in got["items"] if valid(x)], ensure_ascii=False)
            except Exception:  # a model that fails decides nothing
                return "[]"

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"key": f["key"], "items": [one(a) for a in f["asked"]]})

        once = asked.groupBy("key").agg(F.min("asked").alias("asked"))
        return once.mapInPandas(each, "key string, items string").where(F.col("items") != "[]")

    def decide(self, docs: DataFrame, id_col: str, text_col: str, known: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(``docs`` with ``items``, the decisions that are new).

        ``known`` gives the decisions (key, items) that are held on a frame of keys.
        """
        told = keep(asked(docs, id_col, text_col), "asked")
        held = known(told.select("key")).select("key", "items")
        new = keep(self.answers(told.join(held.select("key"), "key", "left_anti")), "answers")
        every = held.unionByName(new)
        return docs.join(told.select(id_col, "key").join(every, "key").select(id_col, "items"), id_col, "left"), new
