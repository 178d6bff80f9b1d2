"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting: tasks count the word pairs of some millions of tokens at a time and
send one packed blob for each cell of a grid, in which a pair's row comes from
its first word's hash and its column from its second's.  So a frequent word's
pairs are spread over a row of cells, and what is known of a word is gathered
from one row and one column.  A cell's task adds the counts up and stores them
as sorted hash arrays; how many pairs of each count a word begins, and how many
it ends, goes on to be added up by word and is stored likewise.

Scoring: workers map the arrays and look up the distinct pairs of a batch of
texts in order.  p(w|u) = (c(u,w) - D(c))/c(u) + g(u) p(w), and p(w) in the same
way from the number of different words before w, with the uniform distribution
over all known words and one unknown below it; the discounts D of counts 1, 2
and 3 or more come from the numbers of counts 1 to 4.

The order is two: stored trigrams are as many as the words of the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import arrays
from lectern.llm.shared import Scratch, prepare_workers, tidy
from lectern.llm.words import mix, text_chunks, word_hashes

#: Marks before the first word and after the last, beside the words' hashes.
BEGIN, END = np.uint64(1), np.uint64(2)
#: Bytes of text whose pairs one cell of the grid holds about, and tokens counted in a task at once.
CELL_BYTES, TASK_TOKENS = 24_000_000, 3_000_000
_WIDE = np.uint64(0xD6E8FEB86659FD93)
WORD_COLUMNS = ("c", "before", "n1", "n2", "n3")
#: Counts of pairs are kept in two bytes; those from here on also in a file of their own.
BIG = 65535


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * _WIDE + w)


def line(h: np.ndarray, side: int) -> np.ndarray:
    """The row or column of words in a grid of ``side`` lines."""
    return ((h >> np.uint64(32)) % np.uint64(side)).astype(np.int64)


def tokens_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word) of each token, an end after each text's words; and the texts' bounds in these."""
    n = np.diff(bounds)
    at = bounds + np.arange(len(bounds))
    w = np.empty(len(words) + len(n), np.uint64)
    ends = at[1:] - 1
    inside = np.ones(len(w), bool)
    inside[ends] = False
    w[inside], w[ends] = words, END
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[at[:-1]] = BEGIN
    return u, w, at


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes each, or in eight where one needs them."""
    return counts.astype(np.uint32 if not len(counts) or int(counts.max()) < 1 << 32 else np.uint64)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length: hashes (uint64) as they are, counts (int64) compressed."""
    out = []
    for c in columns:
        held = c if c.dtype == np.uint64 else narrow(c)
        raw = held.tobytes() if held is c else zlib.compress(held.tobytes(), 1)
        out += [np.array([len(raw), held.itemsize], np.int64).tobytes(), raw]
    return b"".join(out)


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of ``_pack``; kinds has h for hashes and n for counts."""
    at, out = 0, []
    for kind in kinds:
        size, width = (int(x) for x in np.frombuffer(blob, np.int64, 2, at))
        raw = blob[at + 16 : at + 16 + size]
        out.append(np.frombuffer(raw, np.uint64) if kind == "h" else np.frombuffer(zlib.decompress(raw), f"<u{width}").astype(np.int64))
        at += 16 + size
    return out


def _pack_pairs(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs sorted by u: each u once with the number of its pairs."""
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    runs = np.diff(np.append(first, len(u)))
    left, right = _pack([u[first], runs]), _pack([w, n])
    return np.array([len(left)], np.int64).tobytes() + left + right


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = 8 + int(np.frombuffer(blob, np.int64, 1)[0])
    u, runs = _unpack(blob[8:cut], "hn")
    w, n = _unpack(blob[cut:], "hn")
    return np.repeat(u, runs), w, n


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys with the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], [np.add.reduceat(c[order], first) if len(keys) else c for c in columns]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many have count 1 to 4; plain ones where some count is missing."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def word_file(h: np.ndarray, side: int) -> np.ndarray:
    """The file of words: their line, cut into as many parts as keep files alike in size at every corpus size.

    A cell sends a blob to each part of its two lines.  Their volume is in
    proportion to the corpus; at 100 TB, with 1,020 parts, a blob still holds
    about 1,000 words (10 KB).
    """
    return line(h, side) * parts_of(side) + ((h >> np.uint64(8)) % np.uint64(parts_of(side))).astype(np.int64)


def parts_of(side: int) -> int:
    return max(1, side // 2)


@dataclass
class Model:
    root: str
    side: int
    tokens: int
    words: int  # distinct
    pairs: int  # distinct
    texts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_backoff: float

    def word_table(self, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """The stored columns of each of the sorted distinct word hashes ``wanted``, zero for unknown ones."""
        out = {name: np.zeros(len(wanted), np.int64) for name in WORD_COLUMNS}
        of = word_file(wanted, self.side)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = order[a:b]
            i = of[at[0]]
            held = arrays.read(self.root, f"w-{i}")
            place, found = arrays.find(held.get("keys"), wanted[at])
            for name in WORD_COLUMNS if found.any() else ():
                out[name][at[found]] = held[name][place[found]]
        return out

    def pair_counts(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of pairs of known words."""
        keys, first, which = np.unique(pair_hash(u, w), return_index=True, return_inverse=True)
        cell = line(u[first], self.side) * self.side + line(w[first], self.side)
        counts = np.zeros(len(keys), np.int64)
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.diff(cell[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = order[a:b]
            name = f"p-{cell[at[0]] // self.side}-{cell[at[0]] % self.side}"
            held = arrays.read(self.root, name)
            place, found = arrays.find(held.get("keys"), keys[at])
            n = np.zeros(len(at), np.int64)
            if found.any():
                n[found] = held["n"][place[found]]
            if (n == BIG).any():
                big = arrays.read(self.root, f"{name}-big")
                at_big = np.flatnonzero(n == BIG)
                n[at_big] = big["n"][arrays.find(big["keys"], keys[at[at_big]])[0]]
            counts[at] = n
        return counts[which]

    def log10(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 p(w|u), count of w, log10 of the base) of each token."""
        known, which = np.unique(np.concatenate([u, w]), return_inverse=True)
        table = self.word_table(known)
        of_u, of_w = which[: len(u)], which[len(u) :]
        c_w, before = table["c"][of_w], table["before"][of_w]
        c_u = np.where(u == BEGIN, self.texts, table["c"][of_u])
        take = lambda d, n: np.select([n == 1, n == 2, n >= 3], d, 0.0)
        p = self.word_backoff / (self.words + 1) + (before - take(self.word_discounts, before)) / max(self.pairs, 1)
        seen = (c_u > 0) & (c_w > 0)
        n = np.zeros(len(u), np.int64)
        if seen.any():
            n[seen] = self.pair_counts(u[seen], w[seen])
        held = np.maximum(c_u, 1)
        back = sum(d * table[name][of_u] for d, name in zip(self.pair_discounts, ("n1", "n2", "n3"), strict=True)) / held
        p = np.where(c_u > 0, (n - take(self.pair_discounts, n)) / held + back * p, p)
        return np.log10(p), c_w, np.log10((c_w + 1) / (self.tokens + self.words + 1))


def train(spark: SparkSession, texts: DataFrame, scratch: Scratch, text_col: str = "text", cell_bytes: int = CELL_BYTES) -> Model:
    """Counts all rows of ``texts``; null texts are empty."""
    prepare_workers(spark)
    texts = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(size / cell_bytes)))
    root = scratch.path("model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(us, ws):
            u, w = np.concatenate(us), np.concatenate(ws)
            _, first, n = np.unique(pair_hash(u, w), return_index=True, return_counts=True)
            u, w = u[first], w[first]
            cell = line(u, side) * side + line(w, side)
            order = np.lexsort((u, cell))
            u, w, n, cell = u[order], w[order], n[order], cell[order]
            edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = slice(a, b)
                yield pa.RecordBatch.from_arrays([pa.array([cell[a] // side], pa.int32()), pa.array([cell[a] % side], pa.int32()), pa.array([_pack_pairs(u[part], w[part], n[part])], pa.binary())], names=["i", "j", "blob"])

        us, ws, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                u, w, _ = tokens_of(*word_hashes(data, offsets)[:2])
                us.append(u)
                ws.append(w)
                held += len(u)
                if held >= TASK_TOKENS:
                    yield from flush(us, ws)
                    us, ws, held = [], [], 0
        if held:
            yield from flush(us, ws)

    def add_pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, w, n = (np.concatenate(x) for x in zip(*map(_unpack_pairs, pdf["blob"]), strict=True))
        keys = pair_hash(u, w)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(n[order], first)
        keys, u, w = keys[first], u[order][first], w[order][first]
        name = f"p-{key[0]}-{key[1]}"
        if (n >= BIG).any():
            arrays.write(root, f"{name}-big", {"keys": keys[n >= BIG], "n": narrow(n[n >= BIG])})
        arrays.write(root, name, {"keys": keys, "n": np.minimum(n, BIG).astype(np.uint16)})
        begins, of = _sums(u, [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64)])
        ends, by = _sums(w, [np.ones(len(n), np.int64), n])
        rows = []
        for kind, words, columns in ((0, begins, of), (1, ends, by)):
            own = word_file(words, side)
            for f in np.unique(own):
                rows.append((kind, int(f), _pack([words[own == f], *(c[own == f] for c in columns)])))
        zeros = [0] * (len(rows) - 1)
        return pd.DataFrame({"kind": [r[0] for r in rows], "file": [r[1] for r in rows], "blob": [r[2] for r in rows], **{f"n{k}": [int((n == k).sum()), *zeros] for k in (1, 2, 3, 4)}, "pairs": [len(n), *zeros]})

    def add_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        begins = [_unpack(b, "hnnn") for b in pdf["blob"][pdf["kind"] == 0]]
        ends = [_unpack(b, "hnn") for b in pdf["blob"][pdf["kind"] == 1]]
        keys = np.concatenate([np.empty(0, np.uint64), *(b[0] for b in begins), *(e[0] for e in ends)])
        zeros = lambda parts: np.zeros(sum(len(p[0]) for p in parts), np.int64)
        cat = lambda parts, k: np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)])
        columns = [np.concatenate([cat(begins, k), zeros(ends)]) for k in (1, 2, 3)] + [np.concatenate([zeros(begins), cat(ends, k)]) for k in (1, 2)]
        keys, (n1, n2, n3, before, c) = _sums(keys, columns)
        arrays.write(root, f"w-{key[0]}", {"keys": keys, **{name: narrow(x) for name, x in zip(WORD_COLUMNS, (c, before, n1, n2, n3), strict=True)}})
        return pd.DataFrame({"words": [int((c > 0).sum())], "tokens": [int(c.sum())], "texts": [int(c[keys == END].sum())], **{f"n{k}": [int((before == k).sum())] for k in (1, 2, 3, 4)}})

    cells = texts.mapInArrow(tidy(count), "i int, j int, blob binary")
    known = scratch.keep(cells.groupBy("i", "j").applyInPandas(add_pairs, "kind int, file int, blob binary, n1 long, n2 long, n3 long, n4 long, pairs long"), "lines")
    pairs = known.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4", "pairs"))).first()
    total = known.groupBy("file").applyInPandas(add_words, "words long, tokens long, texts long, n1 long, n2 long, n3 long, n4 long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "texts", "n1", "n2", "n3", "n4"))).first()
    scratch.drop("lines")
    words, tokens, n_texts, *of = total
    by = discounts(of)
    back = (by[0] * of[0] + by[1] * of[1] + by[2] * (words - of[0] - of[1])) / pairs[4] if pairs[4] else 1.0
    return Model(root, side, tokens, words, pairs[4], n_texts, discounts(list(pairs[:4])), by, back)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its whole text's scores.

    Returns ``row`` (a struct of all columns, so no name can clash), ``n_tokens``
    (words and one end), ``n_known`` (tokens that the training texts have),
    ``base_score`` (log10 by add-one unigrams), ``score`` (log10 by the model)
    and ``perplexity`` (10 ** (-score / n_tokens)).  Words are runs of anything
    but ASCII white space, A-Z lower-cased.  Null, empty and wordless texts are
    one end.  Repeated rows each have their result; an empty table gives an
    empty result; a model of no texts gives every token the probability one.
    """
    prepare_workers(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    real = ("base_score", "score", "perplexity")
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in real)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: np.zeros(len(batch), np.float64 if c in real else np.int64) for c in ("n_tokens", "n_known", *real)}
            for row, end, data, offsets in text_chunks(batch.column(0).field(text_col)):
                u, w, at = tokens_of(*word_hashes(data, offsets)[:2])
                p, c, base = model.log10(u, w)
                part = slice(row, end)
                out["n_tokens"][part] = np.diff(at)
                for name, x in (("n_known", (c > 0).astype(np.int64)), ("score", p), ("base_score", base)):
                    out[name][part] = np.add.reduceat(x, at[:-1])
                out["perplexity"][part] = 10 ** np.minimum(-out["score"][part] / out["n_tokens"][part], 300)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], names=["row", *out])

    return rows.mapInArrow(tidy(each), schema)
