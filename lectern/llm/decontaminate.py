"""Benchmark decontamination by winnowing.

Of every ``window - gram + 1`` consecutive k-gram hashes of a text the smallest
(the rightmost of equals) is kept.  A span of ``window`` words that a document
and a benchmark item share holds the same hashes in both, so the same one is
kept: every such span yields a fingerprint match.  A match is extended to the
windows around it of which it is the fingerprint: those that the benchmark has
are hit, and hit windows that overlap or touch grow together to spans.  Items
shorter than a window are one window of their length.

The benchmark's fingerprints and windows are stored as sorted hash arrays, a
file for a range of hashes, so neither the driver nor a task ever holds the
whole of them; workers map the files and look up each distinct hash of some
texts once.  A window is named by two hashes of 64 digits.  What repeats (a
window within an item or a text, a list of items that many windows share) counts
once, so a text of one word over and over costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import arrays
from lectern.llm.shared import Scratch, prepare_workers, tidy
from lectern.llm.words import ALNUM, hash_spans, mix, text_chunks, word_hashes

#: Benchmark words whose windows are in one file, about, and files at least, so that no task has most of them.
PIECE_WORDS, LEAST_PIECES = 1_000_000, 16
_CHECK = np.uint64(0xA0761D6478BD642F)


def grams_at(words: np.ndarray, at: np.ndarray, n: int, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Hash of the n words from each place on; texts' bounds are not looked at."""
    out = np.full(len(at), np.uint64(0x243F6A8885A308D3 + n) ^ salt, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[at + j])
    return out


def winnow(words: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each window inside a text, the place of its fingerprint, and that one's hash."""
    count = max(len(words) - window + 1, 0)
    if not count:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = grams_at(words, np.arange(len(words) - gram + 1), gram)
    best, place = hashes[:count].copy(), np.zeros(count, np.int64)
    for j in range(1, window - gram + 1):
        less = hashes[j : j + count] <= best
        best[less] = hashes[j : j + count][less]
        place[less] = j
    at = np.flatnonzero(np.arange(count) + window <= np.repeat(bounds[1:], np.diff(bounds))[:count])
    return at, at + place[at], best[at]


def windows_of(words: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, fingerprint hashes) of all windows of items; of short items there are no fingerprints."""
    at, _, kept = winnow(words, bounds, gram, window)
    yield window, at, kept
    n = np.diff(bounds)
    for size in np.unique(n[(n > 0) & (n < window)]):
        yield int(size), bounds[:-1][n == size], np.empty(0, np.uint64)


def store_benchmark(items: DataFrame, gram: int, window: int, pieces: int, root: str) -> list[int]:
    """Writes the index of items (id, text) to ``root``; the sizes of windows that there are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, offsets in text_chunks(batch.column(1)):
                words, bounds, _, _ = word_hashes(data, offsets, ALNUM)
                for size, at, kept in windows_of(words, bounds, gram, window):
                    item = np.searchsorted(bounds, at, side="right") - 1
                    seen = np.unique(np.column_stack([grams_at(words, at, size), grams_at(words, at, size, _CHECK), item.astype(np.uint64)]), axis=0)
                    kept = np.unique(kept)
                    n, hashes = len(kept), np.concatenate([kept, seen[:, 0]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.zeros(n), np.full(len(seen), size)]).astype(np.int32)), pa.array((hashes % np.uint64(pieces)).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(np.concatenate([np.zeros(n, np.uint64), seen[:, 1]]).view(np.int64)), pa.concat_arrays([pa.nulls(n, pa.string()), ids.take(pa.array(row + seen[:, 2].astype(np.int64)))])],
                        names=["size", "piece", "hash", "check", "id"],
                    )

    def store(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = pdf["hash"].to_numpy(np.int64).view(np.uint64)
        if not key[0]:
            arrays.write(root, f"kept-{key[1]}", {"keys": np.unique(hashes)})
            return pd.DataFrame({"size": [0]})
        ids, item = np.unique(pdf["id"].to_numpy(str), return_inverse=True)
        rows = np.unique(np.column_stack([hashes, pdf["check"].to_numpy(np.int64).view(np.uint64), item.astype(np.uint64)]), axis=0)
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
        ends = np.append(first[1:], len(rows))
        # lists of items that several windows share are kept once
        values, which = np.unique(hash_spans(mix(rows[:, 2] + np.uint64(1)), first, ends), return_inverse=True)
        one = np.zeros(len(values), np.int64)
        one[which] = np.arange(len(first))
        n = (ends - first)[one]
        members = rows[np.repeat(first[one] - (np.cumsum(n) - n), n) + np.arange(n.sum()), 2]
        names = [x.encode() for x in ids]
        arrays.write(root, f"windows-{key[1]}", {"keys": rows[first, 0], "check": rows[first, 1], "list": which, "list_bounds": np.cumsum(np.append(0, n)), "items": members.astype(np.int64), "id_bounds": np.cumsum([0, *map(len, names)]), "ids": np.frombuffer(b"".join(names), np.uint8)})
        return pd.DataFrame({"size": np.unique(pdf["size"])})

    rows = items.mapInArrow(tidy(each), "size int, piece int, hash long, check long, id string")
    sizes = rows.groupBy(F.least("size", F.lit(1)).alias("kind"), "piece").applyInPandas(store, "size int").distinct().collect()
    return sorted(r["size"] for r in sizes if r["size"])


class Index:
    """Look-ups in the stored arrays; small enough to go along with a task."""

    def __init__(self, root: str, pieces: int, gram: int, window: int, sizes: list[int]):
        self.root, self.pieces, self.gram, self.window, self.sizes = root, pieces, gram, window, sizes

    def _by_piece(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        of = (hashes % np.uint64(self.pieces)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(of[order[a]]), order[a:b]

    def kept(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the distinct hashes are fingerprints of the benchmark."""
        out = np.zeros(len(hashes), bool)
        for piece, at in self._by_piece(hashes):
            out[at] = arrays.find(arrays.read(self.root, f"kept-{piece}").get("keys"), hashes[at])[1]
        return out

    def windows(self, hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, list) of each distinct window, -1 for those that the benchmark hasn't."""
        pieces, lists = np.full(len(hashes), -1), np.full(len(hashes), -1)
        for piece, at in self._by_piece(hashes):
            held = arrays.read(self.root, f"windows-{piece}")
            place, found = arrays.find(held.get("keys"), hashes[at])
            # of windows with one hash, the one of the same second hash
            while len(live := np.flatnonzero(found)):
                same = held["check"][place[live]] == check[at[live]]
                pieces[at[live[same]]], lists[at[live[same]]] = piece, held["list"][place[live[same]]]
                place[live] += 1
                found[live] = ~same & (place[live] < len(held["keys"]))
                found[found] = held["keys"][place[found]] == hashes[at[found]]
        return pieces, lists

    def names(self, piece: int, lists: np.ndarray) -> set[str]:
        """The ids of the items in some lists of a piece."""
        held = arrays.read(self.root, f"windows-{piece}")
        items = np.unique(np.concatenate([held["items"][held["list_bounds"][i] : held["list_bounds"][i + 1]] for i in lists]))
        return {held["ids"][held["id_bounds"][i] : held["id_bounds"][i + 1]].tobytes().decode() for i in items}

    def find(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a run of texts: which words are hit, and rows (text, piece, list) of the items found."""
        edges, found = np.zeros(len(words) + 1, np.int64), []
        for size in self.sizes:
            if size == self.window:
                at, _, kept = winnow(words, bounds, self.gram, size)
                values, which = np.unique(kept, return_inverse=True)
                at = at[self.kept(values)[which]]
            else:
                at = np.arange(max(len(words) - size + 1, 0))
                at = at[at + size <= np.repeat(bounds[1:], np.diff(bounds))[: len(at)]]
            if not len(at):
                continue
            values, first, which = np.unique(grams_at(words, at, size), return_index=True, return_inverse=True)
            pieces, lists = self.windows(values, grams_at(words, at[first], size, _CHECK))
            hit = np.flatnonzero(lists[which] >= 0)
            at, which = at[hit], which[hit]
            edges += np.bincount(at, minlength=len(edges)) - np.bincount(at + size, minlength=len(edges))
            found.append(np.unique(np.column_stack([np.searchsorted(bounds, at, side="right") - 1, pieces[which], lists[which]]), axis=0))
        return np.cumsum(edges)[:-1] > 0, np.concatenate([np.empty((0, 3), np.int64), *found])


def runs(hit: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of hit words, which never go from one text to the next."""
    inner = bounds[(bounds > 0) & (bounds < len(hit))]
    before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1


SPANS = "array<struct<start:int,end:int>>"


def contaminated_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, gram: int = 8, piece_words: int = PIECE_WORDS) -> DataFrame:
    """Every row of ``docs`` with the places that it shares with benchmark items.

    Returns ``row`` (a struct of all columns of ``docs``, so no name can clash),
    ``n_words`` (long), ``spans`` (array of (start, end) word numbers, end
    exclusive, sorted and disjoint) and ``items`` (sorted distinct item ids as
    strings).  Words are runs of ASCII letters and digits and non-ASCII
    characters, A-Z lower-cased.  An item window is ``window`` consecutive
    words; an item of fewer, but not none, is one window.

    * Null and empty texts: no words, no spans.  Null or wordless items: ignored.
    * Items with a null id are ignored, as they cannot be named.
    * Repeated rows each have their result; repeated items count once by id.
    * Empty documents give an empty result, an empty benchmark no spans.
    """
    prepare_workers(spark)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    # a word takes two bytes with what parts it from the next, so this bounds the words
    size = items.agg(F.sum((F.octet_length("text").cast("long") + 1) / 2)).first()[0] or 0
    pieces, root = max(LEAST_PIECES, math.ceil(size / piece_words)), Scratch(spark).path("benchmark")
    index = Index(root, pieces, gram, window, store_benchmark(items, gram, window, pieces, root))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    spans_type = T._parse_datatype_string(SPANS)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", spans_type), T.StructField("items", T.ArrayType(T.StringType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_spans = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            starts, ends, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [[] for _ in range(len(batch))]
            for first, end, data, offsets in text_chunks(batch.column(0).field(text_col)):
                words, bounds, _, _ = word_hashes(data, offsets, ALNUM)
                n_words[first:end] = np.diff(bounds)
                hit, found = index.find(words, bounds)
                if not len(found):
                    continue
                a, b = runs(hit, bounds)
                text = np.searchsorted(bounds, a, side="right") - 1
                n_spans[first:end] = np.bincount(text, minlength=end - first)
                starts.append(a - bounds[text])
                ends.append(b - bounds[text])
                for i in np.unique(found[:, 0]):
                    mine = found[found[:, 0] == i]
                    items[first + int(i)] = sorted(set().union(*(index.names(int(p), mine[mine[:, 1] == p, 2]) for p in np.unique(mine[:, 1]))))
            places = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int32()) for x in (starts, ends)], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, n_spans)), pa.int32()), places)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), spans, pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return rows.mapInArrow(tidy(each), schema)


def n_hit(spans: str = "spans"):
    """The number of words in the spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_words: str = "n_words", spans: str = "spans"):
    """Whether a document counts as contaminated: a twentieth of its words or more are hit."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))
