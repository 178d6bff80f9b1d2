"""Language identification with a byte convolutional network.

Bytes of lower-cased text are embedded; filters of several widths run over
fixed-length windows, each filter's largest response over the window goes
through a rectifier into a softmax layer.  The network is trained here, in
numpy, on windows from a bounded sample of labelled rows.  A whole text is cut
into windows without gaps, and their probabilities are averaged by the bytes
that each holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import prepare_workers, tidy
from lectern.llm.words import text_chunks

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 6
#: The label of texts without letters.
UNKNOWN = "und"
#: Windows that go through the network at once.
BATCH = 256
#: Tasks that merge what all tasks keep for the sample.
MERGES = 8


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED, row 0 (padding) stays zero
    filters: np.ndarray  # (max width * EMBED) x (widths * FILTERS), zero beyond each filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Largest response of each filter over each window of bytes; also where it is."""
        n, length = windows.shape
        wide = max(WIDTHS)
        padded = np.zeros((n, length + wide - 1), np.uint8)
        padded[:, :length] = windows
        x = self.embed[padded].reshape(n, -1)
        view = np.lib.stride_tricks.as_strided(x, (n, length, wide * EMBED), (x.strides[0], x.strides[1] * EMBED, x.strides[1]))
        response = (np.ascontiguousarray(view).reshape(n * length, -1) @ self.filters).reshape(n, length, -1)
        if not places:
            return np.maximum(response.max(axis=1) + self.bias, 0)
        where = response.argmax(axis=1)
        best = np.take_along_axis(response, where[:, None, :], 1)[:, 0] + self.bias
        return best, where, padded, view

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(windows) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], steps: int = 1200, batch: int = 128, rate: float = 0.004, seed: int = 7) -> Network:
    """Fits the network with Adam in a number of steps; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.searchsorted(names, labels)
    wide, total = max(WIDTHS), len(WIDTHS) * FILTERS
    open_ = np.zeros((wide * EMBED, total), np.float32)
    for i, w in enumerate(WIDTHS):
        open_[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    real = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(names, real(256, EMBED, scale=0.5), real(wide * EMBED, total, scale=0.3) * open_, np.zeros(total, np.float32), real(total, len(names), scale=0.2), np.zeros(len(names), np.float32))
    net.embed[0] = 0
    weights = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    while step < steps:
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch))[: steps - step]:
            x = windows[at].copy()
            # a third of the windows are cut short, as short texts are
            cut = np.where(rng.random(len(at)) < 0.33, rng.integers(12, WINDOW + 1, len(at)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            best, where, padded, view = net.pooled(x, places=True)
            hidden = np.maximum(best, 0)
            error = _softmax(hidden @ net.out + net.out_bias)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back = (error @ net.out.T) * (best > 0)
            seen = view[np.arange(len(at))[:, None], where]  # n x filters x (wide * EMBED)
            d_filters = np.einsum("nf,nfk->kf", back, seen) * open_
            d_seen = (back[:, :, None] * net.filters.T[None]).reshape(-1, wide, EMBED)
            bytes_ = padded[np.arange(len(at))[:, None, None], where[:, :, None] + np.arange(wide)].reshape(-1)
            d_embed = np.zeros_like(net.embed)
            for e in range(EMBED):
                d_embed[:, e] = np.bincount(bytes_, d_seen[:, :, e].reshape(-1), 256)
            d_embed[0] = 0
            step += 1
            for i, grad in enumerate((d_embed, d_filters, back.sum(0), hidden.T @ error, error.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                weights[i] -= (rate * 0.5 ** (3 * step / steps)) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-7)
    return net


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, first window of each text) of the windows of texts that follow one another."""
    n = np.maximum(-(-np.diff(offsets) // WINDOW), 1)
    first_of = np.cumsum(n) - n
    starts = np.repeat(offsets[:-1], n) + (np.arange(n.sum()) - np.repeat(first_of, n)) * WINDOW
    return starts, np.minimum(starts + WINDOW, np.repeat(offsets[1:], n)), first_of


def window_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    place = starts[:, None] + np.arange(WINDOW)
    inside = place < ends[:, None]
    out = np.zeros(place.shape, np.uint8)
    out[inside] = data[place[inside]]
    return out


def least_hashes(rows: DataFrame, most: int) -> list[tuple[str, int]]:
    """(label, hash) of the ``most`` least distinct hashes of each label.

    A task keeps that many of each label; before the driver merges them, a few
    tasks merge those of all others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded, hashes = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = coded.indices.to_numpy()
            for i, label in enumerate(coded.dictionary.to_pylist()):
                mine = np.unique(hashes[code == i])
                held[label] = np.unique(np.append(held[label], mine))[:most] if label in held else mine[:most]
        for label, mine in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(mine), pa.string()), pa.array(mine, pa.int64())], names=["label", "h"])

    found = rows.select("label", "h").mapInArrow(tidy(each), "label string, h long").repartition(MERGES).mapInArrow(tidy(each), "label string, h long").toArrow()
    out: dict[str, set[int]] = {}
    for label, h in zip(found.column("label").to_pylist(), found.column("h").to_pylist(), strict=True):
        out.setdefault(label, set()).add(h)
    return [(label, h) for label in sorted(out) for h in sorted(out[label])[:most]]


def fit(docs: DataFrame, train_when: Column, text_col: str = "text", label_col: str = "lang", rows_per_label: int = 800, windows_per_row: int = 6) -> Network | None:
    """Trains on ``rows_per_label`` distinct texts of each label, or all it has.

    Only rows with a label, a text and a true ``train_when`` are looked at.  The
    sample is the texts of the least hashes, so reruns agree and copies of a text
    count once.  None without such rows.
    """
    prepare_workers(docs.sparkSession)
    rows = docs.where(train_when & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    wanted = least_hashes(rows, rows_per_label)
    if not wanted:
        return None
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, "label string, h long")), ["label", "h"], "left_semi").select("label", "h", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(new, pa.bool_()))
            labels, hashes, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), ([], [], [])
            for row, end, data, offsets in text_chunks(pc.utf8_lower(batch.column(2))):
                starts, ends, first_of = cut_windows(data, offsets)
                n = np.diff(np.append(first_of, len(starts)))
                for i in range(end - row):
                    take = first_of[i] + np.unique(np.linspace(0, n[i] - 1, windows_per_row).astype(int))
                    out[0].append(labels[row + i])
                    out[1].append(hashes[row + i])
                    out[2].append(window_bytes(data, starts[take], ends[take]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["label", "h", "windows"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {key for batch in batches for key in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held) if held else ([], [], []), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["label", "h", "windows"])

    schema = "label string, h long, windows binary"
    found = {(r.label, r.h): bytes(r.windows) for r in chosen.mapInArrow(tidy(each), schema).repartition(MERGES).mapInArrow(tidy(once), schema).collect()}
    held = sorted((w[i : i + WINDOW], label) for (label, _), w in found.items() for i in range(0, len(w), WINDOW))
    return train(np.frombuffer(b"".join(w for w, _ in held), np.uint8).reshape(-1, WINDOW), [label for _, label in held])


def identify(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the language of its whole text.

    Returns ``row`` (a struct of all columns, so no name can clash), ``lang_pred``
    and ``score`` (0 to 1).  Null, empty and letterless texts are ``und`` with
    score 0, as is everything where there is no network.  Repeated rows each have
    their result; an empty table gives an empty result.
    """
    prepare_workers(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).field(text_col).cast(pa.large_string())
            label, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            for row, end, data, offsets in text_chunks(pc.utf8_lower(text)) if network else ():
                starts, ends, first_of = cut_windows(data, offsets)
                total = np.zeros((len(starts), len(network.labels)))
                for i in range(0, len(starts), BATCH):
                    part = slice(i, i + BATCH)
                    total[part] = network.probabilities(window_bytes(data, starts[part], ends[part]))
                total *= np.maximum(ends - starts, 1)[:, None]
                mean = np.add.reduceat(total, first_of, axis=0) / np.maximum(np.diff(offsets), 1)[:, None]
                ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
                lettered = np.diff(ascii_letter[offsets]) > 0
                for i in np.flatnonzero(~lettered):
                    lettered[i] = any(c.isalpha() for c in text[row + int(i)].as_py() or "")
                best = mean.argmax(axis=1)
                label[row:end] = np.where(lettered, np.array(network.labels, object)[best], UNKNOWN)
                score[row:end] = np.where(lettered, np.round(mean[np.arange(len(best)), best].clip(0, 1), 6), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(tidy(each), schema)
