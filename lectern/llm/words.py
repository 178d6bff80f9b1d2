"""Vectorised word hashing over batches of texts.

Several operators need, for every word of every text, a 64-bit value that is
equal for equal words.  Here a batch of texts becomes one byte buffer and all
words of it are hashed with a handful of numpy passes: a byte table lower-cases
A-Z and maps separators to zero, a wrapped cumulative sum of ``R[b] * P**i``
gives the polynomial value of any span, and multiplying by ``P**-start`` makes
it independent of the place.  Everything works on UTF-8 bytes, which is right
because all separators are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the size of the power tables and temporaries.
CHUNK_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _table(word_byte) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 0x41 <= b <= 0x5A else b
        if word_byte(c):
            table[b] = c
    return table


#: Words are runs of anything but space, tab, line feed, VT, FF and CR.
#: (A zero byte is a word byte of value zero, so it is mapped to 0xFF, which UTF-8 never holds.)
SPACED = _table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D)
SPACED[0] = 0xFF
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = _table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_P, _P_INV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 per span ``values[start:end]`` (uint64 per symbol), equal for equal spans."""
    up, down = _power_tables(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a buffer that holds texts one after another.

    ``offsets`` has len(texts)+1 places in ``data``.  Returns the word hashes in
    order, ``bounds`` (len(texts)+1: words of text i are bounds[i]:bounds[i+1]),
    and each word's start and end byte.  Words never cross texts.
    """
    n = len(data)
    low = table[data]
    is_word = low != 0
    edge = np.zeros(n + 1, bool)
    if n:
        edge[0], edge[n] = is_word[0], is_word[-1]
        np.not_equal(is_word[1:], is_word[:-1], out=edge[1:n])
        # texts that meet without a separator: a word ends and another starts there
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    touching = inner[is_word[inner] & is_word[inner - 1]] if n else inner
    places = np.flatnonzero(edge)
    if len(touching):
        places = np.sort(np.concatenate([places, touching, touching]), kind="stable")
    starts, ends = places[0::2], places[1::2]
    hashes = hash_spans(_BYTE_VALUES[low], starts, ends)
    return hashes, np.searchsorted(starts, offsets), starts, ends


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets); a row is never cut, nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of ``size`` words, and their bounds.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    lengths = np.diff(bounds)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_bounds[-1], np.uint64)
    # place of each shingle's first word
    first = np.arange(len(out)) + np.repeat(bounds[:-1] - out_bounds[:-1], counts)
    width = np.repeat(np.minimum(lengths, size), counts)
    out[:] = np.uint64(0x243F6A8885A308D3) + width.astype(np.uint64)
    for j in range(size):
        on = width > j
        if on.all():
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[first + j])
        elif on.any():
            out[on] = mix(out[on] * np.uint64(0x2545F4914F6CDD1D) + words[first[on] + j])
    return out, out_bounds
