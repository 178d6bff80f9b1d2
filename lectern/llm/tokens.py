"""Token counts without token ids.

A tokenizer's pieces are counted once for each distinct pre-token of all texts.
The counts are kept as sorted hash arrays in the shared folder; a pass over the
documents joins each one's pre-token frequencies to them (by merge on the
memory-mapped arrays, so documents are not shuffled) and sums.

Pre-tokens are found a batch at a time on arrays of code points, which a table
puts in four classes: letters, numbers, space, all else.  A run of letters, a
number sign and a run of other signs are pre-tokens, and an apostrophe alone
before one of seven endings goes with it.  The texts that hold the string of a
special token, or the one letter whose lower case is two characters, go through
the library whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import arrays
from lectern.llm.shared import Scratch, prepare_workers, tidy
from lectern.llm.words import hash_spans, mix, text_chunks

#: Distinct pre-tokens that one bucket of the piece table holds about.
BUCKET_KEYS = 1_000_000
#: The split of the tokenizer files that this module's pre-tokenizer reproduces.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ONE_SIGN_ENDINGS, TWO_SIGN_ENDINGS = "stmd", ("re", "ve", "ll")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_classes: list[np.ndarray] = []
_tokenizers: dict[int, tuple] = {}


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        of = {"L": LETTER, "N": NUMBER, "Z": SPACE}
        table = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[[9, 10, 11, 12, 13, 0x85]] = SPACE
        _classes.append(table)
    return _classes[0]


def tokenizer(vocabulary: str):
    """(library tokenizer as it is, one that takes pre-tokens as they are, special strings) of a tokenizer file's text."""
    key = hash(vocabulary)
    if key not in _tokenizers:
        from tokenizers import Tokenizer, normalizers

        spec = json.loads(vocabulary)
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", ())]
        splits = [s.get("pattern", {}).get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())]
        if steps != ["NFC", "Replace", "Lowercase"] or splits != [SPLIT, None]:
            raise ValueError("only tokenizers with this module's normalizer and split are supported")
        whole, bare = Tokenizer.from_str(vocabulary), Tokenizer.from_str(vocabulary)
        for t in (whole, bare):
            t.no_truncation()
            t.no_padding()
        bare.normalizer = normalizers.Sequence([])
        bare.encode_special_tokens = True
        _tokenizers[key] = whole, bare, [t["content"] for t in spec["added_tokens"]]
    return _tokenizers[key]


def pre_tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds of texts, code points, starts, ends) of the pre-tokens, some rows at a time."""
    table = classes()
    # capital sigma by itself: the library's lower case does not look at its place in the word
    normal = pa.array([unicodedata.normalize("NFC", x or "").replace("Σ", "σ").lower() for x in column.to_pylist()], pa.large_string())
    for row, end, data, offsets in text_chunks(normal):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        n = len(points)
        if not n:
            yield row, end, np.empty(0, np.uint64), np.zeros(end - row + 1, np.int64), points, at[:0], at[:0]
            continue
        kind = table[points]
        begins = np.ones(n + 1, bool)
        begins[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins[at] = True
        begins = begins[: n + 1]
        # an apostrophe that is a run by itself, with letters of the same text after it
        text_end = np.repeat(at[1:], np.diff(at))
        quote = np.flatnonzero((points == 0x27) & begins[:n])
        quote = quote[(quote + 1 < text_end[quote])]
        quote = quote[begins[quote + 1] & (kind[quote + 1] == LETTER)]
        if len(quote):
            after = points[quote + 1]
            one = np.isin(after, [ord(c) for c in ONE_SIGN_ENDINGS])
            second = np.where(quote + 2 < text_end[quote], points[np.minimum(quote + 2, n - 1)], 0)
            two = np.zeros(len(quote), bool)
            for a, b in TWO_SIGN_ENDINGS:
                two |= (after == ord(a)) & (second == ord(b))
            for which, size in ((one, 2), (two & ~one, 3)):
                begins[quote[which] + 1] = False
                begins[quote[which] + size] = True
        edge = np.flatnonzero(begins)
        starts, ends = edge[:-1], edge[1:]
        real = kind[starts] != SPACE
        starts, ends = starts[real], ends[real]
        hashes = hash_spans(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)
        yield row, end, hashes, np.searchsorted(starts, at), points, starts, ends


def _whole(column: pa.Array, special: list[str]) -> np.ndarray:
    """Rows that go through the library whole."""
    hit = np.zeros(len(column), bool)
    for s in [*special, "İ"]:
        hit |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
    return hit


def piece_table(spark: SparkSession, texts: DataFrame, vocabulary, scratch: Scratch) -> tuple[str, int]:
    """Counts the pieces of every distinct pre-token of ``texts`` (text); the folder and the bits that number buckets."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.uint64)
        _, _, special = tokenizer(vocabulary.value)
        for batch in batches:
            column = batch.column(0)
            column = column.filter(pa.array(~_whole(column, special)))
            for _, _, hashes, _, points, starts, ends in pre_tokens(column):
                new, first = np.unique(hashes, return_index=True)
                fresh = ~arrays.find(seen, new)[1]
                new, first = new[fresh], first[fresh]
                seen = np.sort(np.concatenate([seen, new]))
                strings = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[first], ends[first], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(strings, pa.string())], names=["hash", "token"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bare, _ = tokenizer(vocabulary.value)
        for batch in batches:
            tokens, n = batch.column(1).to_pylist(), []
            for i in range(0, len(tokens), 2000):
                n += [len(e) for e in bare.encode_batch(tokens[i : i + 2000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["hash", "n"])

    once = texts.mapInArrow(tidy(distinct), "hash long, token string").distinct()
    counted = scratch.keep(once.mapInArrow(tidy(count), "hash long, n long"), "pieces")
    bits = max(0, int(np.ceil(np.log2(max(counted.count() / BUCKET_KEYS, 1)))))
    root = scratch.path("piece-arrays")

    def store(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        arrays.write(root, str(key[0]), {"keys": keys[order], "n": pdf["n"].to_numpy(np.uint32)[order]})
        return pd.DataFrame({"bucket": [key[0]], "n": [len(pdf)]})

    bucket = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    counted.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(store, "bucket int, n long").agg(F.sum("n")).collect()
    scratch.drop("pieces")
    return root, bits


def lookup(root: str, bits: int, wanted: np.ndarray) -> np.ndarray:
    """Pieces of each of the sorted hashes ``wanted``; all are in the table."""
    out = np.zeros(len(wanted), np.int64)
    bucket = (wanted >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(wanted), np.int64)
    for b in np.unique(bucket):
        lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, side="right")
        held = arrays.read(root, str(b))
        place, found = arrays.find(held.get("keys"), wanted[lo:hi])
        if not found.all():
            raise RuntimeError("a pre-token is not in the piece table")
        out[lo:hi] = held["n"][place]
    return out


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary_file: str, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the number of tokens of its whole text.

    Returns ``row`` (a struct of all columns, so no name can clash), ``n_bytes``
    (UTF-8) and ``n_tokens``, as the library gives them without begin, end or
    added special tokens; the strings of special tokens inside texts count as the
    library's default has it.  Null and empty texts have no bytes and no tokens.
    Repeated rows each have their result; an empty table gives an empty result.
    """
    prepare_workers(spark)
    scratch = Scratch(spark)
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()
    tokenizer(content)  # fails here, not in tasks, if it is of another kind
    vocabulary = spark.sparkContext.broadcast(content)
    root, bits = piece_table(spark, docs.select(F.col(text_col).cast("string").alias("text")), vocabulary, scratch)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, _, special = tokenizer(vocabulary.value)
        for batch in batches:
            text = batch.column(0).field(text_col).cast(pa.large_string())
            n_bytes = pc.fill_null(pc.binary_length(text), 0)
            n = np.zeros(len(batch), np.int64)
            apart = _whole(text, special)
            for row, end, hashes, bounds, *_ in pre_tokens(pc.if_else(pa.array(apart), "", text)):
                if not len(hashes):
                    continue
                keys, which = np.unique(hashes, return_inverse=True)
                total = np.concatenate([[0], np.cumsum(lookup(root, bits, keys)[which])])
                n[row:end] = np.diff(total[bounds])
            for i in np.flatnonzero(apart):
                n[i] = len(whole.encode(text[int(i)].as_py(), add_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes.cast(pa.int64()), pa.array(n)], names=["row", "n_bytes", "n_tokens"])

    return rows.mapInArrow(tidy(each), schema)
