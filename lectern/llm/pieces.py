"""SentencePiece encoding and decoding for merge-type models, exact, by backtracking.

The library joins, again and again, the neighbours whose joined text is the piece
of the highest score, of equal ones the leftmost.  Whether a row of pieces is what
comes out can be told from neighbours alone: what is joined within two adjacent
pieces does not depend on what stands around them, as long as nothing is joined
across their ends.  So a row of pieces is right if each two neighbours, put
together and merged anew, give these two again; and as every text has one such
row, so has every beginning of it.

Encoding goes through a text from the left.  Aho-Corasick finds the longest piece at
each place; where it doesn't go with the piece before it, the next shorter one
that begins it is tried, and where none does, the place is marked in a bitfield as
one at which no piece ends, and the search goes back by a piece.  A place fails
once at most, so the work is linear in the text.

Texts are cut where no piece can reach across: before the signs for spaces that
follow something else, and around characters that are in no piece.  Short cuts are
encoded once and kept, in a number that is bounded.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import prepare_workers, tidy

#: The sign that stands for a space.
SPACE = "▁"
#: What a worker keeps: cuts of so many characters at most, so many of them, and so many answers on neighbours.
LONGEST_KEPT, MOST_KEPT, MOST_ANSWERS = 64, 500_000, 1_000_000


def best_pair(parts: list[str], score: dict[str, float]) -> int | None:
    """The place of the neighbours that are joined next: of the highest score, then the leftmost."""
    best, at = None, None
    for i in range(len(parts) - 1):
        s = score.get(parts[i] + parts[i + 1])
        if s is not None and (best is None or s > best):
            best, at = s, i
    return at


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The merge procedure itself, on a short text."""
    parts = list(text)
    while (at := best_pair(parts, score)) is not None:
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Vocabulary:
    """The pieces of a model and what follows from them; it is sent to workers without what they work out themselves."""

    pieces: list[str]  # by id
    score: dict[str, float]  # of those that texts are made of
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: int
    silent: frozenset[int]  # ids that decode to nothing
    reached: list[str]  # pieces that the merge procedure makes of their own text
    _made: dict = field(default_factory=dict, repr=False)
    _characters: dict = field(default_factory=dict, repr=False)
    _answers: dict = field(default_factory=dict, repr=False)
    _kept: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pieces", "score", "ids", "byte_ids", "unknown", "silent", "reached")} | {"_made": {}, "_characters": {}, "_answers": {}, "_kept": {}}

    # --- cutting

    @cached_property
    def cuts(self) -> re.Pattern:
        """Parts of a normalised text that no piece reaches across: the finest of three ways of cutting that leaves every piece whole."""
        used = set("".join(self.score))
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in used))
        # letters that stand beside other signs in some piece are signs here
        odd = "".join({c for p in self.score if re.search(r"[^\W\d_]", p) and re.search(f"[^\\w{SPACE}]|_", p) for c in p if re.match(r"[^\W\d_]", c)})
        ways = (f"{SPACE}*[^\\W\\d_{odd}]+|{SPACE}*(?:[^\\w{SPACE}{alone}]|[_{odd}])+|{SPACE}+|\\d|[{alone}]+", f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]+", "(?s).+")
        return next(w for w in map(re.compile, ways) if all(w.fullmatch(p) and w.match(p).end() == len(p) for p in self.score))

    # --- encoding: pieces and characters that are none are numbers here, in order of first use for the latter

    @cached_property
    def _texts(self) -> list[str]:
        return list(self.reached)

    @cached_property
    def _sizes(self) -> list[int]:
        return [len(p) for p in self._texts]

    @cached_property
    def _automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, p in enumerate(self.reached):
            a.add_word(p, i)
        a.make_automaton()
        return a

    @cached_property
    def _shorter(self) -> list[int | None]:
        """For each piece the longest one that begins it; a character at last, whether it is a piece or not."""
        known = {p: i for i, p in enumerate(self.reached)}
        return [next((known[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None if len(p) == 1 else self._character(p[0])) for p in self.reached]

    def _character(self, c: str) -> int:
        """The number of a character that is no piece."""
        held = self._characters.get(c)
        if held is None:
            held = self._characters[c] = len(self._texts)
            self._texts.append(c)
            self._sizes.append(1)
        return held

    def _steps(self, piece: str) -> tuple[list[float | None], list[str], list[str]]:
        """How a piece comes about: the score of each joining in it, then none, and its first and last part before each."""
        held = self._made.get(piece)
        if held is None:
            parts, scores, first, last = list(piece), [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                at = best_pair(parts, self.score)
                scores.append(self.score[parts[at] + parts[at + 1]])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                first.append(parts[0])
                last.append(parts[-1])
            held = self._made[piece] = [*scores, None], first, last
        return held

    def fit(self, a: str, b: str) -> bool:
        """Whether two neighbours, put together and merged anew, give these two again.

        Each comes about as it does alone until a joining across their border is better
        than the next one in the left, and no worse than the next one in the right; so
        the merging is followed no further than it takes to see that.
        """
        (left, _, last), (right, first, _) = self._steps(a), self._steps(b)
        score, i, j = self.score, 0, 0
        while True:
            across, in_a, in_b = score.get(last[i] + first[j]), left[i], right[j]
            if across is not None and (in_a is None or across > in_a) and (in_b is None or across >= in_b):
                return False
            if in_b is None or in_a is not None and in_a >= in_b:
                if in_a is None:
                    return True
                i += 1
            else:
                j += 1

    def split(self, text: str) -> list[int]:
        """Numbers of the pieces and unknown characters of a text that isn't empty."""
        shorter, sizes, answers, texts = self._shorter, self._sizes, self._answers, self._texts
        longest: list[int | None] = [None] * len(text)
        for end, t in self._automaton.iter(text):  # shorter ones at a place end earlier
            longest[end - sizes[t] + 1] = t
        if None in longest:
            longest = [self._character(c) if t is None else t for t, c in zip(longest, text, strict=True)]
        pieces, stop, at, before = len(shorter), len(text), 0, -1
        failed: bytearray | None = None  # a bit a place at which no piece ends
        out: list[int] = []
        t: int | None = longest[0]
        while True:
            while t is not None:
                end = at + sizes[t]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    pair = before << 21 | t  # a number is below that of all characters and pieces
                    fits = answers.get(pair)
                    if fits is None:
                        if len(answers) >= MOST_ANSWERS:
                            answers.clear()
                        fits = answers[pair] = self.fit(texts[before], texts[t])
                    if fits:
                        break
                t = shorter[t] if t < pieces else None
            if t is not None:
                out.append(t)
                if end == stop:
                    return out
                at, before = end, t
                t = longest[at]
                continue
            if before < 0:
                raise RuntimeError("the merge procedure has no result")  # it always has one
            failed = failed or bytearray(stop // 8 + 1)
            failed[at >> 3] |= 1 << (at & 7)
            last = out.pop()
            at -= sizes[last]
            before = out[-1] if out else -1
            t = shorter[last] if last < pieces else None

    @cached_property
    def _coded(self) -> list[int]:
        return [self.ids[p] for p in self.reached]

    def ids_of(self, part: str) -> list[int]:
        """Ids of a part; a character that is no piece goes byte by byte."""
        coded = self._coded
        found = self.split(part)
        if max(found) < len(coded):
            return [coded[t] for t in found]
        out: list[int] = []
        for t in found:
            if t < len(coded):
                out.append(coded[t])
            else:
                out += [self.byte_ids[b] for b in self._texts[t].encode()] if self.byte_ids else [self.unknown]
        return out

    def _packed(self, part: str) -> bytes:
        """The ids of a part, four bytes each; those of a short one are kept."""
        ids = self.ids_of(part)
        held = struct.pack(f"<{len(ids)}i", *ids)
        if len(part) <= LONGEST_KEPT:
            if len(self._kept) >= MOST_KEPT:
                self._kept.clear()
            self._kept[part] = held
        return held

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's)."""
        cut, kept, packed, out = self.cuts.findall, self._kept.get, self._packed, []
        bounds = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                out.append(b"".join([kept(p) or packed(p) for p in cut(SPACE + text.replace(" ", SPACE))]))
                bounds[i + 1] = len(out[-1]) // 4
        return np.frombuffer(b"".join(out), "<i4"), np.cumsum(bounds)

    # --- decoding

    @cached_property
    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces, one after another, and their bounds."""
        of = [b"" if i in self.silent else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        of[self.unknown] = " ⁇ ".encode()
        for byte, i in enumerate(self.byte_ids):
            of[i] = bytes([byte])
        return np.frombuffer(b"".join(of), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in of])])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces put together without the space that encoding puts first, bytes that are no text each as U+FFFD."""
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.pieces):
            raise ValueError("an id is not in the vocabulary")
        data, bounds = self._spelled
        starts, sizes = bounds[ids], bounds[ids + 1] - bounds[ids]
        places = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        out = data[places].tobytes()
        if self.silent and self.byte_ids and np.isin(ids, list(self.silent)).any():
            # what decodes to nothing ends a run of bytes: each run is text by itself
            quiet = np.isin(ids, list(self.silent))
            ends = np.cumsum(sizes)
            cuts = [0, *ends[np.flatnonzero(quiet)].tolist(), len(out)]
            return self._unspaced(ids, "".join(out[a:b].decode("utf-8", "each_byte") for a, b in zip(cuts, cuts[1:])))
        return self._unspaced(ids, out.decode("utf-8", "each_byte"))

    def _unspaced(self, ids: np.ndarray, text: str) -> str:
        loud = next((i for i in ids.tolist() if i not in self.silent), None)
        return text[1:] if loud is not None and loud != self.unknown and self.pieces[loud].startswith(SPACE) else text


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("each_byte", _each_byte)


def vocabulary(model_file: str) -> Vocabulary:
    """Reads a model file; ValueError for models of another type, or with a normalizer or pieces that this module doesn't know."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(model_file, "rb") as f:
        spec.ParseFromString(f.read())
    kind, norm, piece = pb.TrainerSpec, spec.normalizer_spec, pb.ModelProto.SentencePiece
    known = {piece.NORMAL, piece.UNKNOWN, piece.CONTROL, piece.BYTE}
    if spec.trainer_spec.model_type != kind.BPE or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only merge-type models with spaces before words are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or spec.denormalizer_spec.precompiled_charsmap:
        raise ValueError("only models that leave texts as they are, but for a space put first, are supported")
    if any(p.type not in known for p in spec.pieces):
        raise ValueError("models with unused or user-defined pieces are not supported")
    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    score = {p.piece: p.score for p in spec.pieces if p.type == piece.NORMAL}
    byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if spec.trainer_spec.byte_fallback else []
    return Vocabulary(
        pieces=[p.piece for p in spec.pieces],
        score=score,
        ids={p.piece: i for i, p in enumerate(spec.pieces) if p.type == piece.NORMAL},
        byte_ids=byte_ids,
        unknown=library.unk_id(),
        silent=frozenset(i for i, p in enumerate(spec.pieces) if p.type == piece.CONTROL),
        reached=[p for p in score if merged(p, score) == [p]],
    )


def encode(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the ids of its whole text, as the library gives them without begin or end ids.

    Returns ``row`` (a struct of all columns but the text, so no name can clash) and
    ``ids`` (array of int).  Null and empty texts have no ids; the sign for spaces inside a text
    counts as a space, names of special pieces as ordinary text.  Repeated rows each have
    their result; an empty table gives an empty result.
    """
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            ids, bounds = words.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "ids"])

    return rows.mapInArrow(tidy(each), schema)


def decode(spark: SparkSession, coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Every row of ``coded`` with ``decoded``, the text of its ids; none and null give an empty text, ids beyond the vocabulary an error."""
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])
    at = coded.columns.index(ids_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            lists = batch.column(at)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)
            texts = [words.decode(ids[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(tidy(each), schema)
