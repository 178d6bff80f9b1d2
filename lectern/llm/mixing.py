"""Mixing sources to target weights.

The words of a source, text after text, are packed into blocks of fixed length.
The mix is a row of slots in shards of fixed size.  For each shard a
multinomial draw says how many of its slots each source fills; the chances
follow what each source still has to give, so the draws end at its target.  A
source's slots are numbered through, and slot j takes the block that the
source's pseudorandom permutation (a Feistel network walked within the index
range) has at j modulo the number of blocks: every block is taken once before
any is taken twice.  A source's last block is short and ends each pass over it,
and the last slot is cut where the target is met.  Slots and blocks meet in an equi-join on (source, block).

Where a source starts in a text order is a prefix sum.  A source may hold a
third of all rows, so it is summed in two levels: rows within hash buckets of a
source, then the buckets' totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import Scratch, prepare_workers, tidy
from lectern.llm.words import text_chunks, word_hashes

BLOCK_WORDS = 128
#: Slots of a shard at least; shards grow with more slots than MOST_SHARDS of these, or with so many sources
#: that the draws of all shards, which the driver makes, were more than MOST_DRAWS.
SHARD_SLOTS, MOST_SHARDS, MOST_DRAWS = 4096, 4096, 2_000_000
#: Rows of a source that one bucket of the prefix sum holds about: a share of all rows, within bounds.
BUCKET_SHARE, LEAST_BUCKET, MOST_BUCKET = 20_000, 200, 20_000
#: Totals of buckets, and sources, sent to all tasks at most; with more, a shuffled join takes their place.
MOST_SENT_TOTALS = MOST_SENT_SOURCES = 200_000
#: Slots that are numbered through in one array, and those of one task, about.
SLOTS_OF_A_ROW, SLOTS_OF_A_TASK = 4096, 2_000_000
WORD = "[^\\x20\\x09-\\x0D]+"
ROUNDS = 4


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Splits ``share`` of all sizes by weight; none goes over ``most`` times its size, the excess is shared again."""
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], share * sum(sizes)
    while open_:
        of = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / of > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / of
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A small side of a join: sent to all tasks only if it has so many rows at most."""
    return F.broadcast(df) if rows <= most else df


@dataclass
class Plan:
    """Per source, in order (None is the null source): sizes, targets and words to take; and slots by shard."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    words: list[int]
    slots: list[int]
    drawn: np.ndarray  # shards x sources


def make_plan(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 11) -> Plan:
    """Targets, and multinomial slot counts of every shard.

    A draw takes no more of a source than it still has to give; what falls
    short is drawn again among the others.
    """
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    size = [sizes[s] for s in names]
    target = targets(size, [weights[i % len(weights)] for i in range(len(names))], share, most)
    words = [min(round(t), math.floor(most * n)) for t, n in zip(target, size, strict=True)]
    slots = [w // n * math.ceil(n / block_words) + math.ceil(w % n / block_words) if n else 0 for w, n in zip(words, size, strict=True)]
    shards = max(1, min(MOST_SHARDS, MOST_DRAWS // max(len(names), 1)))
    shard = max(SHARD_SLOTS, math.ceil(sum(slots) / shards))
    rng, left, drawn = np.random.default_rng(seed), np.array(slots, np.int64), []
    while left.sum() > shard:
        got = np.zeros_like(left)
        while short := shard - got.sum():
            rest = left - got
            got += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        drawn.append(got)
        left = left - got
    drawn.append(left)
    return Plan(names, size, target, words, slots, np.array(drawn).reshape(len(drawn), len(names)))


def permuted(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..count-1 at ``index``, by key, elementwise.

    A Feistel network on the least even number of bits that hold ``count``; a
    number that falls outside goes through it again until it is inside.
    """
    half = np.maximum(np.ceil(np.log2(np.maximum(count, 2)) / 2).astype(np.int64), 1)
    low = (np.int64(1) << half) - 1

    def once(x, half, low, key):
        left, right = x >> half, x & low
        for r in range(ROUNDS):
            h = (right.astype(np.uint64) + (key + r).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(32)).astype(np.int64) & low)
        return (left << half) | right

    out = once(index, half, low, key)
    while (far := np.flatnonzero(out >= count)).size:
        out[far] = once(out[far], half[far], low[far], key[far])
    return out


def _permuted_series(index: pd.Series, count: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(np.int64), count.to_numpy(np.int64), key.to_numpy(np.int64)))


def placed(docs: DataFrame, doc_col: str, text_col: str, source_col: str, scratch: Scratch, with_text: bool) -> tuple[DataFrame, dict[str | None, int]]:
    """Rows (doc_id, source, size, tie, start[, text]) with each text's first word number in its source; and the sources' sizes.

    Texts are ordered by hash bucket, then id, then (for rows of one id) a hash of the text.
    """
    text = F.col(text_col).cast("string")
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    named = [F.col(doc_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie")]
    sized = scratch.keep(docs.select(*named), "sized")
    counted = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    held = min(max(sum(r["n"] for r in counted) // BUCKET_SHARE, LEAST_BUCKET), MOST_BUCKET)
    many = [(r["source"], math.ceil(r["n"] / held)) for r in counted]
    cut = sent(docs.sparkSession.createDataFrame(many, "cut_source string, buckets int"), len(many), MOST_SENT_SOURCES)
    in_buckets = lambda df: df.join(cut, F.col("source").eqNullSafe(F.col("cut_source"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.col("buckets"))).drop("cut_source", "buckets")
    before = F.sum("n").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    totals = in_buckets(sized).groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("n")).select("s", "b", F.coalesce(before, F.lit(0)).alias("base"))
    totals = sent(totals, sum(n for _, n in many), MOST_SENT_TOTALS)
    within = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, -1))
    rows = docs.select(*named, text.alias("text")) if with_text else sized
    rows = in_buckets(rows).withColumn("within", F.coalesce(within, F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.select("doc_id", "source", "size", "tie", (F.col("base") + F.col("within")).alias("start"), *(["text"] * with_text)), {r["source"]: r["size"] for r in counted}


def _cut(block_words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source_no, start = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for row, end, data, offsets in text_chunks(batch.column(3)):
                _, bounds, first, last = word_hashes(data, offsets)
                n, at = np.diff(bounds), start[row:end]
                of = np.repeat(np.arange(end - row), np.where(n > 0, (at + n - 1) // block_words - at // block_words + 1, 0))
                k = np.arange(len(of)) - np.searchsorted(of, of)
                block = at[of] // block_words + k
                a = np.maximum(block * block_words - at[of], 0)
                b = np.minimum((block + 1) * block_words - at[of], n[of])
                i, j = first[bounds[of] + a], last[bounds[of] + b - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source_no[row:end][of]), pa.array(block), batch.column(1).take(pa.array(row + of)), pa.array(at[of]), pa.array(a), pa.array(b - a), pa.array([data[x:y].tobytes().decode() for x, y in zip(i, j, strict=True)], pa.string())],
                    names=["source_no", "block", "doc_id", "start", "first_word", "n", "text"],
                )

    return each


def mix(spark: SparkSession, docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 11, with_text: bool = True) -> tuple[DataFrame, DataFrame, Plan]:
    """The mix of all texts of ``docs``, and what it was made from.

    The first result has a row for each part of a text in a slot: shard, slot
    (number in the shard), source, block, doc_id, start (of the text in its
    source), first_word (in the text), n_words and, if wanted, text (that part,
    with the white space inside it).  Sources in code point order, null last,
    weigh ``weights``, repeating; together they give ``share`` of all words;
    none gives over ``most`` times its own, the excess is shared again by
    weight.  The second result is the texts: doc_id, source, size (words), start.

    * Null, empty and wordless texts have size 0 and are in no slot.
    * A null source is a source of its own; null ids stay null.
    * Repeated rows are texts of their own, each taken.  Reruns agree.
    * An empty table gives an empty mix.  Other columns are not read.
    """
    prepare_workers(spark)
    scratch = Scratch(spark)
    texts, sizes = placed(docs, doc_col, text_col, source_col, scratch, with_text)
    if not with_text:
        texts = scratch.keep(texts, "placed")
    plan = make_plan(sizes, weights, share, most, block_words, seed)
    numbers = spark.createDataFrame([(i, s, plan.sizes[i], plan.words[i]) for i, s in enumerate(plan.sources)], "source_no int, source_name string, source_size long, source_words long")
    first = np.cumsum(plan.drawn, axis=0) - plan.drawn
    at = np.cumsum(plan.drawn, axis=1) - plan.drawn
    h, i = np.nonzero(plan.drawn)
    cells = pa.table({"shard": pa.array(h, pa.int32()), "source_no": pa.array(i, pa.int32()), **{name: pa.array(x[h, i], pa.int64()) for name, x in (("slots", plan.drawn), ("first", first), ("at", at))}})
    # a row for each run of slots, dealt to as many tasks as there are slots, then one for each slot
    runs = spark.createDataFrame(cells).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOTS_OF_A_ROW))).alias("run"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(sum(plan.slots) / SLOTS_OF_A_TASK))
    runs = runs.repartition(tasks, "shard", "source_no", "run")
    begin = F.col("run") * SLOTS_OF_A_ROW
    numbered_runs = runs.join(sent(numbers, len(plan.sources), MOST_SENT_SOURCES), "source_no")
    slots = numbered_runs.select("*", F.explode(F.sequence(begin, F.least(begin + SLOTS_OF_A_ROW, "slots") - 1)).alias("k"))
    blocks, full, j = F.ceil(F.col("source_size") / block_words), F.floor(F.col("source_size") / block_words), F.col("first") + F.col("k")
    slots = slots.select("shard", (F.col("at") + F.col("k")).alias("slot"), "source_no", "source_name", "source_words", "source_size", F.floor(j / blocks).alias("lap"), (j % blocks).alias("index"), full.alias("full"))
    key = F.xxhash64(F.lit(seed), "source_no", "lap").bitwiseAND(F.lit((1 << 40) - 1))
    permute = F.pandas_udf(_permuted_series, "long")
    block = F.when(F.col("index") < F.col("full"), permute(F.least("index", F.greatest(F.col("full") - 1, F.lit(0))), F.greatest("full", F.lit(1)), key)).otherwise(F.col("full"))
    slots = slots.select("shard", "slot", "source_no", F.col("source_name").alias("source"), block.alias("block"), (F.col("source_words") - F.col("lap") * F.col("source_size") - F.col("index") * block_words).alias("room"))
    numbered = texts.where("size > 0").join(sent(numbers.select("source_no", "source_name"), len(plan.sources), MOST_SENT_SOURCES), F.col("source").eqNullSafe(F.col("source_name"))).drop("source", "source_name")
    if with_text:
        id_type = docs.schema[doc_col].dataType.simpleString()
        parts = numbered.select("source_no", "doc_id", "start", "text").mapInArrow(tidy(_cut(block_words)), f"source_no int, block long, doc_id {id_type}, start long, first_word long, n long, text string")
    else:
        b = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
        parts = numbered.select("source_no", b.alias("block"), "doc_id", "start", "size")
        first_word = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
        parts = parts.select("source_no", "block", "doc_id", "start", first_word.alias("first_word"), (F.least((F.col("block") + 1) * block_words - F.col("start"), "size") - first_word).alias("n"))
    into = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    joined = slots.join(parts, ["source_no", "block"]).withColumn("n_words", F.least("n", F.col("room") - into)).where("n_words > 0")
    out = ["shard", "slot", "source", "block", "doc_id", "start", "first_word", "n_words"]
    if with_text:
        begins = F.concat(F.lit(f"^(?:{WORD}[\\x20\\x09-\\x0D]+){{"), (F.col("n_words") - 1).cast("string"), F.lit(f"}}{WORD}"))
        words = F.when(F.col("n_words") == F.col("n"), F.col("text")).otherwise(F.call_function("regexp_extract", F.col("text"), begins, F.lit(0)))
        joined = joined.withColumn("text", words)
    return joined.select(*out, *(["text"] * with_text)), texts.select("doc_id", "source", "size", "start"), plan
