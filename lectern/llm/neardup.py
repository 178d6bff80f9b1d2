"""MinHash near-dedup with bottom-k sketches from one hash function.

Texts of the same shingle set form a class, of which one text goes on; classes
are numbered in the order of their smallest id.  A sketch holds the k smallest shingle hashes of a set.  A
hash also says in which of ``PARTS`` parts a shingle falls, and the few smallest
of each part make one number: alike sets agree in a number, others hardly ever,
however large the corpus and however common single shingles are.  Texts of one
number form a list; a long list is cut into bands of sizes that allow the
likeness.  Texts of lists that are still long, and small sets, for which the
search is to be exact, go on to inverted lists of the
retained values: values are ranked by rarity and a text is
listed only under its rarest values, so many that two texts whose sketches
share as much as 0.8-alike sets do must meet in a list (prefix filter).  Short lists give
pairs, which the union-sketch estimate filters with a margin of over five
standard deviations; the members of a list of a retained value that is long in
its band are taken as one
block.  Blocks are the components of what is left.  The exact step searches
each block for links on full shingle sets, breadth first, with one mark array
per text, so neither pairs nor lists of a group are ever written out; a large
block is cut into chunks, and every two chunks are searched in a task of
bounded size.  What comes out are spanning edges, whose components are the
groups.

Empty texts, texts without words and nulls have no set and link with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import ROWS_OF_A_FILE, Scratch, connected_components, prepare_workers, tidy
from lectern.llm.words import mix, shingle_hashes, text_chunks, word_hashes

#: Longest list of which pairs are made; longer ones become blocks.
SHORT_LIST = 32
#: Shingles of a block up to which it is one task; chunks of larger blocks hold an eighth of it, within bounds.
ONE_TASK, MOST_CHUNK = 1 << 15, 1 << 21
#: Ids sent to all tasks at most; with more, a shuffled join takes their place.
MOST_SENT_IDS = 300_000
#: A value that makes up more than one part in so many of all retained ones is hot; there are fewer of these than that.
HOT_SHARE = 50_000
SIGN = np.uint64(1 << 63)
#: Parts of a set of which each gives a number, and the chance at most that two sets just alike enough agree in none.
PARTS, MOST_MISSED = 32, 1e-7


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (empty if it has no word)."""
    for row, end, data, offsets in text_chunks(column):
        hashes, bounds, _, _ = word_hashes(data, offsets)
        shingles, at = shingle_hashes(hashes, bounds, size)
        for i in range(end - row):
            yield np.unique(shingles[at[i] : at[i + 1]])


def least_shared(n: int, k: int, percent: int) -> int:
    """Retained values that two sets, one of n shingles, share at least if they are as alike as ``percent``.

    Exact while the union fits the sketch, else k*p less 5.5 standard deviations.
    """
    p = percent / 100
    if n <= k * p:
        return max(1, math.ceil(n * percent / 100))
    return max(1, min(math.ceil(min(n, k) * percent / 100), math.floor(k * p - 5.5 * math.sqrt(k * p * (1 - p)))))


def part_depth(percent: int) -> int:
    """How many of the least hashes of a part make its number: as many as ``MOST_MISSED`` allows, 0 if even one is too many."""
    return max((d for d in range(1, 9) if (1 - (percent / 100) ** d) ** PARTS <= MOST_MISSED), default=0)


def part_numbers(s: np.ndarray, depth: int) -> np.ndarray:
    """A number for each part of a set (sorted hashes) that has members, of the part and its ``depth`` least members."""
    part = (mix(s) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.uint8)
    order = np.argsort(part, kind="stable")
    part, s = part[order].astype(np.int64), s[order]
    count = np.bincount(part, minlength=PARTS)
    rank = np.arange(len(s)) - (np.cumsum(count) - count)[part]
    least = rank < depth
    cells = np.zeros((PARTS, depth), np.uint64)
    cells[part[least], rank[least]] = s[least]
    out = np.arange(PARTS, dtype=np.uint64)
    for j in range(depth):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + cells[:, j])
    return out[count > 0].view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, k: int, percent: int) -> DataFrame:
    """(id, n_shingles, set_hi, set_lo, need, retained, parts): the sketch of each text; set_hi/lo name its set.

    ``parts`` has the numbers of its parts; sets so small that all sets like them are retained whole have none.
    """
    depth = part_depth(percent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, need, kept, parts = [], [], [], [], []
            for s in shingle_sets(batch.column(1), shingle_words):
                n.append(len(s))
                names.append(blake2b(s.tobytes(), digest_size=16).digest())
                need.append(least_shared(len(s), k, percent) if len(s) else 0)
                kept.append(s[:k].copy())
                parts.append(part_numbers(s, depth) if depth and 100 * len(s) > k * percent else np.empty(0, np.int64))
            named = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            offsets, of_parts = (pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)) for xs in (kept, parts))
            # the sign bit flipped, so that signed order is the order of the hashes
            values = (np.concatenate(kept) ^ SIGN).view(np.int64) if kept else np.empty(0, np.int64)
            numbers = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(named[:, 0].copy()), pa.array(named[:, 1].copy()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(values)), pa.ListArray.from_arrays(of_parts, pa.array(numbers))],
                names=["id", "n_shingles", "set_hi", "set_lo", "need", "retained", "parts"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(each), f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, set_hi long, set_lo long, need int, retained array<long>, parts array<long>")


def listed(sketches: DataFrame) -> DataFrame:
    """(value, node, n): each text under the rarest of its retained values that others have too.

    Hot values, which one task could not take, are looked up in a table sent to
    all tasks; the others meet their counts in a join.
    """
    entries = sketches.select("node", "n_shingles", "need", F.size("retained").alias("s"), F.explode("retained").alias("value"))
    often = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    total = sketches.agg(F.sum(F.size("retained").cast("long"))).first()[0] or 0
    hot = often.where(F.col("df") > max(1000, total // HOT_SHARE)).withColumnRenamed("df", "hot_df")
    marked = entries.join(F.broadcast(hot), "value", "left")
    cold = marked.where("hot_df IS NULL").drop("hot_df").join(often, "value")
    met = cold.unionByName(marked.where("hot_df IS NOT NULL").withColumnRenamed("hot_df", "df"))
    ranked = met.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("need").alias("need"), F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("had"))
    # values of a text alone come first in its order and are in no list
    length = F.col("s") - F.col("need") + 1 - (F.col("s") - F.size("had"))
    return ranked.where(length > 0).select("node", "n", F.explode(F.slice("had", F.lit(1), length)).alias("x")).select(F.col("x.value").alias("value"), "node", "n")


def with_lengths(lists: DataFrame, by: list[str]) -> DataFrame:
    """The rows of lists of two or more, with their list's length and least node."""
    return lists.join(lists.groupBy(*by).agg(F.count("*").alias("m"), F.min("node").alias("head")).where("m > 1"), by)


def size_band(percent: int) -> Column:
    """The band of sizes that ``n`` lies in; sizes that allow the likeness lie in one or in neighbours."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) - 1e-9) if percent < 100 else F.col("n")


def in_bands(lists: DataFrame, percent: int) -> DataFrame:
    """The rows under two bands of sizes each, so that two sizes (n) that allow the likeness share one."""
    band = size_band(percent)
    return lists.withColumn("band", F.explode(F.array(band, band + 1)))


def band_lengths(lists: DataFrame, percent: int) -> DataFrame:
    """(value, own, within): for the rows of a list whose size is in band ``own``, both bands they are under, with length and least node.

    Counted from one row a list and band, so a list of very many rows is not dealt out by band.
    """
    sizes = lists.groupBy("value", "own").agg(F.count("*").alias("rows"), F.min("node").alias("least"), F.min("n").alias("n"))
    band = Window.partitionBy("value", "band")
    both = in_bands(sizes, percent).select("value", "own", F.struct("band", F.sum("rows").over(band).alias("m"), F.min("least").over(band).alias("head")).alias("of"))
    return both.groupBy("value", "own").agg(F.collect_list("of").alias("within"))


def by_length(lists: DataFrame, percent: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (value, band, node, n, head) of lists that are short, or are in their band; (node, heads): least nodes of the bands of lists that are long there.

    A row of a long list meets the lengths of both its bands at once.  They are sent to all tasks while they
    are few, so that rows of a value stay where they are.
    """
    whole = scratch.keep(with_lengths(lists, ["value"]), name)
    short = whole.where(F.col("m") <= SHORT_LIST).select("value", F.lit(0).cast("long").alias("band"), "node", "n", "head")
    long = whole.where(F.col("m") > SHORT_LIST).select("value", size_band(percent).alias("own"), "node", "n")
    lengths = scratch.keep(band_lengths(long, percent), f"{name}-lengths")
    banded = scratch.keep(long.join(F.broadcast(lengths) if lengths.count() <= MOST_SENT_IDS else lengths, ["value", "own"]), f"{name}-banded")
    few = banded.select("value", "node", "n", F.explode(F.filter("within", lambda b: (b["m"] > 1) & (b["m"] <= SHORT_LIST))).alias("b"))
    heads = F.array_distinct(F.transform(F.filter("within", lambda b: b["m"] > SHORT_LIST), lambda b: b["head"]))
    return short.unionByName(few.select("value", "b.band", "node", "n", "b.head")), banded.select("node", heads.alias("heads")).where(F.size("heads") > 0).distinct()


def likely_pairs(lists: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): pairs in short lists whose sizes allow the likeness and whose union sketch shows it."""
    members = lists.groupBy("value", "band").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("m"))
    one = members.select("m", F.posexplode("m").alias("at", "a")).select("a", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("b"))
    fits = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    pairs = one.where(fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    of = lambda x: sketches.select(F.col("node").alias(x), F.col("retained").alias(f"{x}_kept"), F.col("need").alias(f"{x}_need"))
    pairs = pairs.join(of("u"), "u").join(of("v"), "v")
    union = F.slice(F.array_sort(F.array_union("u_kept", "v_kept")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("u_kept", "v_kept"), union))
    return pairs.where(shared >= F.greatest("u_need", "v_need")).select("u", "v")


def search_block(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning edges (smaller id, other) of the exact links among these sets.

    A text's set is marked once and all texts not reached yet are counted
    against the marks, so the links of a group of m texts cost m passes over
    what is left, not m*m/2 pairs.
    """
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    left = np.argsort(n, kind="stable")
    edges = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            # sizes of linked sets differ by the factor at most; `left` is ordered by size
            lo = np.searchsorted(n[left], -(-n[i] * percent // 100))
            hi = np.searchsorted(n[left], n[i] * 100 // percent, side="right")
            near = left[lo:hi]
            if not len(near):
                continue
            mine = flat[at[i] : at[i + 1]]
            mark[mine] = 1
            starts = np.concatenate([[0], np.cumsum(n[near])])
            where = np.arange(starts[-1]) + np.repeat(at[near] - starts[:-1], n[near])
            both = np.add.reduceat(mark[flat[where]], starts[:-1])
            mark[mine] = 0
            hit = both * 100 >= percent * (n[i] + n[near] - both)
            if hit.any():
                found = near[hit]
                edges += [(int(ids[i]), int(ids[j])) for j in found]
                queue += list(found)
                gone = np.zeros(len(left), bool)
                gone[lo:hi] = hit
                left = left[~gone]
    return edges


def exact_links(docs: DataFrame, blocks: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): spanning edges of the links inside each block (node, block, id, set_hi, set_lo), on full shingle sets."""
    n = blocks.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(blocks) if n <= MOST_SENT_IDS else blocks, "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(4), shingle_words))
            # a text of the class's id may be of another class
            names = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            own = (names[:, 0] == batch.column(2).to_numpy()) & (names[:, 1] == batch.column(3).to_numpy())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "block", "n", "shingles"])
            yield out.filter(pa.array(own))

    found = texts.select("node", "block", "set_hi", "set_lo", "text").mapInArrow(tidy(each), "node long, block long, n long, shingles binary")
    sets = scratch.keep(found.dropDuplicates(["node"]), "sets")
    sized = sets.groupBy("block").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("m > 1")
    chunk = F.least(F.greatest((F.col("total") / 8).cast("long"), F.lit(ONE_TASK)), F.lit(MOST_CHUNK))
    sized = sized.select("block", F.when(F.col("total") <= ONE_TASK, 1).otherwise(F.greatest(F.lit(3), F.ceil(F.col("total") / chunk))).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # there are no more blocks than texts in them
    dealt = sets.join(F.broadcast(sized) if n <= MOST_SENT_IDS else sized, "block").withColumn("mine", mine)
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("mine")))
    dealt = dealt.select("block", F.explode(others).alias("other"), "mine", "node", "shingles").select("block", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "shingles")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        found = search_block(pdf["node"].to_numpy(), [np.frombuffer(b, np.uint64) for b in pdf["shingles"]], percent)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return dealt.groupBy("block", "i", "j").applyInPandas(search, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_hi, set_lo): the near-duplicate group of every row of ``docs``.

    set_hi and set_lo name a row's set; they are null where it has none.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| on their sets
    of ``shingle_words``-word shingles; component_id is the smallest id reachable
    over links, and kept says that the row has that id.  Ids are of any type that
    has an order.

    * Null, empty and wordless texts: n_shingles 0, a group of their own.
    * A null id: component_id null, kept true; the row links with nothing.
    * Repeated rows have the same component; each is kept if it has its id.
    * Rows of one id with different texts are documents of their own: each has the
      links of its text, and may be in a group of its own.
    * An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    prepare_workers(spark)
    scratch = Scratch(spark)
    all_rows = scratch.keep(sketch(docs, id_col, text_col, shingle_words, k, percent), "sketches")
    linked = all_rows.where("n_shingles > 0 AND id IS NOT NULL")
    # numbers rise with the smallest id of a class, so the least of a group has the group's smallest
    least = scratch.keep(linked.groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep")), "least")
    parts = max(1, least.count() // ROWS_OF_A_FILE)
    ordered = least.repartitionByRange(parts, "rep", "set_hi", "set_lo").sortWithinPartitions("rep", "set_hi", "set_lo")
    classes = scratch.keep(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")
    one = linked.join(classes.withColumnRenamed("rep", "id"), ["set_hi", "set_lo", "id"]).dropDuplicates(["node"])
    one = scratch.keep(one.select("node", "n_shingles", "need", "retained", "parts"), "reps")
    agreed, crowded = by_length(one.select(F.explode("parts").alias("value"), "node", F.col("n_shingles").alias("n")), percent, scratch, "agreed")
    # two linked texts that meet in no short list are both in long ones, or are both small
    rest = one.where(F.col("n_shingles") <= k).unionByName(one.where(F.col("n_shingles") > k).join(crowded.select("node").distinct(), "node", "left_semi"))
    rest = scratch.keep((rest if part_depth(percent) else one).drop("parts"), "rest")
    short, long = by_length(scratch.keep(listed(rest), "lists"), percent, scratch, "valued")
    pairs = likely_pairs(agreed.unionByName(short), one, k, percent)
    hot = long.select(F.explode("heads").alias("u"), F.col("node").alias("v")).distinct()
    blocks = connected_components(pairs.unionByName(hot), scratch, "blocks").select("node", F.col("component").alias("block"))
    blocks = scratch.keep(blocks.join(classes.withColumnRenamed("rep", "id"), "node"), "block-of")
    edges = exact_links(docs, blocks, id_col, text_col, shingle_words, percent, scratch)
    groups = scratch.keep(connected_components(edges, scratch, "groups"), "group-of")
    scratch.drop("least", "reps", "agreed", "agreed-lengths", "agreed-banded", "rest", "lists", "valued", "valued-lengths", "valued-banded", "block-of", "sets")
    # class -> group and its smallest id, then rows -> class
    heads = groups.join(classes.select(F.col("node").alias("component"), F.col("rep").alias("of_group")), "component").select("node", "of_group")
    named = classes.join(heads, "node", "left").select("set_hi", "set_lo", F.coalesce("of_group", "rep").alias("component"))
    rows = all_rows.select("id", "n_shingles", *(F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("set_hi", "set_lo")))
    with_set = rows.where("set_hi IS NOT NULL").join(named, ["set_hi", "set_lo"], "left")
    alone = rows.where("set_hi IS NULL").withColumn("component", F.col("id"))
    out = with_set.unionByName(alone, allowMissingColumns=True)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"), "set_hi", "set_lo")


def one_of_each_group(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each near-duplicate group does: that of its smallest id.

    Rows without an id stay.  Rows of one id go by their own texts: of those with
    one set (or, without words, one text) one stays if its group has no smaller id.
    """
    scratch = Scratch(spark)
    groups = scratch.keep(near_duplicates(spark, docs, id_col, text_col, shingle_words, percent), "of-rows").where("doc_id IS NOT NULL").withColumnRenamed("doc_id", id_col)
    again = scratch.keep(groups.groupBy(id_col).count().where("count > 1").select(id_col), "again")
    gone = groups.where("NOT kept").select(id_col)
    out = docs.join(F.broadcast(gone) if gone.count() <= MOST_SENT_IDS else gone, id_col, "left_anti").select(*(f"`{c}`" for c in docs.columns))
    if again.isEmpty():
        return out
    rows = docs.join(again, id_col, "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0).field(text_col).cast(pa.large_string()), shingle_words))
            names = [np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1))], names=["row", "set_hi", "set_lo"])

    schema = T.StructType([rows.schema["row"], T.StructField("set_hi", T.LongType()), T.StructField("set_lo", T.LongType())])
    named = rows.mapInArrow(tidy(each), schema).select("*", F.col("row")[id_col].alias("id"), F.when(F.col("set_hi").isNull(), F.col("row")[text_col]).alias("wordless"))
    stay = groups.where("kept").select(F.col(id_col).alias("k"), F.col("set_hi").alias("hi"), F.col("set_lo").alias("lo")).distinct()
    met = named.join(stay, (F.col("id") == F.col("k")) & F.col("set_hi").eqNullSafe(F.col("hi")) & F.col("set_lo").eqNullSafe(F.col("lo")), "left_semi")
    return out.join(again, id_col, "left_anti").select(*(f"`{c}`" for c in docs.columns)).unionByName(met.dropDuplicates(["id", "set_hi", "set_lo", "wordless"]).select("row.*"))
