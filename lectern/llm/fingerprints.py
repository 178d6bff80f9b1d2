"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a set of words weighted by how often it has them.  For each of K
samples every word draws r and c from Gamma(2, 1) and b from the uniform
distribution, all from one hash of the word and the sample's number, so equal
words draw alike in all texts.  With t = floor(ln(weight) / r + b) the word's
value is ln c - r (t - b + 1); the word of the least value, with its t, is the
sample, and as no two words and t share a value, the value stands for it.  Two texts have the same sample with the probability of their
generalised Jaccard similarity, sum of least weights over sum of greatest.  The
likeness read off K samples has a standard deviation of sqrt(p (1 - p) / K):
0.067 at 0.5 and 0.053 at 0.8 with 56.

A text and its edited version share most words: a word of equal weight
in both draws once for both.

Texts are dealt once, by buckets of consecutive ids: everything after that (the
following text by a window, words, weights, samples, likenesses) needs the rows
of one bucket only, so nothing else is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import ascii_lower

SAMPLES = 56
#: Bytes of text of a partition at least and at most, the number of partitions from which on they grow, and buckets of a partition.
LEAST_PARTITION, MOST_PARTITION, PARTITIONS, BUCKETS = 6_000_000, 512_000_000, 65_536, 3


def _uniform(h: Column, first: int, n: int) -> Column:
    """A number inside (0, 1) from n binary digits of a hash."""
    return (F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << n) - 1)).cast("double") + 0.5) / float(1 << n)


def sample_value(word: Column, log_weight: Column, j: int) -> Column:
    """The value whose least over a text's words is the text's sample j."""
    h = F.xxhash64(word, F.lit(j))
    minus_r = F.log(_uniform(h, 0, 13) * _uniform(h, 13, 13))
    log_c = F.log(-F.log(_uniform(h, 26, 13) * _uniform(h, 39, 13)))
    beta = _uniform(h, 52, 12)
    t = F.floor(beta - log_weight / minus_r).cast("double")
    return log_c + minus_r * (t - beta + 1.0)


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; one empty word if it has none."""
    found = F.array_remove(F.split(ascii_lower(text), "[\\x20\\x09-\\x0D]+"), "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def least_values(weighted: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, s0 ...): of words (keys, word hash, weight) the least value of each sample."""
    drawn = weighted.select(*keys, "word", F.log(F.col("weight").cast("double")).alias("log_weight"))
    return drawn.groupBy(*keys).agg(*(F.min(sample_value(F.col("word"), F.col("log_weight"), j)).alias(f"s{j}") for j in range(k)))


def as_samples(k: int, of: str = "s") -> Column:
    """32 digits for each sample; null without any."""
    return F.when(F.col(f"{of}0").isNotNull(), F.array(*(F.xxhash64(F.col(f"{of}{j}")).bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(k))))


def samples(texts: DataFrame, keys: list[str], text_col: str, k: int = SAMPLES) -> DataFrame:
    """(keys, samples): the array of k samples of each text.

    Grouped by ``keys``; where the rows are dealt by some of them, nothing is
    shuffled.  A null text and one without words is one empty word.
    """
    terms = texts.select(*keys, F.explode(words(F.coalesce(F.col(text_col), F.lit("")))).alias("word")).select(*keys, F.xxhash64("word").alias("word"))
    weighted = terms.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("weight"))
    return least_values(weighted, keys, k).select(*keys, as_samples(k).alias("samples"))


def both_samples(texts: DataFrame, keys: list[str], text_col: str, edited_col: str, k: int = SAMPLES) -> DataFrame:
    """(keys, samples, of_edited): like ``samples`` of two versions of each text; a null edited version gives nulls."""
    one = lambda c, edited: F.transform(words(F.col(c)), lambda w: F.struct(F.xxhash64(w).alias("word"), F.lit(edited).alias("edited")))
    every = F.when(F.col(edited_col).isNull(), one(text_col, 0)).otherwise(F.concat(one(text_col, 0), one(edited_col, 1)))
    terms = texts.select(*keys, F.explode(every).alias("w")).select(*keys, F.col("w.word").alias("word"), F.col("w.edited").alias("edited"))
    counted = terms.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.sum("edited").alias("after")).select(*keys, "word", (F.col("n") - F.col("after")).alias("before"), "after")
    # a word of equal weight in both versions draws for both (0), else for the text (1) and the edited one (2)
    of = lambda kind, weight: F.struct(F.lit(kind).alias("kind"), F.col(weight).alias("weight"))
    kinds = F.when(F.col("before") == F.col("after"), F.array(of(0, "before"))).otherwise(F.array(of(1, "before"), of(2, "after")))
    weighted = counted.select(*keys, "word", F.explode(kinds).alias("x")).where("x.weight > 0").select(*keys, "word", F.col("x.kind").alias("kind"), F.col("x.weight").alias("weight"))
    least = least_values(weighted, [*keys, "kind"], k)
    joined = least.groupBy(*keys).agg(*(F.min(F.when(F.col("kind") != other, F.col(f"s{j}"))).alias(f"{name}{j}") for name, other in (("a", 2), ("b", 1)) for j in range(k)))
    return joined.select(*keys, as_samples(k, "a").alias("samples"), as_samples(k, "b").alias("of_edited"))


def likeness(a: Column, b: Column, k: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return reduce(lambda x, y: x + y, ((a[j] == b[j]).cast("int") for j in range(k))).cast("double") / float(k)


def as_text(s: Column, k: int = SAMPLES) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(s[j]), 8, "0") for j in range(k))))


def layout(size: int, partition_bytes: int | None = None) -> tuple[int, int]:
    """(buckets, partitions) for so many bytes of text.

    Partitions hold 6 MB while there are few, then grow with the table to 512 MB
    (what a task sorts and sums spills), so 100 TB are some 200,000 of them.
    """
    held = partition_bytes or min(max(LEAST_PARTITION, size // PARTITIONS), MOST_PARTITION)
    partitions = max(1, math.ceil(size / held))
    return (BUCKETS * partitions if size > held // BUCKETS else 1), partitions


def _bucketed(spark: SparkSession, rows: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, tie, ...) with their number among about n ``bucket``s of descending ids, null ids last.

    Bounds come twice where an id has the rows of more than a bucket: its rows,
    like those without an id, are cut by the hash that orders them.  A row is
    held against the first bounds of runs, then against its own run's, which
    a table of one row a run gives.
    """
    if n < 2:
        return rows.withColumn("bucket", F.lit(0))
    at = [i / n for i in range(1, n)]
    nulls, every, found = rows.agg(F.count_if(F.col("doc_id").isNull()), F.count("*"), F.percentile_approx("doc_id", at, min(1_000_000, 100 * n))).first()
    bounds = sorted(found or [], reverse=True)
    size = max(1, math.ceil(math.sqrt(len(bounds))))
    runs = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    of_nulls = max(1, math.ceil(n * nulls / max(every, 1)))
    # 0 to 1 in the order of descending hashes
    share = F.lit(0.5) - F.col("tie").cast("double") / float(1 << 64)
    cut = lambda m: F.least(F.floor(share * m), F.greatest(m - 1, F.lit(0))).cast("int")
    key = F.col("doc_id")
    if not runs:
        return rows.withColumn("bucket", cut(F.lit(of_nulls)))
    last = F.array(*(F.lit(r[-1]) for r in runs))
    rows = rows.withColumn("run", F.size(F.filter(last, lambda b: b > key)))
    # an id on which runs end may also be in the next ones
    table = spark.createDataFrame([(i, r) for i, r in enumerate(runs)] + [(len(runs), [])], f"run int, held array<{rows.schema['doc_id'].dataType.simpleString()}>")
    rows = rows.join(F.broadcast(table), "run", "left")
    own = F.size(F.filter("held", lambda b: b > key))
    times = {b: bounds.count(b) for i, b in enumerate(bounds[1:]) if b == bounds[i]} if len(set(bounds)) < len(bounds) else {}
    m = F.lit(0)
    if times:
        often = spark.createDataFrame(list(times.items()), f"often {rows.schema['doc_id'].dataType.simpleString()}, times int")
        rows = rows.join(F.broadcast(often), key == F.col("often"), "left")
        m = F.coalesce("times", F.lit(0))
    above = F.least(F.col("run") * size + own, F.lit(len(bounds)))
    bucket = F.when(key.isNull(), F.lit(len(bounds) + 1) + cut(F.lit(of_nulls))).otherwise(above + F.when(m > 0, cut(m + 1)).otherwise(0))
    return rows.withColumn("bucket", bucket.cast("int")).drop("run", "held", "often", "times")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, partition_bytes: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    In descending order of id (a number) the last third of a text's code points,
    rounded down, is replaced by as many first ones of the next text, or all it
    has (after the last comes the first).  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (the likeness to
    the edited text and to the next one).

    * Null texts are empty; the fingerprint of a text without words is that of an
      empty word.  White space at a text's ends makes no word.
    * A null id comes last; rows of one id follow one another by a hash of the text.
    * Repeated rows are documents of their own, next to each other.
    * An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    n_buckets, n_partitions = layout(size, partition_bytes)
    rows = _bucketed(spark, rows, n_buckets)
    # the first document of a bucket is also the ghost at the end of the one before
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")
    heads = sorted((r["bucket"], r["h"]["doc_id"], r["h"]["tie"]) for r in rows.groupBy("bucket").agg(F.max(order).alias("h")).select("bucket", "h").collect())
    known = [(heads[i - 1][0], b, d, t) for i, (b, d, t) in enumerate(heads)]
    ghosts = spark.createDataFrame(known, f"before int, b int, d {rows.schema['doc_id'].dataType.simpleString()}, t long")
    is_head = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    rows = rows.join(F.broadcast(ghosts), is_head, "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("at"), F.lit(True).alias("ghost"))))
    rows = rows.select("doc_id", "tie", "text", F.explode(places).alias("p")).select(F.col("p.at").alias("bucket"), F.col("p.ghost").alias("ghost"), "doc_id", "tie", "text")
    rows = rows.repartition(n_partitions, "bucket")
    down = W.partitionBy("bucket").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    rows = rows.withColumn("row", F.row_number().over(down)).withColumn("next", F.lead("text").over(down)).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next", F.lit(1), third))
    versions = rows.select("bucket", "row", "text", F.when(~F.col("ghost"), edited).alias("edited"))
    found = both_samples(versions, ["bucket", "row"], "text", "edited", k)
    found = found.withColumn("of_next", F.lead("samples", 1).over(W.partitionBy("bucket").orderBy("row")))
    # the texts' own columns come from the same dealt rows again; only these narrow rows meet in a join
    own = rows.where("NOT ghost").select("bucket", "row", "doc_id", "n_chars", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    found = own.join(found, ["bucket", "row"])
    mine = F.col("samples")
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(mine, k).alias("fingerprint"), as_text(F.col("of_edited"), k).alias("edited_fingerprint"), likeness(mine, F.col("of_edited"), k).alias("near_edited"), likeness(mine, F.col("of_next"), k).alias("near_next"))
