"""Joins of works by like titles, without comparing all with all.

Two titles whose Ratcliff-Obershelp ratio is t or more can be made from one another
by inserting and deleting (1 - t) of their letters, so they are of like length and
share a number of runs of q letters that follows from their lengths.  Each title
therefore keeps so many of its rarest runs that a like one must have one of them among
its own; titles are joined on these, and only what meets there is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.metadata import title_key

#: Letters of a run, the longest that still binds.
LONGEST_RUN = 3


def title_keys(title: Column) -> Column:
    """``title_key`` by Arrow batches; null for null."""
    return F.pandas_udf(lambda t: t.map(lambda x: None if x is None else title_key(x)), "string")(title)


def run_length(least: float) -> int:
    """Letters of the runs that titles of this likeness surely share."""
    return next(q for q in range(LONGEST_RUN, 0, -1) if q == 1 or 1 - 2 * q * (1 - least) >= 0.2)


def shortest(least: float, q: int) -> int:
    """The length from which on a title shares a run of q letters with each like one."""
    return math.ceil(q / (1 - 2 * q * (1 - least)) - 1e-9)


def _rarest_runs(keys: DataFrame, least: float, q: int, low: int, high: int | None) -> DataFrame:
    """(side, key, n, gram, nth): of each title of ``low`` to ``high`` letters its rarest runs, as many as it may not share and one."""
    some = keys.where((F.col("n") >= low) & (F.col("n") <= high if high is not None else F.lit(True)))
    runs = some.select("side", "key", "n", F.explode(F.regexp_extract_all("key", F.lit("(?s)(?=(" + "." * q + "))"), F.lit(1))).alias("gram"))
    # a run that a title has twice counts twice
    counted = runs.groupBy("side", "key", "n", "gram").agg(F.count("*").alias("times"))
    numbered = counted.select("side", "key", "n", "gram", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    often = numbered.groupBy("gram", "nth").agg(F.count("*").alias("often"))
    shared = F.ceil(F.col("n") * (1 - 2 * q * (1 - least)) - (q - 1) - F.lit(1e-9))
    place = F.row_number().over(W.partitionBy("side", "key").orderBy("often", "gram", "nth"))
    return numbered.join(often, ["gram", "nth"]).withColumn("place", place).where(F.col("place") <= F.col("n") - (q - 1) - F.greatest(shared, F.lit(1)) + 1).drop("often", "place")


def like_titles(left: DataFrame, right: DataFrame, least: float = 0.9) -> DataFrame:
    """(left_key, right_key, likeness): all pairs of keys of two frames (``key``) whose ratio is ``least`` or more.

    Keys are compared once, however many rows have them; empty and null keys are like
    nothing.  ``least`` is over 0.75, below which likeness doesn't bind what is shared.
    """
    if not 0.75 < least <= 1:
        raise ValueError("least must be over 0.75, and 1 at most")
    side = lambda df, name: df.select("key").where("key <> ''").distinct().select(F.lit(name).alias("side"), "key", F.length("key").alias("n"))
    keys = side(left, "left").unionAll(side(right, "right"))
    q = run_length(least)
    first = shortest(least, q)
    reach = (2 - least) / least  # how much longer a like title may be
    runs = _rarest_runs(keys, least, q, first, None)
    if q > 1:  # shorter titles, and those that may be like one, by single letters
        runs = runs.unionByName(_rarest_runs(keys, least, 1, 1, math.floor((first - 1) * reach + 1e-9)))
    of = lambda name: runs.where(F.col("side") == name).select("gram", "nth", F.col("key").alias(f"{name}_key"), F.col("n").alias(f"{name}_n"))
    near = (F.col("left_n") <= F.col("right_n") * reach + 1e-9) & (F.col("right_n") <= F.col("left_n") * reach + 1e-9)
    met = of("left").join(of("right"), ["gram", "nth"]).where(near).select("left_key", "right_key").distinct()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ratios = []
            for a, b in zip(frame["left_key"], frame["right_key"], strict=True):
                m = SequenceMatcher(None, a, b)
                ratios.append(m.ratio() if m.quick_ratio() >= least else 0.0)
            yield frame.assign(likeness=ratios)

    return met.mapInPandas(each, "left_key string, right_key string, likeness double").where(F.col("likeness") >= least)


def join_works(left: DataFrame, right: DataFrame, least: float = 0.9, title_col: str = "title", year_col: str = "year") -> DataFrame:
    """(left, right, likeness): all pairs of rows, as structs, with like titles whose years differ by one at most.

    An unknown year doesn't speak against a pair; rows without a title are in none.
    Repeated rows each have their pairs.
    """
    named = lambda df, name: df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name), title_keys(F.col(f"`{title_col}`")).alias("key"), F.col(f"`{year_col}`").cast("int").alias(f"{name}_year")).where("key <> ''")
    a, b = named(left, "left"), named(right, "right")
    pairs = like_titles(a, b, least)
    rows = pairs.join(a.withColumnRenamed("key", "left_key"), "left_key").join(b.withColumnRenamed("key", "right_key"), "right_key")
    return rows.where(F.coalesce(F.abs(F.col("left_year") - F.col("right_year")) <= 1, F.lit(True))).select("left", "right", "likeness")
