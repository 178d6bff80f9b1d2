"""Joins by like titles against comparing all with all."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.operators import titles
from lectern.operators.metadata import title_key


def made(seed, n=130):
    rng = random.Random(seed)
    words = ["of", "the", "fold", "paper", "lamp", "a", "measure", "ment", "shade", "é", "light", "on", "x", "Mondays"]
    fixed = random.Random(0)  # both tables have titles of the same works
    base = [" ".join(fixed.choice(words) for _ in range(fixed.randint(1, 9))) for _ in range(25)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(t) + 1)
            if rng.random() < 0.5:
                t.insert(at, rng.choice("abx -!"))
            elif t and at < len(t):
                del t[at]
        out.append((i, "".join(t).title() if i % 3 else "".join(t), rng.choice([1999, 2000, 2001, 2003, None])))
    return out + [(900, None, 2000), (901, "", 2000), (902, "!!", None), (903, "x", 2000), (904, "ab", 2000), (905, "abcd efg", None), (905, "abcd efg", None), (906, "abcdefg", 1990), (907, "aaaaaaaaaaaa", 2000), (908, "aaaaaaaaaaa", 2000), (909, "long " * 90, 2001), (910, "long " * 92, 2000)]


@pytest.mark.parametrize("least", [0.8, 0.9, 1.0])
def test_pairs_equal_comparing_all(spark, least):
    a, b = made(1), made(2)
    want = sorted(
        (x[0], y[0]) for x in a for y in b
        if (p := title_key(x[1] or "")) and (q := title_key(y[1] or "")) and SequenceMatcher(None, p, q).ratio() >= least and (x[2] is None or y[2] is None or abs(x[2] - y[2]) <= 1)
    )
    schema = "id int, title string, year int"
    got = titles.join_works(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumn("key", F.lit("clash")), least)
    assert sorted((r.left.id, r.right.id) for r in got.collect()) == want and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_bounds(spark):
    with pytest.raises(ValueError):
        titles.like_titles(None, None, 0.7)
    empty = spark.createDataFrame([], "id int, title string, year int")
    assert titles.join_works(empty, empty).count() == 0
    assert [titles.run_length(t) for t in (0.8, 0.9, 1.0)] == [2, 3, 3] and titles.shortest(0.9, 3) == 8


def test_part_names(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size") % 4).alias("year"))
    changed = p.withColumn("title", F.regexp_replace("title", "[aeiou]$", ""))
    got = {(r.left.id, r.right.id) for r in titles.join_works(p, changed).collect()}
    rows, others = p.collect(), changed.collect()
    assert got == {(x.id, y.id) for x in rows for y in others if SequenceMatcher(None, title_key(x.title), title_key(y.title)).ratio() >= 0.9 and abs(x.year - y.year) <= 1}
