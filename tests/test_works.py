"""Answers of services as VARIANT against the plain parser; windows over blocks against loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import metadata as M
from lectern.operators import works
from lectern.operators.segments import Blocks, with_context

WORK = {"DOI": "10.1/a", "title": ["A  title\n", "other"], "author": [{"given": "Ann", "family": "Ek"}, {"family": "Bo"}, {"name": "x"}, " Cy ", "", 5, None], "container-title": ["J"], "abstract": " <b>x</b> ", "subject": ["a", 7, None, "b"], "published-online": {"date-parts": [[2003, 1]]}, "issued": {"date-parts": [[1999]]}}
ODD = [
    WORK, {**WORK, "title": "as text", "container-title": "K"}, {**WORK, "title": [], "author": [], "subject": None}, {**WORK, "title": {"a": 1}, "author": {"given": "x"}}, {**WORK, "published-online": {"date-parts": []}},
    {**WORK, "published-online": {"date-parts": [["2003"]]}}, {**WORK, "published-online": 3, "issued": None}, {**WORK, "published-online": {"date-parts": [[None]]}}, {"title": [None]}, {"title": ["é\t x"]}, {"abstract": 3, "DOI": ["x"]}, {}, [], 7, "text", None,
]


def test_fields_are_those_of_the_plain_parser_without_python(spark):
    bodies = [json.dumps(x) for x in ODD] + ["", "[no json", "{", '{"title": "a"', None]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "doi string, message string")
    got = M.parse_works(df, "doi", "message", "work")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    for r in got.collect():
        want = M.guarded(M.parse_work, lambda: M.parse_work(None))(bodies[int(r.key)])
        clean = lambda v: M.squeeze(v) or None
        title = "" if want["title"] == "None" else M.squeeze(want["title"])  # a list whose first value is null has no title
        assert (r.title or "", r.year, r.journal, r.doi, r.authors, r.abstract, r.keywords) == (title, want["year"], clean(want["journal"]), clean(want["doi"]), want["authors"], clean(want["abstract"]), want["keywords"]), bodies[int(r.key)]


def test_windows_over_blocks_equal_loops(spark):
    rng = random.Random(4)
    docs = {d: [(i, rng.choice("AABC") if rng.random() > 0.1 else None, rng.random() < 0.3, f"text {d} {i}") for i in range(rng.randint(1, 25))] for d in range(12)}
    df = spark.createDataFrame([(d, *b) for d, bs in docs.items() for b in bs], "doc int, idx int, section string, heading boolean, text string")
    out = with_context(df.repartition(5), Blocks(("doc",), "idx"), F.col("heading"), F.col("section"), F.col("text"), ~F.col("heading"), ahead=5, most=2, letters=8)
    got = {(r.doc, r.idx): r for r in out.collect()}
    assert len(got) == sum(map(len, docs.values())) and out.columns == [*df.columns, "anchor", "segment", "previous_section", "next_section", "body_sample"]
    for d, bs in docs.items():
        for i, section, _, _ in bs:
            r = got[d, i]
            assert r.anchor == next((j for j, _, h, _ in reversed(bs[:i]) if h), None) and r.segment == sum(h for _, _, h, _ in bs[: i + 1])
            assert r.previous_section == next((s for _, s, _, _ in reversed(bs[:i]) if s != section), None)
            assert r.next_section == next((s for _, s, _, _ in bs[i + 1 :] if s != section), None)
            stop = next((j for j, _, h, _ in bs[i + 1 :] if h), len(bs))
            assert r.body_sample == [t[:8] for j, _, h, t in bs[i + 1 : min(stop, i + 6)]][:2]


@pytest.mark.parametrize("value", [None, "x"])
def test_runs_take_nulls_as_equal(spark, value):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([value, value, "y", None, None])], "doc int, idx int, v string")
    blocks = Blocks(("doc",), "idx")
    assert [r.n for r in df.select("idx", blocks.run(F.col("v")).alias("n")).orderBy("idx").collect()] == [1, 1, 2, 3, 3]


def test_fields_alone(spark):
    df = spark.createDataFrame([('{"title": "x"}',)], "b string")
    assert df.select(works.fields(F.col("b"))["title"].alias("t")).first().t == "x"
