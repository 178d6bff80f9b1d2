import random

import pytest

from lectern.llm import decontaminate as D
from tests.llm.tables import DOCUMENTS, clashing
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def brute(docs, items, window=13):
    out = {}
    for i, t in docs:
        w, hit, ids = toks(t), set(), set()
        for item, text in items:
            v = toks(text)
            if item is None or not v:
                continue
            k = min(window, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def tables(seed=1):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(30)]
    say = lambda n: [rng.choice(v) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(40)] + [(98, None), (97, ""), (None, "w1 w2"), (96, "...!"), (95, " ".join(["w1"] * 20))]
    docs = []
    for i in range(80):
        w = say(rng.choice([0, 5, 30, 200]))
        for _ in range(rng.randint(0, 2)):
            part = toks(items[rng.randrange(40)][1])
            a = rng.randrange(len(part))
            w[len(w) // 2 : len(w) // 2] = part[a : a + rng.choice([11, 12, 13, 14, 30])]
        docs.append((i, rng.choice([" ", ", ", "-"]).join(w).title()))
    return docs + [(200, None), (201, ""), (202, "..."), (203, "w1 " * 60)], items


@pytest.mark.parametrize("piece_words", [D.PIECE_WORDS, 150])
def test_equals_brute_force(spark, piece_words):
    docs, items = tables()
    df = clashing(spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCUMENTS))
    got = D.contaminated_spans(spark, df, spark.createDataFrame(items, "item_id long, text string"), piece_words=piece_words)
    rows = got.select("row.doc_id", "n_words", D.n_hit().alias("n_hit"), "items", "spans", D.contaminated().alias("c")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in rows} == brute(docs, items)
    assert all(r.c == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows)
    assert all(a.end < b.start for r in rows for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated_spans(spark, docs, items).first()["spans"] == []
    assert D.contaminated_spans(spark, docs.limit(0), items).count() == 0


def test_repeated_rows_and_items(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b c"), (7, "b c"), (7, "d"), (8, "b c")], "item_id long, text string")
    for r in D.contaminated_spans(spark, docs, items).collect():
        assert r["items"] == ["7", "8"] and [tuple(s) for s in r.spans] == [(1, 4)]


def test_a_million_equal_words(spark):
    import time

    items = [(i, "the " * 2000) for i in range(50)] + [(50, "the")]
    docs = spark.createDataFrame([(1, "The " * 1_000_000), (2, "other " + "the " * 12)], "doc_id long, text string")
    found = D.contaminated_spans(spark, docs, spark.createDataFrame(items, "item_id long, text string"))
    began = time.time()
    got = {r.row.doc_id: r for r in found.collect()}
    assert time.time() - began < 5
    assert got[1].n_words == 1_000_000 and [tuple(s) for s in got[1].spans] == [(0, 1_000_000)] and len(got[1]["items"]) == 51
    assert [tuple(s) for s in got[2].spans] == [(1, 13)] and got[2]["items"] == ["50"]


def test_windows_share_a_fingerprint():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        span = rng.integers(0, 2**63, 13).astype(np.uint64)
        texts = [np.concatenate([rng.integers(0, 2**63, 20).astype(np.uint64), span, rng.integers(0, 2**63, 20).astype(np.uint64)]) for _ in range(2)]
        kept = [set(D.winnow(t, np.array([0, len(t)]), 8, 13)[2].tolist()) for t in texts]
        assert kept[0] & kept[1]
