"""Full-text search by the trigram index against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import grams
from lectern.schemas import TABLES
from lectern.store import Store
from tests.test_store import rows_read

def fields():
    return [F.col("title"), F.col("abstract"), F.array_join(F.col("keywords"), " ")]

BITS = ["ab", "ra", "ca", "dabra", " ", "ABRA", "字季漢", "漢字", "季", "\U0001f600\U0001f601\U0001f602", "\U0001f600", "\n", "İx", "é", "."]


def made(spark, n=150):
    rng = random.Random(6)
    text = lambda k: "".join(rng.choice(BITS) for _ in range(rng.randint(0, k)))
    rows = [(f"d{i:03}", text(6), text(20) if i % 7 else None, [text(3) for _ in range(i % 3)]) for i in range(n)]
    rows += [("long", "x", "ab" * 9000 + "needle" + "ra" * 9000, []), ("cut", "x", "y" * (grams.PIECE - 2) + "seam" + "y" * 9, None), ("cut", "twice", "seam", []), (None, "no id abra", None, [])]
    return spark.createDataFrame(rows, "doc_id string, title string, abstract string, keywords array<string>").persist()


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    docs = made(spark)
    return docs, grams.build(spark, docs, fields(), str(tmp_path_factory.mktemp("grams") / "index"))


@pytest.mark.parametrize("most", [grams.MOST_NAMED, 2])
def test_searches_equal_the_scan(held, monkeypatch, most):
    docs, index = held
    monkeypatch.setattr(grams, "MOST_NAMED", most)
    monkeypatch.setattr(grams, "MOST_SENT", 40)
    queries = ["abra", "cadabra", "漢字季", "字季漢", "\U0001f600\U0001f601\U0001f602", "abra dabra", "ab", "ab abra", '"', "", None, "needle", "seam", "zzz", "abra zzz", "İx.", "i̇x.", "raab 字季漢", "ABRACA"]
    for q in queries:
        holds = X.fulltext(fields(), q)
        want = docs if holds is None else docs.where(holds)
        got = grams.search(docs, fields(), index, q)
        key = lambda df: sorted(str(tuple(r)) for r in df.where("doc_id IS NOT NULL").collect())
        assert key(got) == key(want), q


def test_few_hits_read_few_rows_and_no_cross_join(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    docs = rows.withColumn("title", F.when(F.col("doc_id") == "777", F.concat("title", F.lit(" zebra"))).otherwise(F.col("title")))
    index = grams.build(spark, docs, [F.col("title")], str(tmp_path / "index"))
    every = index.count()
    found = grams.candidates(index, "zebra")
    assert [r.doc_id for r in found.collect()] == ["777"]
    assert rows_read(found) < every / 4
    plan = grams.search(docs, [F.col("title")], index, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_the_store_keeps_lists_with_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("k", {"name": "k"})
    names = [c.split()[0] for c in TABLES["documents"].schema.split(", ")]
    kinds = dict(c.split(None, 1) for c in TABLES["documents"].schema.split(", "))

    def put(rows, **more):
        docs = spark.createDataFrame(rows, "doc_id string, title string")
        docs = docs.select(*(F.col(n) if n in ("doc_id", "title") else F.lit(None).cast(kinds[n]).alias(n) for n in names))
        store.publish("k", {"documents": docs, "grams": grams.gram_rows(docs, [F.col("title")])}, **more)

    hits = lambda q: sorted(r.doc_id for r in grams.search(store.read("k", "documents"), [F.col("title")], store.read("k", "grams"), q).collect())
    put([("a", "paper folding"), ("b", "paper lamps")])
    assert hits("paper") == ["a", "b"] and hits("fold") == ["a"]
    put([("a", "lamps again"), ("c", "folding again")])
    assert hits("fold") == ["c"] and hits("lamps") == ["a", "b"]
    listed = {(r.gram, r.doc_id) for r in store.read("k", "grams").collect()}
    assert ("fol", "a") not in listed and ("aga", "a") in listed
    gone = spark.createDataFrame([("c",)], "doc_id string")
    store.publish("k", removed={"documents": gone, "grams": gone})
    assert hits("again") == ["a"] and ("fol", "c") not in {(r.gram, r.doc_id) for r in store.read("k", "grams").collect()}
