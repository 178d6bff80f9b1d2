"""The store: sets, manifests, and runs that break off."""

import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern import store as module
from lectern.errors import KbExists, KbNotFound
from lectern.store import Store


@pytest.fixture
def store(spark, tmp_path):
    held = Store(spark, f"{tmp_path}/root")
    held.create("k", {"name": "k"})
    return held


def texts(store, **of):
    return store.spark.createDataFrame(list(of.items()), schemas.DOC_TEXT)


def held(store):
    return {r.doc_id: r.full_text for r in store.read("k", "doc_text").collect()}


def test_upserts_and_removals(store):
    assert held(store) == {}
    store.publish("k", {"doc_text": texts(store, a="1", b="2")})
    store.publish("k", {"doc_text": texts(store, b="3", c="4")})
    assert held(store) == {"a": "1", "b": "3", "c": "4"}
    store.publish("k", removed={"doc_text": texts(store, a="").select("doc_id")})
    assert held(store) == {"b": "3", "c": "4"}
    store.publish("k", {"doc_text": texts(store, a="5")})
    store.publish("k", {"doc_text": texts(store, a="5")})
    assert held(store) == {"a": "5", "b": "3", "c": "4"}


def test_adding_one_document_leaves_the_rest_as_written(store):
    store.publish("k", {"doc_text": texts(store, **{f"d{i}": "x" for i in range(50)})})
    before = store.manifest("k")["tables"]["doc_text"]["rows"]
    store.publish("k", {"doc_text": texts(store, new="y")})
    after = store.manifest("k")["tables"]["doc_text"]
    assert after["rows"][:-1] == before and after["gone"] == []
    path = store._path("k", "doc_text", after["rows"][-1]["id"])
    assert store.spark.read.schema(schemas.DOC_TEXT).parquet(path).count() == 1


def test_full_levels_become_one_set_of_the_next(store, monkeypatch):
    """Rows are written once a level, which are as many as the logarithm of the publishes."""
    monkeypatch.setattr(Store, "FAN", 3)
    want, n = {}, 28
    for i in range(n):
        new = {f"d{i % 11}": str(i), f"e{i}": "x"}
        gone = [f"e{i - 4}"] if i % 5 == 4 else []
        store.publish("k", {"doc_text": texts(store, **new)}, {"doc_text": texts(store, **dict.fromkeys(gone, "")).select("doc_id")} if gone else {})
        want |= new
        for g in gone:
            del want[g]
        now = store.manifest("k")["tables"]["doc_text"]
        assert all(sum(s["level"] == level for s in now[kind]) < 3 for kind in ("rows", "gone") for level in range(9))
        if i % 6 == 5:
            assert held(store) == want
    assert held(store) == want
    assert now["written"] <= 2 * n * (1 + math.log(n, 3)) and max(s["level"] for s in now["rows"]) == 3


def test_publishing_looks_into_sets_that_may_hold_a_key_only(store, monkeypatch):
    looked = []
    live = store._live
    monkeypatch.setattr(store, "_live", lambda kb, table, held, sets: looked.append([s["low"] for s in sets]) or live(kb, table, held, sets))
    for start in "bdf":
        store.publish("k", {"doc_text": texts(store, **{f"{start}{i}": "x" for i in range(5)})})
    assert looked == []
    store.publish("k", {"doc_text": texts(store, d3="y", d9="z")})
    assert looked == [["d0"]]
    monkeypatch.setattr(module, "MOST_LISTED", 1)  # keys are joined
    store.publish("k", {"doc_text": texts(store, b1="y", b9="z")})
    assert looked[1:] == [["b0"]]
    assert held(store) == {f"{s}{i}": "x" for s in "bdf" for i in range(5)} | {"d3": "y", "d9": "z", "b1": "y", "b9": "z"}


def test_point_reads_pass_over_files_by_their_filters(store):
    rows = store.spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("doc_id"), F.repeat(F.lit("x"), F.lit(50)).alias("full_text"))
    for i in range(2):
        store.publish("k", {"doc_text": rows.where(F.crc32("doc_id") % 2 == i)})
    key = rows.orderBy("doc_id").offset(20_000).first().doc_id
    assert store.read("k", "doc_text").where(F.col("doc_id") == key).count() == 1
    missing = "7" + key[1:-1] + "!"
    for k, most in ((key, 20_000), (missing, 0)):
        df = store.read("k", "doc_text").where(F.col("doc_id") == k)
        df.collect()
        assert rows_read(df) <= most


def test_of_two_creators_one_creates(spark, tmp_path):
    stores = [Store(spark, f"{tmp_path}/many") for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        outcomes = list(pool.map(lambda s: type(try_create(s)), stores))
    assert outcomes.count(type(None)) == 1 and outcomes.count(KbExists) == 5
    assert spark.sparkContext._jvm is not None and stores[0].files.files(f"{tmp_path}/many/kbs/k/manifests") == ["000000000000.json"]


def try_create(store):
    try:
        store.create("k", {})
    except Exception as e:
        return e


def rows_read(df):
    """Rows that the scans of an executed frame gave."""
    found, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("fails", ["_write_manifest", "_clean"])
def test_a_run_that_breaks_off_leaves_a_readable_state(store, monkeypatch, fails):
    store.publish("k", {"doc_text": texts(store, a="1")})
    with monkeypatch.context() as m:
        m.setattr(store, fails, lambda *a: (_ for _ in ()).throw(OSError("cut")))
        with pytest.raises(OSError):
            store.publish("k", {"doc_text": texts(store, a="2", b="2")})
    assert held(store) == ({"a": "1"} if fails == "_write_manifest" else {"a": "2", "b": "2"})
    store.publish("k", {"doc_text": texts(store, c="3")})
    assert held(store)["c"] == "3"
    kept = {s["id"] for t in store.manifest("k")["tables"].values() for s in t["rows"] + t["gone"]}
    assert kept <= set(store.files.folders(store._kb("k") + "/doc_text"))


def test_a_reader_keeps_the_state_it_opened(store):
    store.publish("k", {"doc_text": texts(store, a="1")})
    opened = store.read("k", "doc_text")
    store.publish("k", {"doc_text": texts(store, a="2")})
    assert [r.full_text for r in opened.collect()] == ["1"]


def test_creating_twice_and_dropping(store):
    with pytest.raises(KbExists):
        store.create("k", {})
    store.drop("k")
    with pytest.raises(KbNotFound):
        store.manifest("k")
    store.create("k", {})
    assert held(store) == {}
