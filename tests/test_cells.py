"""The vector index of a base: cells that grow, searches over some of them, bounded candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.operators import cells as C
from lectern.operators import retrieval
from lectern.schemas import POINTS
from lectern.store import Store
from tests.test_store import rows_read

NAMES = [c.split()[0] for c in POINTS.split(", ")]


def points(spark, x, first=0, per_doc=5):
    """Rows of the points table for the vectors of a matrix."""
    rows = [(f"p{first + i:06}", f"d{(first + i) // per_doc}", i % per_doc, f"text {first + i}", 1990 + i % 30, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "point_id string, doc_id string, chunk_index int, content string, year int, embedding array<float>")
    df = df.withColumn("packed", vectors.packed(F.col("embedding"))).withColumn("coarse", vectors.coarse(F.col("packed")))
    kinds = dict(c.split(None, 1) for c in POINTS.split(", "))
    return df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in NAMES))


def clustered(n, dims=24, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dims))
    return (c[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.35).astype(np.float32)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("cells")), cell_points=150)
    store.create("k", {"name": "k"})
    x = clustered(3000)
    x[7] = 0
    for a, b in ((0, 100), (100, 1800), (1800, 3000)):
        store.publish("k", {"points": points(spark, x[a:b], a)})
    return store, x


def searcher(store, of=lambda q: None, **more):
    return retrieval.Searcher(store.read("k", "points"), of, lambda q, texts: [0.5] * len(texts), cells=store.cells("k"), **more)


def test_points_lie_in_the_cell_of_their_nearest_centre(base):
    store, x = base
    cells = store.cells("k")
    assert len(cells.numbers) > 15 and all(cells.counts[n] <= cells.limits[n] <= 4 * 150 for n in cells.numbers) and 0.9 <= cells.recall <= 1 and cells.probes < len(cells.numbers)
    held = store.read("k", "points").select("point_id", "cell").collect()
    assert len(held) == len({r.point_id for r in held}) == 3000
    near = (unit(x[np.arange(len(x)) != 7]) @ cells.centres.T).argmax(axis=1)
    want = dict(zip([f"p{i:06}" for i in range(3000) if i != 7], np.array(cells.numbers)[near], strict=True))
    # a child takes points from its parent alone, so a few at borders lie elsewhere
    assert np.mean([r["cell"] == want[r.point_id] for r in held if r.point_id in want]) > 0.9
    assert {r.point_id for r in held if r["cell"] == C.NOWHERE} == {"p000007"}
    assert sum(cells.counts.values()) == 2999


def test_searches_over_some_cells_find_most_and_read_little(base):
    store, x = base
    u = unit(np.delete(x, 7, axis=0))
    ids = np.array([f"p{i:06}" for i in range(3000) if i != 7])
    found = total = 0
    for q in clustered(12, seed=1)[:12]:
        q = (q + np.random.default_rng(int(abs(q[0]) * 1e6)).normal(size=24) * 0.1).astype(np.float32)
        want = set(ids[np.argsort(-(u @ q))[:50]])
        got = searcher(store, lambda _, q=q: q.tolist()).search("q", 10)
        pool = {i for i, *_ in searcher(store)._pool(q.tolist(), 50, None)}
        every = {i for i, *_ in searcher(store, probes=10_000)._pool(q.tolist(), 50, None)}
        assert every == want and len(got.chunks) == 10
        found, total = found + len(pool & want), total + 50
    assert found / total >= 0.9
    cells = store.cells("k")
    some = store.read("k", "points").where(F.col("cell").isin(cells.near(x[0].tolist())[: cells.probes])).select("coarse")
    some.collect()
    assert rows_read(some) < 3000 * 0.6


def test_filters_that_leave_few_points_look_into_all_cells(base):
    store, x = base
    far = [f"d{i}" for i in range(0, 600, 60)]
    got = searcher(store, lambda q: x[0].tolist(), probes=1).search("q", 50, metadata_filter={"doc_id": far})
    assert len(got.chunks) == 50 and {c["metadata"]["doc_id"] for c in got.chunks} == set(far) and "cell" not in got.chunks[0]["metadata"]


def test_replaced_and_removed_documents_leave_their_cells(spark, tmp_path):
    store = Store(spark, str(tmp_path), cell_points=60)
    store.create("k", {"name": "k"})
    x = clustered(300, groups=6)
    store.publish("k", {"points": points(spark, x)})
    moved = -x[:10]
    store.publish("k", {"points": points(spark, moved)}, {"points": spark.createDataFrame([("d9",)], "doc_id string")})
    rows = {r.point_id: np.array(r.embedding, np.float32) for r in store.read("k", "points").collect()}
    assert len(rows) == 295 and np.allclose(rows["p000003"], moved[3]) and "p000047" not in rows
    top = searcher(store, lambda q: moved[3].tolist()).search("q", 1).chunks[0]
    assert top["metadata"]["point_id"] == "p000003" and top["embed_score"] > 0.999


def test_equal_vectors_are_never_divided_and_never_all_fetched(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), cell_points=100)
    store.create("k", {"name": "k"})
    x = np.repeat(clustered(1), 1500, axis=0)
    store.publish("k", {"points": points(spark, x)})
    cells = store.cells("k")
    assert cells.numbers == [0] and cells.limits[0] >= 3000
    other = clustered(2, seed=9)
    store.publish("k", {"points": points(spark, other, 1500)})
    monkeypatch.setattr(retrieval, "MOST_CANDIDATES", 60)
    monkeypatch.setattr(retrieval.coarse_candidates, "__defaults__", ("point_id", "coarse", 60))
    named, least, all_named = retrieval.coarse_candidates(store.read("k", "points"), x[0].tolist(), 50)
    assert not all_named and len(named) <= 61
    got = searcher(store, lambda q: x[0].tolist()).search("q", 10)
    assert [c["metadata"]["point_id"] for c in got.chunks] == [f"p{i:06}" for i in range(10)]
    near = retrieval.nearest_packed(store.read("k", "points"), x[0].tolist(), 50, most=60).collect()
    assert [r.point_id for r in near] == [f"p{i:06}" for i in range(50)]


def test_a_base_without_points_or_direction(spark, tmp_path):
    store = Store(spark, str(tmp_path), cell_points=10)
    store.create("k", {"name": "k"})
    assert store.cells("k") is None and searcher(store, lambda q: [1.0, 0.0]).search("q").chunks == []
    store.publish("k", {"points": points(spark, np.zeros((30, 4), np.float32))})
    assert searcher(store, lambda q: [1.0, 0.0, 0.0, 0.0]).search("q").chunks == []
    store.publish("k", {"points": points(spark, np.eye(4, dtype=np.float32), 30)})
    assert searcher(store, lambda q: [0.0] * 4).search("q").chunks == []
    assert searcher(store, lambda q: [0.0, 1.0, 0.0, 0.0]).search("q", 1).chunks[0]["metadata"]["point_id"] == "p000031"
