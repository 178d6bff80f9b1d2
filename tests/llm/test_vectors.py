"""Exact vector codes and clusters against plain ones."""

import hashlib
import math
import random

import numpy as np
import pytest

from lectern.llm import annular_codes, integer_vectors, queries, sort_means

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(n=90, dims=64, seed=3):
    """Clusters, ties, repeated rows and ids, a hot vector, and rows that are to be dropped."""
    rng = random.Random(seed)
    centres = [[rng.choice([-0.5, -0.25, 0.0, 0.125, 0.5]) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [x + rng.choice([0, 0, 0.015625, -0.25, 0.0001]) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(200 + i, centres[0], 1) for i in range(n // 2)] + [rows[3], rows[3], (5, centres[1], 7), (None, centres[2], None), (300, [0.0] * dims, 2), (301, [-900.5] * dims, 2)]
    whole = list(rows)
    bad = [(400, None, 1), (401, [], 1), (402, [None] + [0.5] * (dims - 1), 1), (403, [math.nan] + [0.5] * (dims - 1), 1), (404, [0.5] * (dims - 1) + [-math.inf], 1), (405, [0.5] * (dims - 1), 1), (406, [0.5] * (dims + 1), None)]
    rng.shuffle(rows := rows + bad)
    return rows, whole


def ints(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_round(vectors, centres):
    """(nearest centre, distance) of each vector, ties to the smaller number."""
    return [min((d2(v, c), j) for j, c in enumerate(centres))[::-1] for v in vectors]


def moved(vectors, centres, found):
    out = []
    for j, c in enumerate(centres):
        mine = [v for v, (k, _) in zip(vectors, found) if k == j]
        out.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
    return out


def test_codes_equal_plain_ones(spark):
    rows, whole = odd_vectors(dims=16)
    df = spark.createDataFrame(rows, VECTORS).withColumnsRenamed({"label": "code"}).withColumn("row", F_lit("x"))
    got = annular_codes.compress(spark, df, entries=20)
    rest = sorted(((r[0] is None, r[0] or 0, ints(r[1], 1024)) for r in whole))
    vectors = [v for *_, v in rest]
    codes, errors, books = [""] * len(vectors), [0] * len(vectors), []
    # ids that are equal are in the order of their bytes
    start = sorted(rest, key=lambda r: (r[0], r[1], np.array(r[2], "<i4").tobytes()))[:20]
    for p in range(4):
        part = [v[4 * p : 4 * p + 4] for v in vectors]
        book = [r[2][4 * p : 4 * p + 4] for r in start]
        for _ in range(4):
            book = moved(part, book, plain_round(part, book))
        books.append(book)
        for i, (j, d) in enumerate(plain_round(part, book)):
            codes[i] += f"{j:02x}"
            errors[i] += d
    assert [b.tolist() for b in got.codebooks] == books
    assert got.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = got.vectors.select("row.vec_id", "row.row", "code", "error").collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error) for r in found) == sorted(((a, b), c, e) for (a, b, _), c, e in zip(rest, codes, errors)) and all(r.row == "x" for r in found)


def F_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


@pytest.mark.parametrize("k", [9, 500])
def test_clusters_equal_plain_ones(spark, k):
    rows, whole = odd_vectors()
    got = sort_means.cluster(spark, spark.createDataFrame(rows, VECTORS).withColumnsRenamed({"label": "cluster"}), k=k)
    vectors = [(r[0], ints(r[1], 256)) for r in whole]
    order = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest(), np.array(v[1], "<i4").tobytes()))
    centres = [v for _, v in order][:k]
    for _ in range(5):
        centres = moved([v for _, v in vectors], centres, plain_round([v for _, v in vectors], centres))
    assert got.centroids.tolist() == centres
    want = sorted((str(i), *f) for (i, _), f in zip(vectors, plain_round([v for _, v in vectors], centres)))
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.vectors.select("row.vec_id", "cluster", "distance").collect()) == want
    assert sum(got.inertia.tolist()) == sum(w[2] for w in want) and got.inertia[0] == sum(w[2] for w in want if w[1] == 0)


def test_pruning_loses_nothing_and_saves_distances():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 300
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)) * 12).astype(np.int64)
    x[:200] = x[0]  # ties
    c = np.concatenate([x[::75], x[:3]])
    plain = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    book = annular_codes.Codebook(c)
    index, distance, taken = book.nearest(x)
    assert (index == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all() and taken < plain.size / 2
    for before in (np.zeros(3000, np.int64), plain.argmin(axis=1), rng.integers(0, len(c), 3000)):
        cluster, d, taken = sort_means.assign(x, before, c, *sort_means.orders(c))
        assert (cluster == plain.argmin(axis=1)).all() and (d == plain.min(axis=1)).all()
    cluster, d, taken = sort_means.assign(x, plain.argmin(axis=1), c, *sort_means.orders(c))
    assert taken < plain.size / 2
    # all on one sphere, and integers beyond what doubles hold: the annulus is everything, and results stay exact
    big = rng.choice([-1, 1], (400, 8)).astype(np.int64) * (1 << 26)
    index, distance, _ = annular_codes.Codebook(big[:50]).nearest(big)
    plain = ((big[:, None] - big[None, :50]) ** 2).sum(axis=2)
    assert (index == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_no_vectors_one_vector_and_huge_numbers(spark):
    none = spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], VECTORS)
    for df in (none, none.limit(0)):
        assert annular_codes.compress(spark, df) is None and sort_means.cluster(spark, df) is None
    one = spark.createDataFrame([(1, [0.5] * 6, 1)], VECTORS)
    got = annular_codes.compress(spark, one)  # parts of 2, 2, 1 and 1
    assert got.vectors.first().code == "00000000" and got.vectors.first().error == 0 and [b.shape for b in got.codebooks] == [(1, 2), (1, 2), (1, 1), (1, 1)]
    wide = spark.createDataFrame([(1, [1e30] * 64, 1), (2, [-1e30] * 64, 1), (3, [0.0] * 64, 1)], VECTORS)
    most = integer_vectors.largest_component(64)
    found = sort_means.cluster(spark, wide, k=2)
    assert abs(found.centroids).max() <= most and found.vectors.count() == 3 and found.inertia.sum() > 0
    doubles = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, -0.4])], "vec_id int, embedding array<double>")
    assert sorted(annular_codes.compress(spark, doubles, parts=2).codebooks[0].ravel().tolist()) == [math.floor(102.4), math.floor(307.2)]


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_annular_norm_codes", "op13_sort_means"):
        full = queries.QUERIES[name](spark, SF)
        empty = queries.QUERIES[name](spark, str(tmp_path))
        assert empty.count() == 0 and full.dtypes == empty.dtypes and full.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_many_labels_are_joined(spark, monkeypatch):
    few = {r.vec_id: r.label_error for r in queries.op11_annular_norm_codes(spark, SF).collect()}
    monkeypatch.setattr(queries, "MOST_SENT_LABELS", 0)
    assert {r.vec_id: r.label_error for r in queries.op11_annular_norm_codes(spark, SF).collect()} == few
