import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import neardup
from lectern.llm.shared import Scratch, connected_components
from tests.llm.tables import DOCUMENTS, clashing, made_documents, words


def brute(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(2, 80), (5, 80), (2, 60)])
def test_equals_brute_force(spark, size, percent):
    rows = made_documents(160)
    got = neardup.near_duplicates(spark, clashing(spark.createDataFrame(rows, DOCUMENTS)), shingle_words=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_spread_copies(spark, monkeypatch):
    """Long lists, several chunks, members that are alike only by way of others."""
    monkeypatch.setattr(neardup, "ONE_TASK", 2000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, 0))
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, DOCUMENTS), shingle_words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (7, text + " more"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(spark, df).collect())
    assert got == [(False, 4, 4, True), (False, 4, 4, True), (False, 7, 4, False), (False, 8, 8, True), (True, 0, None, True), (True, 0, None, True)]
    assert neardup.near_duplicates(spark, df.limit(0)).count() == 0


def test_least_shared_is_exact_for_small_sets():
    assert [neardup.least_shared(n, 64, 80) for n in (1, 5, 50)] == [1, 4, 40]
    assert 25 <= neardup.least_shared(1000, 64, 80) <= 40


def test_search_block_finds_all_links():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(60):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 60 * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    want = {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)}
    edges = neardup.search_block(np.arange(60), sets, 60)
    root = list(range(60))
    for a, b in edges:
        root[find(a)] = find(b)
    assert {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark))
    assert {r.node: r.component for r in got.collect()} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0
    assert got.agg(F.countDistinct("node")).first()[0] == got.count()


def test_nested_pairs_just_over_the_likeness(spark):
    """Isolated pairs, one text an extension of the other, of about 80 to 150 one-word shingles."""
    sizes = [(80, 100), (96, 120), (104, 130), (112, 140), (120, 150)]
    rows = []
    for i in range(4000):
        less, more = sizes[i % len(sizes)]
        w = [f"p{i}w{j}" for j in range(more)]
        rows += [(2 * i, " ".join(w[:less])), (2 * i + 1, " ".join(w))]
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=1)
    assert {r.doc_id for r in got.collect() if r.component_id != r.doc_id // 2 * 2} == set()


def test_one_id_with_two_texts(spark):
    """Rows are documents of their own: links of either text are found, and no text is lost."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (7, b + " x"), (9, a + " y")], "doc_id long, text string")
    got = neardup.near_duplicates(spark, df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]
    assert sorted(tuple(r) for r in neardup.one_of_each_group(spark, df).collect()) == sorted([(5, a), (5, b)])
    df = spark.createDataFrame([(3, b), (5, b), (5, a), (5, a), (6, None), (6, None), (6, ""), (None, a)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark, df).collect() if r.doc_id in (3, 5)]
    assert sorted(got) == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True)]
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in neardup.one_of_each_group(spark, df).collect()) == key([(3, b), (5, a), (6, None), (6, ""), (None, a)])


def test_ids_of_other_types(spark):
    rows = made_documents(60)
    numbers = brute(rows, 5, 80)
    df = spark.createDataFrame([(f"{i:09}", t) for i, t, *_ in rows], "doc_id string, text string")
    assert {int(r.doc_id): (r.n_shingles, int(r.component_id)) for r in neardup.near_duplicates(spark, df).collect()} == numbers


def test_boilerplate_makes_no_blocks_beyond_bands(spark, monkeypatch):
    """Every text has the same 40 words before 60 to 900 of its own, in groups of three near copies: blocks stay small."""
    monkeypatch.setattr(neardup, "HOT_SHARE", 5)
    seen = []
    real = neardup.exact_links
    monkeypatch.setattr(neardup, "exact_links", lambda docs, blocks, *a: seen.append(blocks.groupBy("block").count().agg(F.max("count")).first()[0]) or real(docs, blocks, *a))
    rng = random.Random(2)
    common = [f"common{i}" for i in range(40)]
    rows = []
    for i in range(600):
        own = [f"o{i}x{j}" for j in range(rng.choice([60, 100, 300, 900]))]
        for k in range(3):
            rows.append((3 * i + k, " ".join(common + own[: len(own) - k])))
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert all(r.component_id == r.doc_id // 3 * 3 for r in got) and seen[0] <= 3


def test_bands_hold_all_sizes_that_allow_the_likeness(spark):
    sizes = list(range(1, 400))
    bands = {}
    for r in neardup.in_bands(spark.createDataFrame([(0, n, n) for n in sizes], "value long, node long, n long"), 80).collect():
        bands.setdefault(r.n, set()).add(r.band)
    assert all(bands[a] & bands[b] for a in sizes for b in sizes if a <= b and 100 * a >= 80 * b)


def test_common_shingles_make_no_blocks(spark, monkeypatch):
    """Texts of so few words that every shingle is in a sixth of them, not alike: they aren't searched all with all."""
    seen = []
    real = neardup.exact_links
    monkeypatch.setattr(neardup, "exact_links", lambda docs, blocks, *a: seen.append(blocks.groupBy("block").count().agg(F.max("count")).first()[0]) or real(docs, blocks, *a))
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(300))) for i in range(800)]
    rows += [(800 + i, f"{rows[i][1]} w1 w2 w3") for i in range(10)]
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 800 if i >= 800 else i for i in range(810)}
    assert seen == [2]


def test_part_numbers():
    """Equal exactly where the least members of a part are, and two sets of likeness 0.8 agree in some."""
    rng = np.random.default_rng(3)
    depth = neardup.part_depth(80)
    assert depth == 4 and neardup.part_depth(20) == 0
    for n in (52, 300, 5000):
        for _ in range(30):
            both = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            a, b = np.sort(rng.permutation(both)[: n * 9 // 10]), both
            parts = lambda s: {int(p): s[neardup.mix(s) >> np.uint64(59) == p][:depth].tolist() for p in np.unique(neardup.mix(s) >> np.uint64(59))}
            x, y = parts(a), parts(b)
            same = sum(x.get(p) == y[p] for p in y)
            got = np.intersect1d(neardup.part_numbers(a, depth), neardup.part_numbers(b, depth))
            assert len(neardup.part_numbers(a, depth)) == len(x) and len(got) == same > 0


def near_copies(n):
    """Texts made of one by words put in other words' places and words left out at the end: near copies of several sizes."""
    rng = random.Random(n)
    rows = []
    for i in range(n):
        w = [f"w{j}" for j in range(rng.randint(150, 200))]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, 0))
    return rows


def test_rows_of_long_lists_are_met_once(spark, monkeypatch):
    """A row of a long list makes one row where it meets the lengths of its bands, whatever the size of the group."""
    made = {}
    keep = Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    rows = near_copies(300)
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, DOCUMENTS), shingle_words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)
    assert 0 < made["agreed-banded"] <= made["agreed"] and 0 < made["valued-banded"] <= made["valued"]


@pytest.mark.parametrize("percent", [60, 80, 100])
@pytest.mark.parametrize("most_sent", [0, neardup.MOST_SENT_IDS])
def test_lengths_of_bands(spark, monkeypatch, percent, most_sent):
    """Lists, their least nodes and those that stay long are as counted plainly, with lengths sent to tasks and without."""
    monkeypatch.setattr(neardup, "MOST_SENT_IDS", most_sent)
    rng = random.Random(5)
    rows = [(v, node, rng.choice([60, 70, 90, 91, 300, rng.randint(52, 400)])) for v, m in enumerate((1, 2, 32, 33, 90, 400)) for node in rng.sample(range(1000), m)]
    short, long = neardup.by_length(spark.createDataFrame(rows, "value long, node long, n long"), percent, Scratch(spark), "some")
    lists, plain = {}, {}
    for v, node, n in rows:
        lists.setdefault(v, []).append((node, n))
    for v, members in lists.items():
        if len(members) <= 32:
            plain[v, 0] = members
            continue
        for node, n in members:
            own = n if percent == 100 else math.floor(math.log(n) / math.log(100 / percent) - 1e-9)
            for band in (own, own + 1):
                plain.setdefault((v, band), []).append((node, n))
    want = {(*at, node, n, min(members)[0]) for at, members in plain.items() if 1 < len(members) <= 32 for node, n in members}
    edges = {(min(members)[0], node) for members in plain.values() if len(members) > 32 for node, _ in members}
    assert edges and sorted((r.value, r.band, r.node, r.n, r.head) for r in short.collect()) == sorted(want)
    assert {(head, r.node) for r in long.collect() for head in r.heads} == edges
