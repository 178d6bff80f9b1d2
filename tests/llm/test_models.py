"""Language ID, n-gram scores, token counts, mixing."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import arrays, language, mixing, ngrams, tokens
from lectern.llm.shared import Scratch, crc_mod
from tests.llm.tables import DOCUMENTS, clashing, made_documents, words

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = language.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    got = language.identify(clashing(docs), network).select("row.doc_id", "row.lang", "lang_pred", "row.score", F.col("score").alias("p")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(r.score == "x" and 0 <= r.p <= 1 for r in got)
    german = " ".join(r.text for r in docs.where("lang = 'de'").limit(20).collect())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... \n"), (4, german * 4), (5, "Ω")], "doc_id int, text string")
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, network).select("row.doc_id", "lang_pred", "score").collect()}
    assert said[1] == said[2] == said[3] == ("und", 0.0) and said[4][0] == "de" and said[5][0] in network.labels
    again = language.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    assert np.array_equal(again.filters, network.filters)


def plain_language(network, text):
    """(label, score) by loops: windows of the lower-cased bytes, each filter's largest response, softmax, mean by bytes."""
    data = (text or "").lower().encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = np.zeros(len(network.labels))
    for start in range(0, len(data), language.WINDOW):
        window = data[start : start + language.WINDOW]
        wide = max(language.WIDTHS)
        codes = list(window) + [0] * (language.WINDOW - len(window) + wide - 1)
        rows = [network.embed[c] for c in codes]
        hidden = []
        for f in range(network.filters.shape[1]):
            w = language.WIDTHS[f // language.FILTERS]
            kernel = network.filters[: w * language.EMBED, f].reshape(w, language.EMBED)
            best = max(sum(float(rows[at + i] @ kernel[i]) for i in range(w)) for at in range(language.WINDOW))
            hidden.append(max(best + float(network.bias[f]), 0.0))
        z = np.array(hidden) @ network.out + network.out_bias
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(window)
    mean = total / len(data)
    return network.labels[int(mean.argmax())], round(float(mean.max()), 6)


def test_language_predictions_equal_a_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = language.fit(docs, crc_mod(F.col("doc_id"), 4) != 2, rows_per_label=60)
    rows = [(i, t[:700]) for i, t in enumerate(r.text for r in docs.orderBy("doc_id").limit(14).collect()) if t] + [(90, None), (91, ""), (92, "12 !"), (93, "Ω é" * 50), (94, "x"), (95, "a" * 128), (96, "b" * 129)]
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id int, text string"), network).collect()}
    for i, text in rows:
        label, score = plain_language(network, text)
        assert got[i][0] == label and abs(got[i][1] - score) < 1e-4, (i, text)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text", None)], "doc_id int, text string, lang string")
    assert language.fit(docs, F.lit(True)) is None
    assert language.identify(docs, None).first().lang_pred == "und" and language.identify(docs.limit(0), None).count() == 0


def test_windows_cover_texts():
    data = np.arange(300) % 250 + 1
    offsets = np.array([0, 130, 130, 300])
    starts, ends, first = language.cut_windows(data.astype(np.uint8), offsets)
    assert list(first) == [0, 2, 3] and (ends - starts).sum() == 300
    assert language.window_bytes(data.astype(np.uint8), starts, ends)[1, :3].tolist() == [129, 130, 0]


@pytest.mark.parametrize("cell_bytes", [ngrams.CELL_BYTES, 300])
def test_scores_equal_a_plain_model(spark, cell_bytes):
    rows = made_documents(60)
    df = spark.createDataFrame(rows, DOCUMENTS)
    model = ngrams.train(spark, df.where("doc_id % 4 <> 0"), Scratch(spark), cell_bytes=cell_bytes)
    got = {r.doc_id: r for r in ngrams.score(clashing(df), model).select("row.doc_id", "n_tokens", "n_known", "base_score", "score").collect()}
    toks = {i: [*words(t), "\0end"] for i, t, *_ in rows}
    pairs, single = Counter(), Counter()
    for i, w in toks.items():
        if i % 4:
            single.update(w)
            pairs.update(zip(["\0begin", *w], w))
    total, known = sum(single.values()), len(single)
    before, context, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), n in pairs.items():
        context[u] += n
        kinds[u][min(n, 3) - 1] += 1
    tally = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    d2, d1 = ngrams.discounts(tally(pairs.values())), ngrams.discounts(tally(before.values()))
    left = sum(d1[min(n, 3) - 1] for n in before.values()) / len(pairs)

    def p(u, w):
        low = (before[w] - (d1[min(before[w], 3) - 1] if before[w] else 0)) / len(pairs) + left / (known + 1)
        if not context[u]:
            return low
        n = pairs[u, w]
        return (n - (d2[min(n, 3) - 1] if n else 0)) / context[u] + sum(a * b for a, b in zip(d2, kinds[u])) / context[u] * low

    assert abs(sum(p("one", w) for w in single) + p("one", "\0unknown") - 1) < 1e-9
    for i, w in toks.items():
        assert math.isclose(got[i].score, sum(math.log10(p(u, x)) for u, x in zip(["\0begin", *w], w)), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, sum(math.log10((single[x] + 1) / (total + known + 1)) for x in w), rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known) == (len(w), sum(single[x] > 0 for x in w))
    assert (model.tokens, model.words, model.pairs) == (total, known, len(pairs))


def test_a_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    model = ngrams.train(spark, df.limit(0), Scratch(spark))
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in ngrams.score(df, model).collect()] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(1, "x y " * 70_000)], "doc_id int, text string")
    model = ngrams.train(spark, df, Scratch(spark))
    w = ngrams.word_hashes(np.frombuffer(b"x y", np.uint8), np.array([0, 3]))[0]
    assert list(model.pair_counts(w, w[::-1])) == [70_000, 69_999]


def test_arrays_in_folders_and_other_stores(tmp_path, monkeypatch):
    for root in (f"file://{tmp_path}/a", f"{tmp_path}/b", "mock://x/c"):
        if root.startswith("mock"):
            monkeypatch.setattr(arrays, "_local", lambda path: None)
            root = f"file://{tmp_path}/c"
        arrays.write(root, "x", {"keys": np.array([1, 5, 9], np.uint64), "n": np.array([7, 8, 9], np.uint32), "odd": np.array([3], np.uint8)})
        held = arrays.read(root, "x")
        place, found = arrays.find(held["keys"], np.array([0, 5, 9, 10], np.uint64))
        assert found.tolist() == [False, True, True, False] and held["n"][place[found]].tolist() == [8, 9] and held["odd"].tolist() == [3]
        assert arrays.read(root, "none") == {}


def test_mapped_files_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "MOST_MAPS", 5)
    for i in range(40):
        arrays.write(str(tmp_path), f"f{i}", {"keys": np.array([i], np.uint64)})
    assert [int(arrays.read(str(tmp_path), f"f{i % 40}")["keys"][0]) for i in range(80)] == [*range(40)] * 2 and len(arrays._maps) <= 5


def test_counts_above_four_bytes(tmp_path):
    n = np.array([1, 5_000_000_000], np.int64)
    u, w = np.array([3, 9], np.uint64), np.array([4, 4], np.uint64)
    blob = ngrams._pack_pairs(u, w, n)
    assert [x.tolist() for x in ngrams._unpack_pairs(blob)] == [[3, 9], [4, 4], n.tolist()]
    assert ngrams._unpack(ngrams._pack([u, n, n * 0]), "hnn")[1].tolist() == n.tolist()
    root, keys = str(tmp_path), ngrams.pair_hash(u, w)
    order = np.argsort(keys)
    arrays.write(root, "p-0-0", {"keys": keys[order], "n": np.minimum(n, ngrams.BIG).astype(np.uint16)[order]})
    arrays.write(root, "p-0-0-big", {"keys": keys[n >= ngrams.BIG], "n": ngrams.narrow(n[n >= ngrams.BIG])})
    arrays.write(root, "w-0", {"keys": u, **{c: ngrams.narrow(n) for c in ngrams.WORD_COLUMNS}})
    model = ngrams.Model(root, 1, int(n.sum()), 2, 2, 1, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0.5)
    assert model.pair_counts(u, w).tolist() == n.tolist() and model.word_table(u)["c"].tolist() == n.tolist()


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(3)
    signs = "abcsStTmMdDrRvVlLeE'''’  \n\t!?.12²½éÉİΣςßﬁ中字कि٣<|>🙂\x1c\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "x <|endoftext|> it's", "<|ENDOFTEXT|>", "'s'", "don't'VE'", "é", "I'LL 'll", "a" * 20000, "hello " * 9000, "\x00"]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = tokens.token_counts(spark, df, public_tokenizers.path("word_bpe_49k.json")).select("row.doc_id", "n_tokens", "n_bytes", "row.n_bytes").collect()
    assert {r.doc_id: r[1] for r in got} == dict(enumerate(library_counts(texts)))
    assert {r.doc_id: r[2] for r in got} == {i: len((t or "").encode()) for i, t in enumerate(texts)}


def test_token_counts_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id int, text string")
    file = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.token_counts(spark, df, file).first().n_tokens == 0
    assert tokens.token_counts(spark, df.limit(0), file).count() == 0
    with pytest.raises(ValueError):
        tokens.token_counts(spark, df, public_tokenizers.path("byte_bpe_50k.json"))


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, 2 / 3 * 250, 1 / 3 * 250]
    assert mixing.targets([0, 10], [5, 2]) == [0, 15] and mixing.targets([], []) == []
    got = mixing.targets([1, 1000, 5, 0], [5, 2, 1, 5])
    assert abs(sum(got) - 1.5 * 1006) < 1e-6 and all(t <= 2 * n for t, n in zip(got, [1, 1000, 5, 0]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    i = np.arange(n)
    one = mixing.permuted(i, np.full(n, n), np.full(n, 99))
    assert sorted(one) == list(range(n))
    assert n < 64 or list(one) != list(mixing.permuted(i, np.full(n, n), np.full(n, 98)))


@pytest.mark.parametrize("block_words", [1, 7, 128])
def test_mix_takes_what_is_planned(spark, block_words):
    rows = made_documents(90)
    df = clashing(spark.createDataFrame(rows, DOCUMENTS).drop("source")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").when(F.col("doc_id") % 9 != 0, F.concat(F.lit("s"), F.col("doc_id") % 5)))
    parts, texts, plan = mixing.mix(spark, df, block_words=block_words)
    got = parts.collect()
    by_id = {i: t for i, t, *_ in rows}
    spaced = re.compile("[^\x20\x09-\x0d]+")
    for r in got:
        assert spaced.findall(by_id[r.doc_id])[r.first_word : r.first_word + r.n_words] == spaced.findall(r.text)
    taken = Counter()
    of_source = Counter()
    for r in got:
        taken[r.doc_id] += r.n_words
        of_source[r.source] += r.n_words
    assert all(taken[i] <= 2 * len(spaced.findall(t or "")) for i, t in by_id.items())
    assert [of_source[s] for s in plan.sources] == plan.words and all(abs(w - t) <= 1 for w, t in zip(plan.words, plan.targets))
    slots = Counter((r.shard, r.slot) for r in got)
    assert len(slots) == sum(plan.slots) and {r.doc_id for r in texts.collect()} == set(by_id)
    again = mixing.mix(spark, df.repartition(5), block_words=block_words)[0]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_draws_of_very_many_sources_are_bounded():
    plan = mixing.make_plan({f"s{i}": 1000 for i in range(50_000)})
    assert plan.drawn.size <= mixing.MOST_DRAWS + 50_000 and (plan.drawn.sum(axis=0) == plan.slots).all()


def test_mix_of_more_sources_than_are_sent_and_in_short_arrays(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 1) + "x" for _ in range(rng.choice([0, 5, 40, 300]))), rng.choice(["hot", "hot", f"s{i % 17}", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda mixed: sorted(map(str, mixed[0].collect()))
    want = key(mixing.mix(spark, df, block_words=4))
    for name, value in (("MOST_SENT_SOURCES", 3), ("MOST_SENT_TOTALS", 3), ("SLOTS_OF_A_ROW", 7)):
        monkeypatch.setattr(mixing, name, value)
    mixed = mixing.mix(spark, df, block_words=4)
    assert key(mixed) == want and len(want) > 500
    plan = mixed[0]._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_mix_of_repeated_rows_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c", None), (1, "a b c", None), (None, "d e", None), (2, None, "x")], "doc_id long, text string, source string")
    parts, texts, plan = mixing.mix(spark, df, block_words=2)
    assert plan.sources == ["x", None] and plan.words == [0, 12] and texts.count() == 4
    assert parts.agg(F.sum("n_words")).first()[0] == 12
    assert mixing.mix(spark, df.limit(0))[0].count() == 0


def test_language_sample_takes_copies_once(spark, monkeypatch):
    """Labels of few texts in many copies are learned, and the sample holds no copy."""
    texts = [("en", f"the house and the garden {i}") for i in range(3)] + [("de", f"das haus und der garten {i}") for i in range(3)]
    copied = spark.createDataFrame(texts, "lang string, text string").crossJoin(spark.range(4000)).drop("id").repartition(5)
    seen = []
    monkeypatch.setattr(language, "train", lambda windows, labels: seen.append((windows, labels)))
    language.fit(copied, F.lit(True))
    language.fit(copied, F.lit(True), rows_per_label=2)
    assert [Counter(labels) for _, labels in seen] == [{"en": 3, "de": 3}, {"en": 2, "de": 2}]
    assert {bytes(w).rstrip(b"\0").decode() for w in seen[0][0]} == {t for _, t in texts}
