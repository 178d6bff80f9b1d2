"""SentencePiece encoding and decoding against the library, which is plain enough."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lectern.llm import pieces, queries
from tests.llm.tables import DOCUMENTS, clashing, made_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
BITS = ["a", "e", "t", " ", "  ", "▁", "▁" * 17, "▁" * 15, "\n", "\t", "\0", "é", "é", "ß", "字", "季", "漢", "\U0001f600", "<s>", "</s>", "<unk>", "<0x41>", "1", "23", "².", ".", "the", "ing", "\r", "​", "я", "_", "//", "((", "⁇"]


@pytest.fixture(scope="module")
def words():
    return pieces.vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_are_the_library_s(words, library):
    rng = random.Random(8)
    known = list(words.score)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(60)) for _ in range(2000)]
    texts += [" " * n for n in range(40)] + ["a" + " " * n + "b" for n in range(40)]
    ids, bounds = words.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        want = library.encode(text)
        assert ids[a:b].tolist() == want, text
        assert words.decode(ids[a:b].astype(np.int64)) == library.decode(want), text


def test_neighbours_fit_when_merging_them_anew_gives_them_again(words):
    rng = random.Random(2)
    known = list(words.score) + ["▁" * n for n in range(1, 17) if "▁" * n in words.score] * 100
    for _ in range(20000):
        a, b = rng.choice(known), rng.choice(known)
        assert words.fit(a, b) == (pieces.merged(a + b, words.score) == [a, b])


def test_decoding_any_ids(words, library):
    rng = random.Random(4)
    spaced = [words.ids["▁"], words.ids["▁▁"], words.ids["▁the"]]
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), *spaced]) for _ in range(rng.randint(0, 8))]
        assert words.decode(np.array(ids, np.int64)) == library.decode(ids)
    with pytest.raises(ValueError, match="not in the vocabulary"):
        words.decode(np.array([32000]))


@pytest.mark.parametrize("text", ["A" * 40000, "ab" * 20000, " " * 40000, "季" * 20000, "thethethe" * 4000])
def test_long_texts_without_cuts_take_linear_time(words, library, text):
    times = []
    for n in (len(text) // 8, len(text)):
        start = time.process_time()
        ids, _ = words.encode([text[:n]])
        times.append(time.process_time() - start)
        assert ids.tolist() == library.encode(text[:n])
    assert times[1] < 24 * times[0] + 0.2


def test_whole_tables(spark, words, library):
    rows = [*made_documents(40), (901, "nul\0 <s> ▁", "en", "a", 3), (901, "nul\0 <s> ▁", "en", "a", 3), (None, "x" * 50000 + " y" * 20000, None, None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    coded = pieces.encode(spark, clashing(df.withColumnRenamed("text", "body").withColumnRenamed("lang", "text")), words, "body")
    got = pieces.decode(spark, coded, words).select("row.doc_id", "ids", "decoded")
    want = sorted((str(r[0]), library.encode(r[1] or ""), library.decode(library.encode(r[1] or ""))) for r in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect()) == want
    assert pieces.decode(spark, pieces.encode(spark, df.limit(0), words), words).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r.decoded for r in pieces.decode(spark, none, words).orderBy("doc_id").collect()] == ["", ""]


def test_query_against_the_library(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_sentencepiece_backtracking(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for change in ("unigram", "trim", "own"):
        spec = pb.ModelProto()
        with open(MODEL, "rb") as f:
            spec.ParseFromString(f.read())
        if change == "unigram":
            spec.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
        elif change == "trim":
            spec.normalizer_spec.remove_extra_whitespaces = True
        else:
            spec.pieces[300].type = pb.ModelProto.SentencePiece.USER_DEFINED
        path = tmp_path / f"{change}.model"
        path.write_bytes(spec.SerializeToString())
        with pytest.raises(ValueError, match="supported"):
            pieces.vocabulary(str(path))
