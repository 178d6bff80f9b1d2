import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import words as W
from tests.llm.tables import made_documents, words


@pytest.mark.parametrize("limit", [1, 50, 1 << 18])
def test_words_are_those_of_the_pattern(limit):
    texts = [t for _, t, *_ in made_documents()] + ["a\x00b c", "\x0bx\x0c", "a", "b", "é"]
    seen, row = {}, 0
    for first, end, data, offsets in W.text_chunks(pa.array(texts), limit):
        assert first == row
        row = end
        hashes, bounds, starts, ends = W.word_hashes(data, offsets)
        for i in range(end - first):
            want = words(texts[first + i])
            got = hashes[bounds[i] : bounds[i + 1]]
            assert len(got) == len(want)
            for w, h in zip(want, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert row == len(texts) and len(set(seen.values())) == len(seen)


def test_sliced_and_empty_columns():
    a = pa.array(["x y", "z", None, "w"])
    assert [e for _, e, *_ in W.text_chunks(a[1:])] == [3] and list(W.text_chunks(a[:0])) == []


def test_shingles_never_cross_texts():
    data = np.frombuffer(b"a b c a b ", np.uint8)
    hashes, bounds, _, _ = W.word_hashes(data, np.array([0, 6, 10, 10]))
    shingles, at = W.shingle_hashes(hashes, bounds, 2)
    assert list(np.diff(at)) == [2, 1, 0] and shingles[0] == shingles[2] != shingles[1]
    assert len(W.shingle_hashes(hashes, bounds, 5)[0]) == 2
