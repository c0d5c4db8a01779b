"""The query of operator 3 scores with trigrams."""

import pickle

import numpy as np
import pytest
import zstandard

from attestra.llm import katz_backoff


def test_query_uses_trigrams(spark, tmp_path):
    rows = [(i, "a b c d a b d c a b c") for i in range(40)] + [(i, "c a b d b a d c") for i in range(40, 80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got, two, three = ({r.doc_id: round(r.score, 9) for r in d.collect()} for d in (katz_backoff.op3_katz_backoff(spark, str(tmp_path)), katz_backoff.score_documents(docs, 2), katz_backoff.score_documents(docs, 3)))
    assert got == three != two


def test_buckets_send_ranks():
    """Not ids, which are as many times larger as there are buckets."""
    model, keys, n = katz_backoff._Model(1000), np.arange(50, dtype=np.uint64) * np.uint64(1000) + np.uint64(7), np.ones(50, np.int64)
    grams = katz_backoff._table([("grams", 1, 0, 7, katz_backoff._pack(keys, n, n.astype(np.uint8)))])
    sent = [r for r in katz_backoff._count(model, 1, False)(grams).to_pylist() if r["kind"] == "counts"]
    assert sorted(katz_backoff._unpack(sent[0]["blob"])[0].tolist()) == list(range(50))


def test_small_numbers_take_few_bytes():
    """Byte planes of zeros are neither made nor compressed."""
    held = pickle.loads(zstandard.ZstdDecompressor().decompress(katz_backoff._pack(np.arange(250), np.zeros(1000, np.int64))))
    assert sum(len(planes) for *_, planes in held) < 500


@pytest.mark.parametrize(
    "array",
    [np.arange(300), np.array([0, 2**31 - 1, 2**40, 2**62]), np.array([-1, 5, -(2**63)]), np.array([2**64 - 1, 1], np.uint64), np.array([0.1, -np.inf, np.nan]), np.array([3, 255], np.uint8), np.array([7, -7], np.int32), np.zeros(9, np.int64), np.zeros(0, np.int64), np.zeros(0), np.arange(20).reshape(4, 5).T[2]],
)
def test_packed_arrays_come_back(array):
    got, after = katz_backoff._unpack(katz_backoff._pack(array, np.arange(3)))
    assert np.array_equal(got, array, equal_nan=array.dtype.kind == "f") and got.dtype.kind == array.dtype.kind and after.tolist() == [0, 1, 2]


@pytest.mark.parametrize("top", [1, 50, 2**40, 2**62])
def test_sorted_codes(top):
    """As a stable argsort, also where code and place don't fit a word."""
    codes = np.random.default_rng(3).integers(0, top, 5000) // 7 * 7
    codes[7] = top - 1
    places = np.arange(5000) * 3 + 1
    order = np.argsort(codes, kind="stable")
    for of, at in ((None, order), (places, places[order])):
        got, where = katz_backoff._sorted(codes, of)
        assert np.array_equal(got, codes[order]) and np.array_equal(where, at)
    assert [x.tolist() for x in katz_backoff._sorted(codes[:0])] == [[], []]


def test_chunks_sort_words_once(monkeypatch):
    """A chunk's n-grams are numbered and dealt out by sorts of plain words; argsorts took most of the time."""
    rng = np.random.default_rng(5)
    lengths, keys = np.full(40, 50), rng.integers(0, 2**63, 100).astype(np.uint64)
    words = rng.integers(0, 100, 2000)
    blob = katz_backoff._pack(lengths, np.arange(40) % 10 == 0, words, keys)
    model = katz_backoff._Model(4)
    model.unigrams(np.array([2000, 100, 5, 4, 3, 2, 1, 1]))

    def slow(*_, **__):
        raise AssertionError("argsort")

    for name in ("argsort", "lexsort", "unique"):
        monkeypatch.setattr(np, name, slow)
    view = katz_backoff._View(model, blob, {}, 1)
    view.ids[0], view.counts[0] = rng.permutation(100), np.bincount(words, minlength=100)
    view.c.extend()
    order, cut = view.slices(2)
    monkeypatch.undo()
    grams = {(a, b) for text in words.reshape(40, 50).tolist() for a, b in zip(text, text[1:])}
    assert sorted(zip(*(x.tolist() for x in view.c.pairs[0]))) == sorted(grams)
    assert sorted(order.tolist()) == list(range(len(grams))) and cut[0] == 0 and cut[-1] == len(grams)
    for lo, hi in zip(cut, cut[1:]):
        assert (np.diff(view.ids[0][view.c.pairs[0][0][order[lo:hi]]]) >= 0).all()
