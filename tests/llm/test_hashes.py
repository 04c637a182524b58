"""Words and pieces whose polynomial hashes cancel by structure, whatever the base, are told apart."""

import numpy as np
import pytest

from quillon.llm import decontaminate, ngram_join, suffix_dedup
from quillon.llm.textnp import SPACED, run_hashes, words


def thue_morse(zero, one, n):
    return "".join((zero, one)[bin(k).count("1") & 1] for k in range(n))


FIRST, SECOND = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)


def block(*texts):
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


@pytest.mark.parametrize("n", [8, 64, 1024, 1 << 15])
def test_word_hashes(n):
    h, *_ = words(*block(thue_morse("a", "b", n), thue_morse("b", "a", n)), SPACED)
    assert len(set(h.tolist())) == 2


def test_runs_of_all_lengths():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 3, 400).astype(np.uint8)
    start, end = (x.reshape(-1) for x in np.meshgrid(np.arange(60), np.arange(60, 400)))
    h = run_hashes(raw, start, end)
    seen = {}
    for a, b, x in zip(start.tolist(), end.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(x, raw[a:b].tobytes()) == raw[a:b].tobytes()
    again = run_hashes(np.concatenate((np.zeros(5, np.uint8), raw)), start + 5, end + 5)
    assert (again == h).all()


def test_join_links_no_such_words(spark):
    df = spark.createDataFrame([(1, FIRST), (2, SECOND), (3, FIRST)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.sets_and_components(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_benchmark_hits_no_such_words(spark):
    df = spark.createDataFrame([(1, FIRST), (2, SECOND)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, FIRST)], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.digest(decontaminate.contamination(df, bench)).collect()}
    assert got == {1: 1, 2: 0}


def test_windows_compare_bytes(monkeypatch):
    """Even where every word has one hash, only equal words match."""
    real = decontaminate.words

    def flat(*args):
        h, at, start, end = real(*args)
        return np.ones_like(h), at, start, end

    monkeypatch.setattr(decontaminate, "words", flat)
    windows = decontaminate.Windows([(1, "one two three"), (2, "four six")])
    windows.choose({})
    raw, offs = block("ONE two three", "one two threx", "four six", "six four six", "two")
    _, text, _, win, _, _ = decontaminate.match_block(windows, windows.sieve(), raw, offs)
    assert sorted((int(t), windows.ids[windows.items[w][0]]) for t, w in zip(text, win)) == [(0, 1), (2, 2), (3, 2)]


@pytest.mark.parametrize("letters", ["0\\", ",;", "ab"])
def test_pieces_of_such_texts_are_kept(spark, letters):
    df = spark.createDataFrame([(1, thue_morse(*letters, 256)), (2, thue_morse(*letters[::-1], 256))], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()] == [0, 0]
