"""Mentions against a regular expression an alias."""

import random
import re
import time

import pytest

from quillon.operators import automaton as A
from quillon.operators import knowledge as K

PIECES = ["ana", "Ana Lima", "lima", "an", "a", "Zé", "zé-da-silva", "ação", "AÇÃO", "!!", "x_1", "ana ana", "  ", "\n", ".", "-", "_", "9", "日本", "ß"]


def by_hand(texts, aliases):
    out = []
    for i, t in texts:
        for e, a in {(e, a.lower()) for e, a in aliases if a}:
            out += [(i, e, m.start(), m.end()) for m in re.finditer(rf"(?<!\w){re.escape(a)}(?!\w)", (t or "").lower())]
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 3])
def test_mentions(spark, monkeypatch, most):
    """With all aliases in every task, and with each text's own."""
    monkeypatch.setattr(A, "MOST_ALIASES", most)
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(60, None), (61, ""), (1, "ana")]
    aliases = [(k % 7, p) for k, p in enumerate(PIECES) if p.strip()] + [(1, "ana"), (2, "ana"), (3, "")]
    got = K.mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(aliases, "entity long, alias string"))
    assert sorted(map(tuple, got.collect())) == by_hand(texts, aliases)
    none = spark.createDataFrame([], "entity long, alias string")
    assert K.mentions(spark.createDataFrame(texts, "doc_id long, text string"), none).count() == 0


def test_time_does_not_follow_the_number_of_aliases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    text = " ".join(word() for _ in range(60_000))
    names = [f"{word()} {word()}" for _ in range(10_000)]

    def took(finder):
        best = 9.0
        for _ in range(3):
            at = time.perf_counter()
            sum(1 for _ in finder.find(text))
            best = min(best, time.perf_counter() - at)
        return best

    assert took(A.Finder(names)) < 6 * took(A.Finder(names[:10])) + 0.05
