"""Features of words hashed many at a time, and the pieces that are kept."""

import random

import numpy as np

from sluice.llm import toxicity


def test_features_of_many_words_are_those_of_each():
    rng = random.Random(1)
    letters = "abcdefgz_09éßøłא中\U0001d4d0İ"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 14, 15, 16, 40]))) for _ in range(2000)]
    chosen = np.random.default_rng(0).random(toxicity.DIM) < 0.1
    for only in (None, chosen):
        for word, found in zip(words, toxicity.features_of_all(words, only), strict=True):
            assert set(np.frombuffer(found, "<u4").tolist()) == {f for f in toxicity.features_of(word) if only is None or only[f]}


def test_pieces_that_were_used_of_late_are_not_learned_anew(monkeypatch):
    pieces, learned = toxicity._Pieces(limit=10), []
    plain = toxicity._Pieces._learn
    monkeypatch.setattr(toxicity._Pieces, "_learn", lambda self, new: learned.extend(new) or plain(self, new))
    for k in range(20):
        (got,) = pieces.distinct([f"often Used! new{k} {k}"])
        assert set(got.tolist()) == set().union(*map(toxicity.features_of, ("often", "used", f"new{k}", str(k))))
    assert learned.count("often") == 1 and pieces.distinct([None, ""])[0].size == 0
    assert len(pieces) + len(pieces.older) <= 30
