"""Token files: the coding against a plain coder, words against the library, and the work that is left to Python."""

import random
import sys

import numpy as np
import public_tokenizers
import pytest

from sluice.llm import common, tokenfile


def plain_words(values: list[int], block: int) -> tuple[list[int], list[int]]:
    """The words, value by value: the selector with the most values that fit, else an escape."""
    words, first = [], []
    for b in range(0, len(values), block):
        first.append(len(words))
        i, end = b, min(b + block, len(values))
        while i < end:
            for s, count, bits in tokenfile.SELECTORS:
                run = values[i : i + count]
                if i + count <= end and max(run) < 1 << bits:
                    break
            else:
                if i + 1 == end and values[i] < 1 << 30:
                    s, bits, run = 15, 30, values[i : i + 1]
                else:
                    s, bits, run = 0, 0, values[i : i + 1]
            words.append((s << 60) | sum(v << bits * k for k, v in enumerate(run)) if s else 0)
            words += [] if s else run
            i += len(run)
    return words, first


@pytest.mark.parametrize("block", [1, 2, 7, 100, 240, 8192])
def test_words_as_a_plain_coder_has_them(block, monkeypatch):
    monkeypatch.setattr(tokenfile, "TOGETHER", 1000)  # several groups of blocks
    rng = np.random.default_rng(block)
    wide = 1 << rng.integers(0, 64, 3001, dtype=np.uint64)
    mixed = np.where(rng.random(3001) < 0.02, wide, rng.integers(0, 3, 3001).astype(np.uint64))
    for values in (rng.integers(0, 49_408, 3001).astype(np.uint64), wide, mixed, np.zeros(3001, np.uint64), mixed[:1], mixed[:0]):
        words, first = plain_words(values.tolist(), block)
        body = tokenfile.encode(values, block)
        head = np.frombuffer(body, "<u4", 5 + len(first), 4).tolist()
        assert head == [tokenfile.VERSION, block, len(values), len(first), len(words), *first]
        assert np.frombuffer(body, "<u8")[len(body) // 8 - len(words) :].tolist() == words
        assert tokenfile.decode(body).tolist() == values.tolist()
        for some in (slice(1, 3), slice(None, None, 2), slice(None, None, -1), slice(5, 2)):
            parts = [values[i : i + block] for i in range(0, len(values), block)][some]
            assert tokenfile.decode(body, some).tolist() == [v for p in parts for v in p.tolist()]


def test_python_takes_few_steps_a_value():
    """A run of ids is coded and decoded by arrays, with no call for each word."""
    values = np.random.default_rng(1).integers(0, 49_408, 262_144).astype(np.uint64)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = tokenfile.decode(tokenfile.encode(values))
    finally:
        sys.setprofile(None)
    assert (got == values).all()
    assert calls < len(values) // 10


def test_a_word_is_learnt_once_whatever_its_case_and_stop():
    enc = common.IdEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Erinth, erinth. ERINTH\nerinth.\n eRinth, end"]
    assert [x.tobytes() for x in enc.encode(texts)] == [x.tobytes() for x in enc._encode(texts)]
    assert {p for p in enc.cache if p} == {"erinth", ",", ".", "end"}


def test_case_and_stops_as_the_library_has_them():
    enc = common.IdEncoder(public_tokenizers.path("word_bpe_49k.json"), most=20_000)
    rng = random.Random(7)
    parts = ["Erin", "aN", "x", "É", "é", "é", "İ", "Σ", "ΑΣ", "K", "ß", "ẞ", "ſ", "7", "½", "日本", "'S", "'s", "'", ".", ",", "...", ").", "),", "-", "́", " ", "  ", "\n", "\t", "\x85", "\xa0", "​", "\x01", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "\0", "Zq" * 150]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(12_000)]
    plain = ["Erin", "aN", "ton", "x", ".", ",", ".", " ", " ", "\n", "'S", "<|EndOfText|>", "<|endoftext|>"]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 30))) for _ in range(6_000)]
    for i in range(0, len(texts), 500):
        assert [x.tobytes() for x in enc.encode(texts[i : i + 500])] == [x.tobytes() for x in enc._encode(texts[i : i + 500])]
