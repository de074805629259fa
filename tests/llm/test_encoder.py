"""Token ids of words that the model is asked for directly, and what a worker process keeps of them."""

import random

import public_tokenizers
import pytest

from sluice.llm import common

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_words_with_marks_and_lines(name):
    enc = common.IdEncoder(public_tokenizers.path(name))
    rng = random.Random(5)
    letters = "abcXYZÉéÿ×İıŉſŁ́'"
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) + rng.choice(["", ".", "%%%", "--", ".\n", "\n", "'s", "<|", "_", "­"]) for _ in range(6000)]
    texts = ["".join(p + rng.choice([" ", "", " ", "\n"]) for p in pieces[i : i + 6]) for i in range(0, 6000, 6)]
    assert [x.tobytes() for x in enc.encode(texts)] == [x.tobytes() for x in enc._encode(texts)]
    known = ["Été", "re%%%"] + (["end.\nNow", "a\nà!!"] if name == NAMES[0] else [])
    assert [enc._word(p) for p in known] == [x.tobytes() for x in enc._encode([enc._text(p) for p in known])]


def test_space_beside_white_space():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("ab \n\t\x85　 ") for _ in range(rng.randint(1, 6)))
        assert common._space_by_space(text) == (text[0] == " " or text[-1] == " " or any(a.isspace() and b.isspace() and " " in a + b for a, b in zip(text, text[1:], strict=False)))


def test_new_words_are_learned_many_at_once():
    """Words after a space are asked for together, also where the vocabulary has no mark for their ends."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, alone = common.IdEncoder(public_tokenizers.path(name)), []
        plain = enc._tokens
        enc._tokens = lambda lead, word, plain=plain, alone=alone: alone.append(word) or plain(lead, word)
        text = "Start " + " ".join(f"{a}qu{b}ré{c}{d}" for a in "xyzABC" for b in "aeiouš" for c in "kvwž" for d in ("", ".", '").'))
        assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert not alone


def test_steps_without_an_encoder_give_its_memory_back():
    """Worker processes outlive their steps; one that encodes nothing holds no encoder beside its own tables."""
    common.encoder(public_tokenizers.path(NAMES[0]))
    assert common._encoders
    assert list(common.tidy(lambda batches: (x for x in batches))(iter([1, 2]))) == [1, 2]
    assert not common._encoders
