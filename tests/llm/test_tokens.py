"""New words reach the library's model together; what is remembered stays in arrays."""

import random

import numpy as np
import pytest

from plumbline.llm import tokens
from plumbline.llm.packing import tokenizer_path

NAMES = "byte_bpe_50k.json", "word_bpe_49k.json"


def same(encoder, data):
    for text, ids in zip(data, encoder.encode(data), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def drawn(seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdéñ'1 ") for _ in range(rng.randint(1, 25))) for _ in range(60)) for _ in range(20)]


@pytest.mark.parametrize("name", NAMES)
def test_new_words_are_one_encoding(name, monkeypatch):
    encoder, model, calls = tokens.Encoder(tokenizer_path(name)), None, []

    class Model:
        def encode_batch_fast(self, inputs, **more):
            calls.append(len(inputs))
            return model.encode_batch_fast(inputs, **more)

    model, encoder.model = encoder.model, Model()
    for seed in range(3):
        same(encoder, drawn(seed))
    assert calls and max(calls) == 1


@pytest.mark.parametrize("name", NAMES)
def test_forgets_and_learns_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    monkeypatch.setattr(tokens, "CHUNK", 500)
    encoder = tokens.Encoder(tokenizer_path(name))
    for seed in (0, 1, 0, 2):
        same(encoder, drawn(seed))


@pytest.mark.parametrize("name", NAMES)
def test_another_word_of_a_remembered_hash(name, monkeypatch):
    monkeypatch.setattr(tokens, "polynomial", lambda data, first, end: (end - first).astype(np.uint64))
    encoder = tokens.Encoder(tokenizer_path(name))
    for text in ("abc", "abd", "abcdefghi", "abcdefghj", "abc"):
        same(encoder, [text])
