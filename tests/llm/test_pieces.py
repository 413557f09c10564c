"""Ids by piece equal the ids of whole texts, for any tokenizer."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bidframe.llm import tokens
from bidframe.llm.words import portions


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_many_texts_at_once(name):
    path = public_tokenizers.path(name)
    whole, encoder = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    draw = random.Random(5)
    parts = ["Wort", "don't", "it's.", "x1.", "é!", "naïve,", "$$$", "a%%%", "word...", "(word)", "12,50", "日本。", "ΑΒΓ.", ".", "<|endoftext|>", "<|endoftext|>.", "_x_", "I'll!", "'s", "a'", "𝒳!"]
    texts = [draw.choice(["", " ", "\n"]).join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(50)]
    texts += [" ".join(draw.choices(parts, k=40)) + "\n" + "\n".join(draw.choices(parts, k=9)) for _ in range(200)] + ["", "a  b", " a", "a\t", "x\n y"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode_all(texts)] == want
    assert encoder.by_piece == name.startswith("byte")


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    encoder = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three four five, six! seven", "eight nine. ten, two!!"]
    assert encoder.encode_all(texts) == [encoder.whole(t) for t in texts] and len(encoder.known) == 0


def test_portions():
    assert list(portions(["aa", "b", "cccc", "", "d"], 3)) == [(0, 2), (2, 3), (3, 5)] and list(portions([], 3)) == []
