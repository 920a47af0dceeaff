"""Token ids against the tokenizers library as it comes, without settings of its own."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from daybook.llm import tokens
from daybook.llm.queries import tokenizer_path


def same_ids(texts: list[str]) -> None:
    library = Tokenizer.from_file(tokenizer_path())
    for text, got in zip(texts, tokens.encode(texts, tokenizer_path()), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text


def test_special_tokens_in_texts():
    same_ids(["ok <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>\n<|endoftext|> b", "<|endoftext", "plain text", ""])


def test_mixed_white_space():
    rng = random.Random(7)
    space = [" ", "\n", "\t", "\r", "\xa0", "\u3000", "\x0b", "\x1c", "\x85", "\u2028"]
    mixed = ["".join(rng.choice(space) if rng.random() < 0.5 else rng.choice("ab1'.é") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    same_ids(["a\tb\tc\n\n", "a\n\n\nb\tc\td", "a b\nc", *mixed])


def test_a_piece_is_looked_up_once_in_a_batch(monkeypatch):
    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    e = tokens.encoder(tokenizer_path())
    table = Counting(e.table)
    monkeypatch.setattr(e, "table", table)
    same_ids(["one two\nthree one two", "one\tone two  two"] * 200)
    assert table.asked <= 20


def test_without_room_pieces_are_encoded_again(monkeypatch):
    e = tokens.encoder(tokenizer_path())
    monkeypatch.setattr(e, "table", {})
    monkeypatch.setattr(e, "room", 0)
    same_ids(["one two\nthree one two", "one\tone two  two", "", "\0 a"])
    assert e.table == {}
