"""Ids merged in step are those of the tokenizer itself, for any text."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandlight.llm import packing, word_bpe

LETTERS = "aeiostnrAEİıſßĐéÉéôÑŸŒœŉǅ.,'-_!|<>0123²½\t\r\x0b\x1c\x85\xa0\u200bΣσςΑ가각한국漢字\U0001f642\u0301\u0307"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(LETTERS) if r.random() < 0.6 else r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(0, 12))) + r.choice(["", ".", ","]) for _ in range(n)]


def same(encode: word_bpe.WordIds, texts: list[str]) -> None:
    want = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for text, e, got in zip(texts, want, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.ids, text[:100]


@pytest.fixture(scope="module")
def encode() -> word_bpe.WordIds:
    return word_bpe.WordIds(packing.default_tokenizer())


def test_random_words(encode):
    r = random.Random(1)
    same(encode, [r.choice([" ", "\n", "  "]).join(words(r, r.randint(0, 40))) for _ in range(3000)])


def test_known_cases(encode):
    same(encode, ["İ.", "x İ. y", "İ,", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "ΑΣ. ΑΣ", "don't it's 'sabc I'LL", "aaaaaaa aaaa", "", "  \n\n  ", "a" * 300, "é" * 63, "aé" * 32, "..." * 40, "\x00"])


def test_long_texts_and_a_full_memo(encode, monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNK", 1000)
    monkeypatch.setattr(word_bpe, "MEMO_BYTES", 50_000)
    r = random.Random(2)
    same(encode, [" ".join(words(r, 5000)), "x" * 5000, "ab " * 3000, "", " ".join(words(r, 50))])
    assert len(encode.words) < 2000


def test_words_that_come_again_are_learned_once(monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNK", 1000)
    monkeypatch.setattr(word_bpe, "MEMO_BYTES", 200_000)
    encode, learned = word_bpe.WordIds(packing.default_tokenizer()), []
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda x: (learned.extend(x), learn(x)))
    common = ["the", "of", "größe,", "12|"]
    texts = [" ".join([*common, *(f"w{i}x{k}" for k in range(100))]) for i in range(60)]
    same(encode, texts)
    assert [learned.count(x) for x in common] == [1] * len(common)
    assert len(learned) > 5000 and len(encode.words) + len(encode.old) < 2000


def test_two_merges_of_one_token_are_refused(tmp_path):
    file = tmp_path / "t.json"
    file.write_text(Tokenizer.from_file(packing.default_tokenizer()).to_str().replace('"merges":[', '"merges":[["t","h"],', 1))
    with pytest.raises(ValueError):
        word_bpe.WordIds(str(file))
