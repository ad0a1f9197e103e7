import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from furrow.llm import wordids
from furrow.llm.queries import WORD_TOKENIZER
from furrow.llm.wordids import WordIds

ODD = [
    "", " ", "a", "×.", "a×.b", "÷! ÷", "İ. İstanbul!", "ſ. ĳ;", "don't I'LL we've x's.", "a.b,c;d 3.14 abc123.x", "%%%word%%% $$5$$",
    "<|endoftext|>", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "e\u0301. E\u0301x é.", ".\u0301 a.\u0338b", "漢字。カ゛ 😀!",
    "tab\there\r\nnext\x0bline\x85\u2003wide", "ΟΔΟΣ. ΣΑΣ!", "ß. ẞ Ǆ.", "x" * 3000, "\x00.\x00", "Äpfel, Öl; ÜBER! ÿ. Ÿ.",
]


@pytest.fixture(scope="module")
def content():
    with open(WORD_TOKENIZER, encoding="utf-8") as file:
        return file.read()


def same(encoder, tokenizer, texts):
    ends, ids, _ = encoder.encode(pa.array(texts))
    start = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[start:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        start = end
    assert start == len(ids)


def test_ids_are_those_of_whole_texts(content):
    encoder, tokenizer = WordIds(content), Tokenizer.from_str(content)
    assert encoder.by_word
    same(encoder, tokenizer, ODD)
    rng = random.Random(3)
    signs = "abzAZ019 .,;:!?%#$&*'\"-_/\n\t×÷éÉİıſßΣσ漢\u0301\u0338\xa0<|>😀"
    for _ in range(5):  # the memo stays from slice to slice
        same(encoder, tokenizer, ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)])
    assert encoder.place and len(encoder.place) < 20_000


def test_memo_is_bounded(content, monkeypatch):
    monkeypatch.setattr(wordids, "MEMO_BYTES", 200)
    encoder, tokenizer = WordIds(content, memo=10), Tokenizer.from_str(content)
    for i in range(6):
        same(encoder, tokenizer, [f"w{i} w{i} other{i} other{i} some some", "some " * 50])
        assert len(encoder.place) <= 20


def test_other_tokenizers_take_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = file.read()
    encoder = WordIds(content)
    assert not encoder.by_word
    same(encoder, Tokenizer.from_str(content), ODD)


def test_slices_of_an_array(content):
    encoder = WordIds(content)
    texts = pa.array([f"text {i}, and more" for i in range(30)])
    ends, ids, _ = encoder.encode(texts)
    own_ends, own, _ = encoder.encode(texts.slice(10, 5))
    assert np.array_equal(own, ids[ends[9] : ends[14]]) and np.array_equal(own_ends, ends[10:15] - ends[9])
