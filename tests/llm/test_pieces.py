import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from furrow.llm import pieces
from furrow.llm.queries import PIECE_MODEL, QUERIES
from tests.llm.conftest import ODD_TEXTS, SF


@pytest.fixture(scope="module")
def other():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def own():
    with open(PIECE_MODEL, "rb") as file:
        return pieces.PieceIds(file.read())


def test_query(spark, given, other):
    rows = {r["doc_id"]: r for r in QUERIES["op9_sentencepiece"](spark, SF).collect()}
    assert len(rows) == len(given)
    for doc, text in given:
        ids, r = np.array(other.encode(text), "<u4"), rows[doc]
        assert (r["n_ids"], r["ids_crc32"], r["parity"]) == (len(ids), zlib.crc32(ids.tobytes()), True)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["same_text"]


ODD = ["", " ", "  ", "a ", " a", "a  b   c", "▁", "a▁b ▁c", "tab\there", "\n\n", "😀 漢字", "<s> </s> <unk>", "x" * 5000, "  \xa0 a", "é é", "\x00 \x01", " a "]


def test_ids_and_text_of_odd_texts(own, other):
    ends, ids, same = own.encode(pa.array(ODD))
    start = 0
    for text, end, ok in zip(ODD, ends.tolist(), same.tolist()):
        assert ids[start:end].tolist() == other.encode(text), text
        assert ok
        assert own.decode([ids[start:end].tolist()])[0] == other.decode(ids[start:end].tolist())
        start = end


def test_model_is_parsed(own, other):
    model = own.model
    assert [p for p, _, _ in model.pieces] == [other.id_to_piece(i) for i in range(other.vocab_size())]
    assert model.kind == pieces.BPE and model.byte_fallback and model.splits_at_blanks


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model():
    words = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    words += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words += [("▁", -2.0, 1), ("▁the", -1.0, 1), ("▁th", -3.0, 1), ("e", -2.5, 1), ("t", -3.0, 1), ("h", -3.0, 1), ("er", -2.6, 1), ("r", -3.5, 1), ("▁ther", -5.2, 1)]
    parts = [(1, message((1, w.encode()), (2, s), (3, k))) for w, s, k in words]
    return message(*parts, (2, message((3, 1), (35, 1), (40, 0))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def test_unigram_model(other):
    raw = unigram_model()
    own, check = pieces.PieceIds(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert own.model.kind == pieces.UNIGRAM
    texts = ["the", "there the  ther", "", "é the", "hret the eee", " "]
    ends, ids, same = own.encode(pa.array(texts))
    start = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[start:end].tolist() == check.encode(text), text
        start = end
    assert same.all()


def test_encode_and_decode(odd, none, other):
    encoded = pieces.encode(odd, PIECE_MODEL)
    rows = encoded.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD_TEXTS)
    assert all(r["parity"] for r in rows)
    texts = Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded, PIECE_MODEL).collect())
    assert texts == Counter((i, t or "") for i, t in ODD_TEXTS)
    assert pieces.encode(none, PIECE_MODEL).count() == 0 and pieces.round_trip(none, PIECE_MODEL).count() == 0
