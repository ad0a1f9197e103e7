import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from furrow.llm import packing
from furrow.llm.queries import QUERIES, WORD_TOKENIZER
from tests.llm.conftest import ODD_TEXTS, SF


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(WORD_TOKENIZER)


def check(rows, docs, tokenizer, window):
    parts, places = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(parts[doc], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(range(0, len(ids), window))
        for r in own:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert (len(piece), zlib.crc32(piece.tobytes()), r["doc_tokens"]) == (r["length"], r["ids_crc32"], len(ids))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return places


def test_query(spark, given, whole):
    places = check(QUERIES["op4_packing"](spark, SF).collect(), given, whole, 2048)
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= -(-total // 2048) * 1.02 + 1


def test_tightest_window_is_taken():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400).tolist()
    number, offset = packing.best_fit_decreasing(lengths, 100)
    # the plain way: look at every open window
    left, expected = [], [None] * len(lengths)
    for i in np.argsort(-np.array(lengths), kind="stable"):
        fit = [(c, w) for w, c in enumerate(left) if c >= lengths[i]]
        if fit:
            c, w = min(fit)
            expected[i] = c
            left[left.index(c)] -= lengths[i]
        else:
            expected[i] = 100
            left.append(100 - lengths[i])
    assert [100 - o for o in offset.tolist()] == expected
    assert len(set(number.tolist())) == len(left)


def test_blocks_and_sequences(make_docs, whole):
    docs = [(i, "word " * (i % 37)) for i in range(300)]
    packed = packing.pack(make_docs(docs), WORD_TOKENIZER, window=16, block_docs=50, keep_ids=True)
    rows = packed.collect()
    check(rows, docs, whole, 16)
    out = packing.sequences(packed, 16).collect()
    assert all(len(r["ids"]) == 16 for r in out)
    assert sum(r["n_ids"] for r in out) == sum(r["length"] for r in rows)


def test_odd_rows(odd, none, whole):
    rows = packing.pack(odd, WORD_TOKENIZER).collect()
    firsts = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert firsts == Counter(i for i, _ in ODD_TEXTS)
    for doc, text in ODD_TEXTS:
        n = len(whole.encode(text or "", add_special_tokens=False).ids) + 1
        assert n in {r["doc_tokens"] for r in rows if r["doc_id"] == doc}
    assert packing.pack(none, WORD_TOKENIZER).count() == 0
