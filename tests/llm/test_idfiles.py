import io
import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from furrow.llm import idfiles
from furrow.llm.queries import QUERIES, WORD_TOKENIZER
from tests.llm.conftest import ODD_TEXTS, SF


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(WORD_TOKENIZER)


def test_query(spark, given, whole):
    rows = {r["doc_id"]: r for r in QUERIES["op10_token_id_output"](spark, SF).collect()}
    start = 0
    for doc, text in given:
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        r = rows[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("width", [0, 1, 5, 13, 16, 31, 32])
def test_words_round_trip(width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 1 << width, (7, idfiles.BLOCK), dtype=np.uint64)
    assert (idfiles.unpack_words(idfiles.pack_words(values, width), width) == values).all()


@pytest.mark.parametrize("ids", [
    np.zeros(0), np.arange(1), np.full(300, 7), np.arange(5000), np.array([0, 2**32 - 1] * 200), np.r_[np.zeros(255), 2**32 - 1, 5],
    np.random.default_rng(1).zipf(1.3, 20_000) % 2**32,
])
def test_file_round_trip(ids):
    ids = ids.astype(np.uint32)
    sink = io.BytesIO()
    writer = idfiles.IdFileWriter(sink)
    cut = len(ids) // 3
    writer.add([5, None], np.array([cut, 0]), ids[:cut])
    writer.add([-1], np.array([len(ids) - cut]), ids[cut:])
    writer.close()
    docs, counts, back = idfiles.read_file(sink.getvalue())
    assert docs == [5, None, -1] and counts.tolist() == [cut, 0, len(ids) - cut] and (back == ids).all()
    if len(ids) > 2 * idfiles.BLOCK:
        assert (idfiles.read_block(sink.getvalue(), 1) == ids[idfiles.BLOCK : 2 * idfiles.BLOCK]).all()
    with pytest.raises(ValueError):
        idfiles.read_file(sink.getvalue()[:-1])


def test_outliers_go_to_the_exception_list():
    ids = np.arange(idfiles.BLOCK, dtype=np.uint32) % 8
    ids[10] = 1 << 30
    assert len(idfiles.encode_blocks(ids)[0]) < 9 + idfiles.BLOCK * 3 // 8 + 7


def test_files_stay_and_are_ordered(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"text {i}") for i in range(50, 0, -1)]).repartition(5)
    manifest = idfiles.write(docs, str(tmp_path), WORD_TOKENIZER).collect()
    assert sorted(r["file"] for r in manifest) == sorted(os.path.basename(f) for f in os.listdir(tmp_path / "ids") if f.endswith(".pfor"))
    rows = sorted(idfiles.read_back(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == list(range(1, 51))


def test_odd_rows(odd, none, whole):
    rows = sorted(idfiles.write_and_read(odd, WORD_TOKENIZER).collect(), key=lambda r: r["start"])
    expected = sorted(((i, t or "") for i, t in ODD_TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r["doc_id"] for r in rows] == [i for i, _ in expected]
    start = 0
    for r, (_, text) in zip(rows, expected):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert idfiles.write_and_read(none, WORD_TOKENIZER).count() == 0
