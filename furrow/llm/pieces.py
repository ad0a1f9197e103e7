"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; from it come the normaliser, the marker of
white space, the vocabulary with its scores (unigram) or the merges that the
scores imply (BPE), and byte fallback. Batches are encoded by the library, with
as many threads as a task has cores. Parity with the sentencepiece library is
verified for every distinct word that a worker encodes. Ids whose pieces are
text or bytes decode to those; bytes that make no text are left to the library.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from furrow.llm.common import bounded, per_process, raw_bytes, shared_file, strings_of, texts
from furrow.llm.wordids import JOINED, MEMO_WORDS, Memo, _ranges

MARK = "▁"
# Numbers of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        if size is None:
            if tag & 7 != 2:
                raise ValueError(f"wire type {tag & 7}")
            size = varint()
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk: int = 0
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def splits_at_blanks(self) -> bool:
        """No piece, and no normalisation, reaches across the start of a marker run."""
        crossing = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        return not (crossing or self.charsmap or self.squeeze or self.suffix) and self.escape


def parse(raw: bytes) -> Model:
    model = Model()
    for number, value in wire(raw):
        if number == 1:
            part = dict(wire(value))
            model.pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part.get(2, bytes(4)))[0], part.get(3, NORMAL)))
        elif number == 2:
            part = dict(wire(value))
            model.kind, model.byte_fallback = part.get(3, UNIGRAM), bool(part.get(35, 0))
            model.unk, model.suffix = part.get(40, 0), bool(part.get(24, 0))
        elif number == 3:
            part = dict(wire(value))
            model.charsmap = part.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(part.get(n, 1)) for n in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model: every way to put a piece together from two
    others, better pieces first, and for one piece the better halves first."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    order = sorted(rank, key=lambda p: (-model.pieces[rank[p]][1], rank[p]))
    out = []
    for piece in order:
        halves = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
        halves = [(a, b) for a, b in halves if a in rank and b in rank]
        out += sorted(halves, key=lambda h: (rank[h[0]], rank[h[1]]))
    return out


def build(model: Model, prefix: bool = True):
    """The tokenizers-library form of a model; without ``prefix`` no marker is
    put before a text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model),
            unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.kind}")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


class PieceIds(Memo):
    """Encoder and decoder of a model; flags say where both libraries agree."""

    def __init__(self, raw: bytes, memo: int = MEMO_WORDS, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        from tokenizers import pre_tokenizers

        self.model = parse(raw)
        self.threads = threads
        self.whole = build(self.model)
        self.inner = build(self.model, prefix=False)
        self.joint = build(self.model, prefix=False)  # many words in one string
        self.joint.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.by_word = self.model.splits_at_blanks
        self.starts_word = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        spelt = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.sizes = np.array([len(x) for x in spelt], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        super().__init__(memo)

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words with the blanks before them; the whole text where the model
        does not split at blanks."""
        if not self.by_word:
            return texts.cast(pa.large_string()), np.ones(len(texts), np.int64)
        raw, sizes = raw_bytes(texts)
        if self.model.dummy_prefix:  # a blank before every text that is not empty
            longer = sizes + (sizes > 0)
            own = np.ones(longer.sum(), bool)
            own[(np.cumsum(longer) - longer)[sizes > 0]] = False
            given, sizes = raw, longer
            raw = np.full(len(own), 32, np.uint8)
            raw[own] = given
        blank = raw == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        ends = np.cumsum(sizes)
        begins[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        per_text = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
        return strings_of(raw, np.diff(np.concatenate((starts, [len(raw)])))), per_text

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        simple = np.zeros(len(words), bool)
        if self.by_word and self.model.dummy_prefix:  # one blank, then no marker
            simple = pc.match_substring_regex(words, f"^ [^ {MARK}]+$").to_numpy(zero_copy_only=False)
        names, own = words.to_pylist(), np.flatnonzero(simple)
        parts = [own[i : i + JOINED] for i in range(0, len(own), JOINED)]
        joined = ["".join([names[i] for i in part.tolist()]) for part in parts]
        counts, good = np.zeros(len(words), np.int64), np.ones(len(words), bool)
        found, order = [], []
        every = self.joint.encode_batch_fast(joined, add_special_tokens=False)
        checks = self.other.encode([text[1:] for text in joined], num_threads=self.threads)  # it puts the first blank itself
        for part, got, check in zip(parts, every, checks):
            ids = np.asarray(got.ids, np.uint32)
            first = np.flatnonzero(self.starts_word[ids])
            if len(first) == len(part) and got.ids == check:
                counts[part] = np.diff(np.concatenate((first, [len(ids)])))
            else:
                ids, counts[part], good[part] = self._one_by_one([names[i] for i in part.tolist()])
            found.append(ids)
            order.append(part)
        rest = np.flatnonzero(~simple)
        if len(rest):
            ids, counts[rest], good[rest] = self._one_by_one([names[i] for i in rest.tolist()])
            found.append(ids)
            order.append(rest)
        order = np.concatenate([np.zeros(0, np.int64), *order])
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([np.zeros(0, np.uint32), *found])[_ranges(starts, counts)], counts, good

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokenizer = self.inner if self.by_word else self.whole
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        if self.by_word and self.model.dummy_prefix:
            check = self.other.encode([w[1:] if w[:1] == " " else w for w in words], num_threads=self.threads)
            lone = [self.other.piece_to_id(MARK)]
            check = [lone if w == " " else c for w, c in zip(words, check)]
        else:
            check = self.other.encode(words, num_threads=self.threads)
        ids = np.array([i for f in found for i in f], np.uint32)
        return ids, np.array([len(f) for f in found], np.int64), np.array([a == b for a, b in zip(found, check)], bool)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text of each run of ids in UTF-8, as ``decode`` gives it."""
        sizes = self.sizes[ids]
        spelt = self.spelt[_ranges(self.places[ids], sizes)].tobytes()
        total = np.concatenate(([0], np.cumsum(sizes)))
        bytes_before = np.concatenate(([0], np.cumsum(self.is_byte[ids])))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        out = []
        for a, b, start, end, byte in zip(
            total[starts].tolist(), total[ends].tolist(), starts.tolist(), ends.tolist(),
            (bytes_before[ends] > bytes_before[starts]).tolist(),
        ):
            own = spelt[a + (self.model.dummy_prefix and spelt[a : min(a + 1, b)] == b" ") : b]
            # runs of byte pieces that are no characters have a rule of the library's own
            out.append(own if not byte or _is_text(own) else self.decode([ids[start:end].tolist()])[0].encode())
        return out


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def piece_ids(path: str) -> PieceIds:
    """The encoder of this worker for a model file (see ``shared_file``)."""

    def make() -> PieceIds:
        with open(shared_file(path), "rb") as file:
            return PieceIds(file.read(), threads=task_cores())

    return per_process(("pieces", path), make)


def task_cores() -> int:
    """The cores that Spark gives a task."""
    from pyspark import TaskContext

    return TaskContext.get().cpus() if TaskContext.get() else 1


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, parity of every whole text.

    ``parity`` says that the sentencepiece library gives the same ids. Null and
    empty texts have no ids. Repeated rows and null ids come back as they are;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        encoder = piece_ids(path)
        for batch in bounded(batches):
            ends, ids, same = encoder.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(same)], ["doc_id", "ids", "parity"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, parity boolean")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every list of ids.

    A null or empty list is the empty text. Repeated rows and null ids come back
    as they are; an empty table gives no rows; other columns are ignored. Ids
    outside the model, and nulls within a list, are an error.
    """

    def run(batches):
        decoder = piece_ids(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                lists = [np.asarray(x or [], np.uint32) for x in part.column("ids").to_pylist()]
                ends = np.cumsum([len(x) for x in lists])
                decoded = [t.decode() for t in decoder.spell(np.concatenate(lists), ends)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(decoded, pa.string())], ["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(
        run, "doc_id long, text string"
    )


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, parity, same_text of every text.

    Encodes and decodes in one pass, so that ids never leave the task.
    ``ids_crc32`` is over little-endian unsigned 32-bit ids, ``same_text`` says
    that the decoded text is the given one. Rows as in ``encode``.
    """

    def run(batches):
        encoder = piece_ids(path)
        for batch in bounded(batches, limit=4 << 20):
            ends, ids, same = encoder.encode(batch.column("text"))
            content, sizes = raw_bytes(batch.column("text"))
            content, places = memoryview(content.tobytes()), np.concatenate(([0], np.cumsum(sizes))).tolist()
            given = [content[a:b] for a, b in zip(places, places[1:])]
            starts = [0, *ends.tolist()]
            decoded = encoder.spell(ids, ends)
            raw = memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(starts), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded]),
                    pa.array(same), pa.array([a == b for a, b in zip(given, decoded)]),
                ],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "parity", "same_text"],
            )

    return texts(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, parity boolean, same_text boolean"
    )
