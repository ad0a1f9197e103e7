"""Token-id files in patched frame-of-reference blocks.

File layout, little-endian:

    magic
    blocks      each: minimum u32, width u8, ids u16, exceptions u16,
                packed offsets from the minimum (u64 words),
                exception positions u16[], whole offsets u32[]
    block index u64[blocks + 1]        where each block starts
    documents   doc_id i64[], id present u8[], number of ids i64[]
    trailer     blocks, documents, ids, ids a block, start of index: u64; magic

A block packs the offsets of its ids from the smallest at the width that covers
``percentile`` of them; wider ones are stored whole in the exception list.

Documents are range-partitioned by id (rows of one id by the start and a hash
of their text), so file k holds no larger ids than file k + 1, and a document's
place in the corpus is its place in the file plus the ids of the files before. A
task rolls over to its next file after ``FILE_IDS`` ids; a document is never split
between files. Files are written beside their final name and then renamed, so a
repeated or speculative task leaves whole files only.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm.common import bounded, open_store, texts
from furrow.llm.wordids import word_ids
from furrow.session import shared_folder

MAGIC = b"FPFORv01"
BLOCK = 256
PERCENTILE = 0.9
END_ID = 2
#: Ids after which a task starts its next file.
FILE_IDS = 8_000_000
_HEAD, _TAIL = "<IBHH", "<QQQQQ"
_HEAD_SIZE, _TAIL_SIZE = struct.calcsize(_HEAD), struct.calcsize(_TAIL)


def _lanes(width: int):
    """(lane, word, shift) of each packed value."""
    return ((lane, lane * width // 64, np.uint64(lane * width % 64)) for lane in range(BLOCK if width else 0))


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width as (blocks, 4 * width) u64 words."""
    words = np.zeros((width * BLOCK // 64, len(values)), np.uint64)
    lanes = np.ascontiguousarray(values.T.astype(np.uint64))
    for lane, word, shift in _lanes(width):
        words[word] |= lanes[lane] << shift
        if int(shift) + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - int(shift))
    return np.ascontiguousarray(words.T)


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane, word, shift in _lanes(width):
        got = words[word] >> shift
        if int(shift) + width > 64:
            got = got | (words[word + 1] << np.uint64(64 - int(shift)))
        out[lane] = got & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of a run of ids; only the last may be short."""
    if not len(ids):
        return []
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    table = padded.reshape(blocks, BLOCK)
    least = table.min(1)
    above = table - least[:, None]
    bits = np.zeros(above.shape, np.int8)
    for b in range(32):
        bits += above >= np.uint32(1 << b)
    keep = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    widths = np.partition(bits, keep, axis=1)[:, keep]
    out: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        low = above[own] & np.uint32((1 << width) - 1)
        packed = pack_words(low, width)
        wide = bits[own] > width
        for k, i in enumerate(own.tolist()):
            count = min(BLOCK, len(ids) - i * BLOCK)
            at = np.flatnonzero(wide[k, :count])
            out[i] = b"".join((
                struct.pack(_HEAD, int(least[i]), width, count, len(at)),
                packed[k].astype("<u8").tobytes(),
                at.astype("<u2").tobytes(),
                above[i, at].astype("<u4").tobytes(),
            ))
    return out


def decode_blocks(content: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of all blocks of a file."""
    heads = [struct.unpack_from(_HEAD, content, s) for s in starts[:-1].tolist()]
    if not heads:
        return np.zeros(0, np.uint32)
    least, widths, counts, extra = (np.array(x) for x in zip(*heads))
    table = np.zeros((len(heads), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        step = width * BLOCK // 64
        words = np.stack([np.frombuffer(content, "<u8", step, int(starts[i]) + _HEAD_SIZE) for i in own])
        table[own] = unpack_words(words, width).astype(np.uint32)
    for i in np.flatnonzero(extra).tolist():
        at = int(starts[i]) + _HEAD_SIZE + int(widths[i]) * BLOCK // 8
        n = int(extra[i])
        table[i, np.frombuffer(content, "<u2", n, at)] = np.frombuffer(content, "<u4", n, at + 2 * n)
    table += least.astype(np.uint32)[:, None]
    flat = table.reshape(-1)
    return flat[: (len(heads) - 1) * BLOCK + int(counts[-1])]


class IdFileWriter:
    """Writes one file as ids come; holds less than a block and the document table."""

    def __init__(self, sink, percentile: float = PERCENTILE):
        self.sink, self.percentile = sink, percentile
        self.rest = np.zeros(0, np.uint32)
        self.starts, self.docs, self.present, self.counts = [len(MAGIC)], [], [], []
        sink.write(MAGIC)

    def _blocks(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids, self.percentile):
            self.sink.write(block)
            self.starts.append(self.starts[-1] + len(block))

    def add(self, docs: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs += [d or 0 for d in docs]
        self.present += [d is not None for d in docs]
        self.counts += counts.tolist()
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:].copy()

    def close(self) -> None:
        self._blocks(self.rest)
        total = sum(self.counts)
        for values, kind in ((self.starts, "<u8"), (self.docs, "<i8"), (self.present, "u1"), (self.counts, "<i8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(struct.pack(_TAIL, len(self.starts) - 1, len(self.docs), total, BLOCK, self.starts[-1]) + MAGIC)


def read_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, number of ids of each, all ids) of one file."""
    tail = len(content) - _TAIL_SIZE - len(MAGIC)
    if content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a token-id file, or cut short")
    blocks, docs, total, block, at = struct.unpack_from(_TAIL, content, tail)
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    starts = np.frombuffer(content, "<u8", blocks + 1, at)
    at += 8 * (blocks + 1)
    names = np.frombuffer(content, "<i8", docs, at).tolist()
    present = np.frombuffer(content, "u1", docs, at + 8 * docs).tolist()
    counts = np.frombuffer(content, "<i8", docs, at + 9 * docs)
    ids = decode_blocks(content, starts)
    if len(ids) != total:
        raise ValueError("block index and trailer differ")
    return [n if p else None for n, p in zip(names, present)], counts, ids


def read_block(content: bytes, number: int) -> np.ndarray:
    """One block through the index, without decoding the others."""
    blocks, _, _, _, at = struct.unpack_from(_TAIL, content, len(content) - _TAIL_SIZE - len(MAGIC))
    if not 0 <= number < blocks:
        raise IndexError(number)
    return decode_blocks(content, np.frombuffer(content, "<u8", 2, at + 8 * number))


def write(
    df: DataFrame,
    folder: str,
    path: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    percentile: float = PERCENTILE,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode all documents into files under ``folder``/ids in ascending id order.

    Runs at once; returns the manifest (file, n_docs, n_ids), also kept as
    Parquet under ``folder``/manifest. Null ids come first; rows of one id by the
    first twelve characters of the text, then a hash of it, then the text. Null
    and empty texts are the end id alone; repeated rows are written once each;
    an empty table writes no file. Other columns are ignored.
    """

    def put(batches):
        encoder, writer, number = word_ids(path), None, 0
        store, base = open_store(f"{folder}/ids")
        end_mark = np.uint32(end_id)

        def finish() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}.pfor"
            writer.close()
            writer.sink.close()
            store.move(trial, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(writer.docs)], "n_ids": [sum(writer.counts)]})

        for batch in bounded(batches):
            if writer is None:
                store.create_dir(base, recursive=True)
                trial = f"{base}/_{uuid.uuid4().hex}"
                writer, held = IdFileWriter(store.open_output_stream(trial), percentile), 0
            ends, ids, _ = encoder.encode(batch.column("text"))
            counts = np.diff(ends, prepend=0) + 1
            writer.add(batch.column("doc_id").to_pylist(), counts, np.insert(ids, ends, end_mark))
            held += int(counts.sum())
            if held >= file_ids:
                yield finish()
                writer, number = None, number + 1
        if writer is not None:
            yield finish()

    docs = texts(df, id_col, text_col)
    order = [F.asc_nulls_first("doc_id"), F.substring("text", 1, 12), F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(put, "file string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


def read_back(spark, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32."""
    manifest = spark.read.schema("file string, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # one short row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))

    def get(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                docs, counts, ids = read_file(content.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file.rpartition("/")[2]] * len(docs)), pa.array(docs, pa.int64()),
                        pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64()),
                    ],
                    ["file", "doc_id", "own_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(f"{folder}/ids/part-*.pfor").select("path", "content")
    rows = files.mapInArrow(get, "file string, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "file").select(
        "doc_id", (F.col("file_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def write_and_read(df: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write all documents, then read every file back (see ``write``, ``read_back``)."""
    folder = folder or shared_folder(df.sparkSession)
    write(df, folder, path, **options)
    return read_back(df.sparkSession, folder)
