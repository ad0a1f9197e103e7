"""Packing of token sequences by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of
it is placed, longest piece first, into the open window that it fills best.
The open windows lie in a segment tree indexed by remaining capacity, so the
tightest one is found in O(log window). Token ids stay where the text is read;
only (document, start, length) rows are shuffled, dealt by hash into blocks of
about ``block_docs`` documents, and each block is packed by one task. The hash
takes in where a row was read, so that equal rows spread over all blocks. Padding
is at most a few open windows a block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from furrow.llm.common import bounded, texts
from furrow.llm.wordids import word_ids

WINDOW = 2048
END_ID = 1
#: Documents in a block that one task packs.
BLOCK_DOCS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity; a max-free segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.filled = [0] * (2 * self.size)  # windows at or below each node
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.filled[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._count(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with ``least`` left."""
        filled, node = self.filled, least + self.size
        if not filled[node]:
            while node > 1 and (node & 1 or not filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.at[capacity].pop()
        self._count(capacity, -1)
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length; lengths in any order, 1..window."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, used = OpenWindows(window), 0
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        length = lengths[i]
        found = windows.take(length)
        if found is None:
            capacity, number[i], used = window, used, used + 1
        else:
            capacity, number[i] = found
        offset[i] = window - capacity
        if capacity > length:
            windows.put(capacity - length, number[i])
    return number, offset


def tokenized_pieces(
    docs: DataFrame, path: str, window: int, end_id: int, keep_ids: bool = False
) -> DataFrame:
    """One row per piece before packing: full windows and the rest of each document."""

    def cut(batches):
        encoder, seen, part = word_ids(path), 0, TaskContext.get().partitionId()
        for batch in bounded(batches):
            ends, ids, _ = encoder.encode(batch.column("text"))
            ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
            tokens = np.diff(ends, prepend=0) + 1
            pieces = -(-tokens // window)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, tokens[doc] - start)
            places = np.concatenate(([0], np.cumsum(length)))  # pieces lie end to end
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(places.tolist(), places[1:].tolist())]
            salt = part * 1_000_003 + seen + np.arange(len(doc))
            seen += len(doc)
            arrays = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                pa.array(tokens[doc]), pa.array(salt),
            ]
            if keep_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
    return docs.mapInArrow(cut, schema + (", ids array<long>" if keep_ids else ""))


def pack(
    df: DataFrame,
    path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_docs: int = BLOCK_DOCS,
    keep_ids: bool = False,
) -> DataFrame:
    """Place every id of every document into windows of ``window`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids with ``keep_ids``). A document's ids are those
    of the tokenizer file at ``path`` followed by ``end_id``.

    Null and empty texts are the end id alone. A null id packs like any other.
    Repeated rows are packed once for each row. Ties among equal lengths go by
    doc_id, then start. An empty table gives no rows; other columns are ignored.
    """
    docs = texts(df, id_col, text_col)
    blocks = max(1, -(-docs.count() // block_docs))
    pieces = tokenized_pieces(docs, path, window, end_id, keep_ids)
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(blocks)).alias("block")

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first")
        number, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = (np.int64(key[0]) << 32) + number
        pdf["offset"] = offset
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns=["block", "salt"])

    out = PIECES + (", ids array<long>" if keep_ids else "")
    order = [c.split()[0] for c in out.split(", ")]
    return pieces.select("*", block).groupBy("block").applyInPandas(lambda k, p: place(k, p)[order], out)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The padded windows themselves, from ``pack(..., keep_ids=True)``:
    sequence_id, ids (``window`` of them), n_ids before padding.

    A window's pieces, at most ``window`` of them, meet in one group, in order of
    their offsets. Rows of a packing appear once each; an empty packing gives no
    rows; columns beside sequence_id, offset and ids are ignored. A packing
    without ids, or with a null in one of the three, is an error of the caller.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("own"))
        .select(
            "sequence_id",
            F.concat("own", F.array_repeat(F.lit(pad_id).cast("long"), F.lit(window) - F.size("own"))).alias("ids"),
            F.size("own").alias("n_ids"),
        )
    )
