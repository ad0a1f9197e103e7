"""Shared helpers: narrow text inputs, bounded Arrow slices, per-process state."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.session import open_store  # noqa: F401

SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, as (doc_id long, text string).

    A null text is the empty text. Whatever else the table has, also columns
    named like an operator's results, goes no further.
    """
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def bounded(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows of about ``limit`` text bytes,
    so that what Python builds from a batch stays small however long texts are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(start), int(end - start))


def raw_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, length of each string) of an array or a slice of one."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    data = strings.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)


def strings_of(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings laid end to end as an array."""
    places = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))


def shared_file(path: str) -> str:
    """Where a task finds a file: at ``path``, or as added to the session with
    ``addFile`` under that name."""
    import os

    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, ``name`` or longer."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_process(name, make: Callable):
    """A value made once per Python worker and kept for its later tasks.

    Task functions are shipped by value, so their own globals do not last.
    """
    held = sys.modules.setdefault("_furrow_held", types.ModuleType("_furrow_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through files that every executor can read.

    The folder is the session's ``spark.checkpoint.dir``; only a local session
    without one (tests) gets a folder of its own.
    """
    from furrow.session import checkpoint_folder

    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
