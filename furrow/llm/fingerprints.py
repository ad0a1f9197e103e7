"""SimHash document fingerprints, and search within a Hamming radius.

Terms are word pairs. Each is hashed to ``BITS`` bits and votes on every bit
with weight 1 + log(count); the sign of the sum is the fingerprint's bit. Where
words say little, in texts of few words and within very long words, runs of bytes
are terms of lower weight beside them.

``within`` finds all fingerprints within a radius by permuted block tables: the
bits are cut into radius + 1 blocks, two fingerprints within the radius agree in
at least one block, and table t is keyed by block t.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.llm.common import bounded, checkpoint, texts

BITS = 128
SEED = 20
#: Bytes of a run, its weight beside a word pair's, the number of words from which
#: a text needs none, the length from which a word has its own, and the bytes
#: under which runs say no more than the words do.
RUN, RUN_WEIGHT, FEW_WORDS, LONG_WORD, LEAST_BYTES = 4, 0.5, 128, 32, 16
#: Code points of a text by which rows of one id fall into ranges.
BORDER_CHARS = 12
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _byte_runs(words: list[bytes], distinct) -> list[tuple[np.ndarray, np.ndarray]]:
    """(code, weight) of the byte runs of a text: all of them in a text of few
    words, fading out towards ``FEW_WORDS``, and those within long words."""
    parts = [(b" ".join(words), RUN_WEIGHT * (1 - len(words) / FEW_WORDS))] if len(words) < FEW_WORDS else []
    if max(map(len, distinct)) >= LONG_WORD:
        parts.append((b" ".join(w for w in words if len(w) >= LONG_WORD), RUN_WEIGHT))
    out = []
    for raw, weight in parts:
        data = np.frombuffer(raw, np.uint8).astype(np.uint64)
        if len(data) >= LEAST_BYTES:
            runs = sum(data[k : len(data) - RUN + 1 + k] << np.uint64(8 * k) for k in range(RUN))
            codes, counts = np.unique(runs, return_counts=True)
            out.append((codes, weight * (1 + np.log(counts))))
    return out


def fingerprint(text: str) -> bytes:
    """``BITS`` / 8 bytes; all zero for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(BITS // 8)
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    hashes = np.array([xxh64_intdigest(w, SEED) for w in number], np.uint64)
    if len(words) > 1:
        pair, counts = np.unique(codes[:-1] * len(number) + codes[1:], return_counts=True)
        first, second = hashes[pair // len(number)], hashes[pair % len(number)]
    else:
        first, second, counts = hashes, hashes, np.ones(1)
    runs = _byte_runs(words, number)
    with np.errstate(over="ignore"):
        term = np.concatenate([_mix(first * _MIX[0] + second), *(_mix(codes * _MIX[0]) for codes, _ in runs)])
        halves = [_mix(term + np.uint64(k) * _MIX[0]) for k in range(BITS // 64)]
    weights = np.concatenate([1 + np.log(counts), *(w for _, w in runs)]).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(term), 1 << 15):
        part = np.stack([h[at : at + (1 << 15)] for h in halves], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        w = weights[at : at + (1 << 15)]
        votes += 2 * (w @ bits.astype(np.float32)).astype(np.float64) - w.sum(dtype=np.float64)
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by as many (or all) of
    the first ones of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as hex) of every whole text.

    Null and empty texts, and those without words, have the fingerprint zero.
    Null ids and repeated rows come back as they are; an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches):
        for batch in bounded(batches):
            found = [fingerprint(t).hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _compare(doc, text: str, own: bytes, following: str, next_print: bytes) -> tuple:
    changed = edited(text, following)
    print_of = fingerprint(changed)
    return (
        doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), print_of.hex(),
        likeness(own, print_of), likeness(own, next_print),
    )


_RESULT = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likenesses.

    Documents are taken in descending doc_id, equal ids by descending text, null
    ids last; the one after the last is the first. Null texts are empty, an
    empty text stays empty when edited. Repeated rows follow one another; a
    single document follows itself; an empty table gives no rows; other columns
    are ignored.

    The texts are range-partitioned by id and sorted once. A task pairs each row
    with the next one of its range; only the first and last text of a range
    leave it, to be paired with those of the neighbouring ranges.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc("text")]
    # ranges also divide rows of one id, by the start of the text: whole texts would fill the driver's sample
    borders = [order[0], F.desc(F.substring("text", 1, BORDER_CHARS))]
    ordered = texts(df, id_col, text_col).repartitionByRange(*borders).sortWithinPartitions(*order)
    names = [n for n, _ in _RESULT]
    edge = ["part", "first_text", "last_id", "last_text"]
    schema = pa.schema([*_RESULT, ("part", pa.int64()), ("first_text", pa.string()), ("last_id", pa.int64()), ("last_text", pa.string())])

    def run(batches):
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in bounded(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = fingerprint(text)
                if held is None:
                    first = text
                else:
                    rows.append(_compare(*held, text, own))
                held = (doc, text, own)
            if rows:
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RESULT)]
                cols += [pa.nulls(len(rows), schema.field(n).type) for n in edge]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
        if held is not None:
            last = {"part": part, "first_text": first, "last_id": held[0], "last_text": held[1]}
            yield pa.RecordBatch.from_pylist([last], schema)

    found = checkpoint(ordered.mapInArrow(run, f"{_RESULT_DDL}, part long, first_text string, last_id long, last_text string"))
    edges = found.where("part is not null").select(*edge)
    # one number a range; the texts join by it
    every, ahead = Window.partitionBy(F.lit(0)), Window.orderBy("part")
    follows = edges.select("part").select(
        "part", F.coalesce(F.lead("part").over(ahead), F.min("part").over(every)).alias("next_part")
    )
    heads = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    pairs = edges.join(follows, "part").join(heads, "next_part").select("last_id", "last_text", "following")

    def stitch(batches):
        for batch in bounded(batches, "last_text"):
            rows = [
                _compare(doc, text, fingerprint(text), following, fingerprint(following))
                for doc, text, following in zip(*(batch.column(c).to_pylist() for c in ("last_id", "last_text", "following")))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RESULT)], names)

    return found.where("part is null").select(*names).union(pairs.mapInArrow(stitch, _RESULT_DDL))


def _blocks(hexed: Column, radius: int) -> list[Column]:
    """The hex digits cut into radius + 1 pieces."""
    digits = BITS // 4
    cuts = [digits * i // (radius + 1) for i in range(radius + 2)]
    return [F.substring(hexed, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]


def _differing(a: Column, b: Column) -> Column:
    """Number of differing bits of two hex strings, in pieces of 60 bits."""
    total = F.lit(0)
    for at in range(1, BITS // 4 + 1, 15):
        x, y = (F.conv(F.substring(c, at, 15), 16, 10).cast("long") for c in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def within(queries: DataFrame, stored: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (query, found, bits) of fingerprints at most ``radius`` bits apart.

    Both sides have a column ``fingerprint``; equal ones count once, so copies
    are never expanded: join the owners of a fingerprint back by it. Null
    fingerprints take no part. A pair that agrees in several blocks is reported
    from the first of them.
    """
    if not 0 <= radius < BITS // 4:
        raise ValueError("radius")

    def tables(side: DataFrame, name: str) -> DataFrame:
        own = side.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = F.array(*[F.struct(F.lit(t).alias("t"), k.alias("key")) for t, k in enumerate(_blocks(F.col(name), radius))])
        return own.select(name, F.explode(keys).alias("at")).select(name, "at.t", "at.key")

    met = tables(queries, "query").join(tables(stored, "found"), ["t", "key"])
    same = [a == b for a, b in zip(_blocks(F.col("query"), radius), _blocks(F.col("found"), radius))]
    first = F.coalesce(*[F.when(s, F.lit(t)) for t, s in enumerate(same)])
    bits = _differing(F.col("query"), F.col("found"))
    return met.where((F.col("t") == first) & (bits <= radius)).select("query", "found", bits.alias("bits"))
