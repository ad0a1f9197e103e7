"""SimHash near-duplicates by covering locality-sensitive hashing.

Position i of a fingerprint carries a non-zero vector of radius + 1 bits, and
table v keeps the positions whose vector has odd parity with v. For any set of
at most ``radius`` differing positions some v is orthogonal to all their
vectors, so the pair agrees in everything that table keeps: no pair is missed.

Equal fingerprints are collapsed first. Rows of a table are dealt by their
masked key and sorted; a task walks over the buckets, links within each and
emits only the links of a spanning forest. A bucket of more than ``walk``
different fingerprints is not held: its rows are emitted with every value
``radius / 2`` flips away, and those that share such a value are within the
radius of each other, so again one link a row is enough.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm.common import bounded, checkpoint, fresh, texts
from furrow.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
#: Different fingerprints of a bucket that are compared in place.
WALK = 512


def simhash(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of a text: majority bits of its word shingles' XXH64.

    A-Z are lowered; words are runs without ASCII white space. Fewer words than
    a shingle count as one shingle; no words at all give 0.
    """
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    sizes = [len(w) + 1 for w in words]
    starts = [0, *accumulate(sizes)]
    hashes = np.array(
        [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])], "<u8"
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_mark, fp) of (doc_id, text) rows as ``texts`` gives them.

    fp is the fingerprint as a signed long, text_mark a 64-bit hash of the text.
    Null ids and repeated rows come back as they are; a text without words has
    fingerprint 0; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in bounded(batches):
            found = [simhash(t.as_buffer().to_pybytes(), shingle, seed) for t in batch.column("text")]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_mark"), prints], ["doc_id", "text_mark", "fp"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("text_mark"), "text")
    return marked.mapInArrow(run, "doc_id long, text_mark long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2**(radius + 1) - 1 masks; each keeps over half of the positions."""
    top = (1 << (radius + 1)) - 1
    vectors = [1 + i % top for i in range(bits)]
    return [sum(1 << i for i, v in enumerate(vectors) if (v & u).bit_count() & 1) for u in range(1, top + 1)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over values at most ``radius`` bits apart."""
    differ = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :])
    parent = list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for i, j in zip(*np.nonzero(np.triu(differ <= radius, 1))):
        a, b = top(int(i)), top(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(values[i]), int(values[j])))
    return links


def link(prints: DataFrame, radius: int = RADIUS, walk: int = WALK) -> DataFrame:
    """(a, b): links that join all fingerprints at most ``radius`` bits apart.

    ``prints`` has one column fp of different signed longs. Not every pair is
    listed, but the links connect exactly what the pairs connect. ``radius`` is
    even (the split of large buckets meets half-way).
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius is even")
    masks = covering_masks(radius)
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)
    ])
    dealt = prints.select("fp", F.explode(tables).alias("at")).select("at.t", "at.key", "fp")
    dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    flips = [
        np.array(
            [_signed(sum(1 << i for i in some)) for n in range(radius // 2 + 1) for some in combinations([i for i in range(BITS) if not m >> i & 1], n)],
            np.int64,
        )
        for m in masks
    ]

    def emit(kind: int, t: int, a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, t, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))],
            ["kind", "t", "a", "b"],
        )

    def meet(t: int, values: np.ndarray):
        for part in np.array_split(values, -(-len(values) // 1024)):
            yield emit(1, t, np.repeat(part, len(flips[t])), (part[:, None] ^ flips[t]).reshape(-1))

    def bucket(t: int, values: np.ndarray):
        if len(values) > 1:
            if links := forest(values, radius):
                yield emit(0, t, *zip(*links))

    def walk_over(batches):
        held: list[np.ndarray] = []  # of the bucket that is still open
        open_key, large = None, False
        for batch in batches:
            t, key, fp = (batch.column(c).to_numpy() for c in ("t", "key", "fp"))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)]):
                if start == end:
                    continue
                this, values = (int(t[start]), int(key[start])), fp[start:end]
                if this != open_key:
                    if open_key is not None and not large and sum(map(len, held)) > 1:
                        yield from bucket(open_key[0], np.concatenate(held))
                    held, open_key, large = [], this, False
                if large:
                    yield from meet(this[0], values)
                else:
                    held.append(values)
                    if sum(map(len, held)) > walk:
                        large = True
                        yield from meet(this[0], np.concatenate(held))
                        held = []
        if open_key is not None and not large and sum(map(len, held)) > 1:
            yield from bucket(open_key[0], np.concatenate(held))

    walked = checkpoint(dealt.mapInArrow(walk_over, "kind byte, t int, a long, b long"))
    near = walked.where("kind = 0").select("a", "b")
    half = walked.where("kind = 1").select("a", "t", "b")
    # fingerprints of one table that share a half-way value are all within the radius
    first = half.groupBy("t", "b").agg(F.min("a").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = half.join(first, ["t", "b"]).where("a <> first").select("a", F.col("first").alias("b"))
    return near.union(met)


def near_duplicates(
    df: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    walk: int = WALK,
    marks: bool = False,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row; with
    ``marks`` also text_mark (a 64-bit hash of the text) and component (the
    component by itself, also where no row of it has an id).

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest doc_id reachable, the document's own included.
    Texts without words, also null ones, have fingerprint 0 and are linked like
    any other. A null id is ignored as a component_id unless all ids of the
    component are null. Repeated rows come back once each; an empty table gives
    no rows; other columns are ignored.
    """
    base = checkpoint(fingerprints(texts(df, id_col, text_col), shingle, seed))
    prints = checkpoint(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link(prints.select("fp"), radius, walk))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", F.col("root").alias("component"))
    return base.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        *(["text_mark", "component"] if marks else []),
    )


def keep_one(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each component: that with the smallest id.

    ``found`` is ``near_duplicates(df, marks=True)``. Null ids come last; rows of
    one id and component go by the hash of their text, and of rows that repeat
    both any one stays. Rows of one id whose texts are in unlike components are
    decided each by itself. All columns stay as they are, whatever their names;
    an empty table gives an empty one.
    """
    parts = ["none", "id", "mark"]
    of = lambda i, mark: (i.isNull().alias("none"), F.coalesce(i.cast("long"), F.lit(0)).alias("id"), mark.alias("mark"))
    first = found.groupBy("component").agg(F.min(F.struct(*of(F.col("doc_id"), F.col("text_mark")))).alias("first"))
    first = first.select("first.*").distinct()
    names = {p: fresh(df, f"kept_{p}") for p in parts}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select("*", *(c.alias(names[p]) for p, c in zip(parts, of(F.col(id_col), F.xxhash64(text)))))
    keyed = keyed.join(first.select(*(F.col(p).alias(names[p]) for p in parts)), list(names.values()), "left_semi")
    copy = fresh(keyed, "copy")
    once = Window.partitionBy(*names.values()).orderBy(names["id"])
    kept = keyed.withColumn(copy, F.row_number().over(once)).where(F.col(copy) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in df.columns))
