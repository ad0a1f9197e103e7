"""Exact repeats of a fixed length, by external induced sorting of suffixes.

Every window of ``length`` bytes is put down to its anchor: the byte run inside
it with the smallest hash, the leftmost of equals. Equal windows have equal
anchors at equal places, so only texts around an anchor that occurs twice are
gathered, and they are gathered by anchor: the suffixes that start at anchors are
the sample that is sorted (by Spark's external sort). The windows before them are
induced: tuples (suffix, common prefix with its predecessor) leave a layer in
order, and the byte before each is the key under which a priority queue holds it
for the next layer, where the common prefix is one more than the least value
between two tuples of one key. A layer's runs of tuples with a common prefix of
``length`` are the equal windows that start there. A queue that outgrows its
share of memory goes to files in the shared folder, so a group may be far larger
than memory; tuples that can no longer reach ``length`` leave early.

An anchor with a large share of all windows is not brought to one task: equal
surroundings are reduced to the first of a task, then of all, and what is left is
dealt by the digest of each window.

Texts are shuffled once, compressed, and equal texts are told by SHA-256: all but
the first are repeats as a whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm.common import checkpoint, open_store
from furrow.session import shared_folder

LENGTH = 100
#: Suffix tuples that a queue or a batch of anchors holds in memory.
HELD = 1 << 17
#: An anchor is hot with one of so many sampled windows, and at least HOT_LEAST; one text in SAMPLE is sampled.
HOT_SHARE, HOT_LEAST, SAMPLE = 4096, 64, 16
#: Text bytes that a task looks at in one go.
SLICE = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_size(length: int) -> int:
    """Bytes of an anchor: a power of two, a sixth of the length at most."""
    return 1 << max(0, (length // 6).bit_length() - 1)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, by doubling."""
    table = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD
    table = (table ^ (table >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h, base, step = (table ^ (table >> np.uint64(32)))[raw], np.array([0xD6E8FEB86659FD93], np.uint64), 1
    while step < size:
        h, base, step = h[:-step] * base + h[step:], base * base, 2 * step
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(32))


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        v, step = np.minimum(v[:-step], v[step:]), 2 * step
    return np.minimum(v[: len(v) - (width - step)], v[width - step :]) if step < width else v


def anchors(raw: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, hash, place, first, number) of each anchor of texts laid end to end.

    ``number`` windows, the first of them at ``first``, have the anchor at
    ``place``; both count from the start of ``raw``.
    """
    nothing = np.zeros(0, np.int64)
    if len(raw) < length:
        return (nothing,) * 5
    size = gram_size(length)
    hashes = gram_hashes(raw, size)
    # the upper half decides, then the place: what wins depends on the window alone
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_sliding_least(ranked, length - size + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[: len(place)] == text[length - 1 :]
    fresh = whole.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    first = np.flatnonzero(fresh)
    if not len(first):
        return (nothing,) * 5
    number = np.add.reduceat(whole.astype(np.int64), first)
    return text[first], hashes[place[first]].view(np.int64), place[first], first, number


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes filled up with zeros, length of each)."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    lengths = np.diff(offsets)
    out = np.zeros((len(values), width), np.uint8)
    if values.buffers()[2] is not None:
        data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        out[np.arange(width) < lengths[:, None]] = data
    return out, lengths


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings laid end to end as an array."""
    places = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after + 1 : upto + 1]) of each pair, by a table of doubled spans."""
    out = values[upto]
    span = upto - after
    far = np.flatnonzero(span > 1)
    level, table = 1, values
    while len(far):
        here = far[span[far] < 2 * level]
        out[here] = np.minimum(table[after[here] + 1], table[upto[here] - level + 1])
        far = far[span[far] >= 2 * level]
        if len(far):
            table, level = np.minimum(table[:-level], table[level:]), 2 * level
    return out


class Queue:
    """A priority queue of tuples for one layer, first in, first out within a key.

    What is pushed comes in ascending order of the suffixes behind it. Up to
    ``held`` tuples stay in memory, further runs are files.
    """

    def __init__(self, held: int, folder: str):
        self.held, self.folder, self.size, self.runs = held, folder, 0, []
        self.opened, self.since = np.zeros(256, bool), np.zeros(256, np.int16)

    def push(self, chosen: np.ndarray, keys: np.ndarray, tuples: dict[str, np.ndarray]) -> None:
        """The chosen tuples of a chunk; ``tuples['lcp']`` tells of their successors' order."""
        lcp = tuples["lcp"]
        order = np.argsort(keys, kind="stable")
        at, keys = chosen[order], keys[order]
        byte = keys & 255
        least = np.zeros(len(at), np.int16)
        starts = np.concatenate(([True], keys[1:] != keys[:-1])) if len(at) else np.zeros(0, bool)
        later = np.flatnonzero(~starts)
        least[later] = 1 + _least_between(lcp, at[later - 1], at[later])
        head = np.flatnonzero(starts)
        head = head[self.opened[byte[head]]]
        least[head] = 1 + np.minimum(self.since[byte[head]], np.minimum.accumulate(lcp)[at[head]])
        # what lies between the last tuple of a key and the next chunk
        self.since = np.minimum(self.since, lcp.min()).astype(np.int16)
        if len(at):
            last = np.flatnonzero(np.concatenate((starts[1:], [True])))
            behind = np.concatenate((np.minimum.accumulate(lcp[::-1])[::-1][1:], [np.iinfo(np.int16).max]))
            self.since[byte[last]] = behind[at[last]]
            self.opened[byte] = True
            run = {name: values[at] for name, values in tuples.items()} | {"lcp": least}
            first = np.flatnonzero(starts)
            index = dict(zip(keys[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(at)])))
            self.size += len(at)
            self.runs.append((index, _Run(run, self.folder if self.size > self.held else None)))

    def pop(self) -> Iterator[dict[str, np.ndarray]]:
        """All tuples by key, in chunks of about ``held``."""
        if len(self.runs) == 1:
            yield self.runs[0][1].rows(0, self.size)
        else:
            out, size = [], 0
            for key in sorted(set().union(*(index for index, _ in self.runs))):
                for index, run in self.runs:
                    if key in index:
                        out.append(run.rows(*index[key]))
                        size += len(out[-1]["lcp"])
                        if size >= self.held:
                            yield {name: np.concatenate([o[name] for o in out]) for name in out[0]}
                            out, size = [], 0
            if out:
                yield {name: np.concatenate([o[name] for o in out]) for name in out[0]}
        for _, run in self.runs:
            run.close()


class _Run:
    """Sorted tuples, in memory or, given a folder, in a file there."""

    def __init__(self, columns: dict[str, np.ndarray], folder: str | None):
        self.columns, self.file = columns, None
        if folder is not None:
            self.store, base = open_store(folder)
            self.store.create_dir(base, recursive=True)
            self.file, self.places, at = f"{base}/{uuid.uuid4().hex}", {}, 0
            with self.store.open_output_stream(self.file) as out:
                for name, values in columns.items():
                    out.write(np.ascontiguousarray(values).tobytes())
                    self.places[name] = (at, values.dtype, values.shape[1:])
                    at += values.nbytes
            self.columns = None

    def rows(self, start: int, end: int) -> dict[str, np.ndarray]:
        if self.file is None:
            return {name: values[start:end] for name, values in self.columns.items()}
        out = {}
        with self.store.open_input_file(self.file) as source:
            for name, (at, kind, shape) in self.places.items():
                width = kind.itemsize * int(np.prod(shape, dtype=int))
                got = source.read_at((end - start) * width, at + start * width)
                out[name] = np.frombuffer(got, kind).reshape(end - start, *shape)
        return out

    def close(self) -> None:
        if self.file is not None:
            self.store.delete_file(self.file)


def induce(
    sample: Iterator[dict[str, np.ndarray]], length: int, held: int, folder: str, rows: dict[str, np.ndarray] | None = None
) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(layer, tuples) of the windows that an earlier one equals.

    ``sample`` gives the tuples of the suffixes at anchors in ascending order by
    group: group, lcp, and what a tuple says of its suffix: reach (bytes before
    the anchor), left (those bytes, nearest first), owner and place (of the
    anchor), which settle the earlier window. If all suffixes fit in memory,
    ``rows`` has these instead, with ``rank`` for owner and place, and a tuple
    only its ``row`` there. Only a single group may come in several chunks.
    """
    layer = 0
    while True:
        queue, open_run = Queue(held, folder), None  # the earliest of the run that the last chunk left open
        for chunk in sample:
            of = (lambda name, at: rows[name][chunk["row"][at]]) if rows else (lambda name, at: chunk[name][at])
            lcp = chunk["lcp"]
            like = lcp >= length
            pick = lambda at: {name: chunk[name][at] for name in (("row",) if rows else ("owner", "place"))}
            if rows:
                members = np.flatnonzero(like | np.concatenate((like[1:], [False])))
                if len(members):
                    rank, starts = of("rank", members), np.flatnonzero(~like[members])
                    least = np.minimum.reduceat(rank, starts)
                    yield layer, pick(members[rank != np.repeat(least, np.diff(np.concatenate((starts, [len(members)]))))])
            else:
                owner, place = chunk["owner"], chunk["place"]
                carried = bool(like[0]) and open_run is not None
                members = np.flatnonzero(like | np.concatenate((like[1:], [True])))  # the last one's successor is not known yet
                run = np.cumsum(~like)[members]
                order = np.lexsort((place[members], owner[members], run))
                members, run = members[order], run[order]
                heads = np.concatenate(([True], run[1:] != run[:-1]))
                leader = members[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
                yield layer, pick(members[(owner[members] != owner[leader]) | (place[members] != place[leader])])
                if carried:
                    mine = (int(owner[leader[0]]), int(place[leader[0]]))
                    if mine != open_run:
                        lost = max(open_run, mine)
                        yield layer, {"owner": np.array([lost[0]]), "place": np.array([lost[1]])}
                found = (int(owner[leader[-1]]), int(place[leader[-1]]))
                open_run = min(found, open_run) if carried and run[-1] == run[0] else found
            reach = of("reach", slice(None))
            near = np.maximum(lcp, np.concatenate((lcp[1:], [0 if rows else length])))
            chosen = np.flatnonzero((reach > layer) & (near + reach - layer >= length))
            left, at = (rows["left"], chunk["row"][chosen]) if rows else (chunk["left"], chosen)
            byte = left[at, layer] if len(chosen) else chosen
            queue.push(chosen, (chunk["group"][chosen] << 8) | byte, chunk)
        if not queue.size:
            return
        sample, layer = queue.pop(), layer + 1


def _spans(flags: np.ndarray, owner: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner, from, to) of flagged windows, flag k of a row being the one k bytes before its place."""
    step = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, nearest = np.nonzero(step == 1)
    _, farthest = np.nonzero(step == -1)
    return owner[row], place[row] - farthest + 1, place[row] - nearest + length


def _by_size(batches, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about ``limit`` unpacked bytes."""
    for batch in batches:
        if batch.num_rows:
            size = batch.column("n_bytes").to_numpy()
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield batch.slice(a, b - a)


def _unpacked(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """(texts end to end, size of each)."""
    from zstandard import ZstdDecompressor

    spread = ZstdDecompressor().decompress
    return b"".join(spread(x.as_buffer()) for x in batch.column("packed")), batch.column("n_bytes").to_numpy()


def _hot_anchors(docs: DataFrame, length: int, share: int, least: int) -> np.ndarray:
    """Anchors with at least one of ``share`` windows groups in a sample: at most ``share`` of them."""

    def run(batches):
        for batch in _by_size(batches):
            raw = b"".join(x.as_buffer().to_pybytes() for x in batch.column("text"))
            found = anchors(np.frombuffer(raw, np.uint8), batch.column("n_bytes").to_numpy(), length)[1]
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["anchor"])

    some = docs.where(F.pmod(F.xxhash64("id", "sha"), F.lit(SAMPLE)) == 0).select("text", "n_bytes")
    counts = checkpoint(some.mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(least, total / share)).orderBy(F.desc("n")).limit(share).collect()
    return np.sort(np.array([r["anchor"] for r in hot], np.int64))


def _marks(texts: DataFrame, firsts: DataFrame, hot: np.ndarray, length: int, held: int, folder: str) -> DataFrame:
    """(owner, from, to): bytes of first texts that repeat earlier ones; spans may overlap."""
    key = ["given", "id", "sha"]
    reach = length - gram_size(length)

    def list_anchors(batches):
        for batch in _by_size(batches):
            raw, sizes = _unpacked(batch)
            text, anchor, *_ = anchors(np.frombuffer(raw, np.uint8), sizes, length)
            owner = batch.column("owner").to_numpy()[text]
            salt = np.where(np.isin(anchor, hot), owner % 61, -1)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(salt), pa.array(owner)], ["anchor", "salt", "owner"])

    names = ["hot", "anchor", "owner", "place", "left", "right"]

    def surroundings(batches):
        for batch in _by_size(batches):
            raw, sizes = _unpacked(batch)
            base = np.cumsum(sizes) - sizes
            text, anchor, place, first, number = anchors(np.frombuffer(raw, np.uint8), sizes, length)
            wanted = batch.column("wanted")
            ends = np.searchsorted(text, np.arange(len(sizes) + 1))
            some = np.zeros(len(text), bool)
            for i in range(len(sizes)):
                some[ends[i] : ends[i + 1]] = np.isin(anchor[ends[i] : ends[i + 1]], wanted[i].values.to_numpy())
            some = np.flatnonzero(some)
            owner, inside = batch.column("owner").to_numpy()[text[some]], place[some] - base[text[some]]
            is_hot = np.isin(anchor[some], hot)
            cold, end = some[~is_hot], first[some] + number[some] - 1 + length
            data = np.frombuffer(raw, np.uint8)
            n_left, n_right = place[cold] - first[cold], end[~is_hot] - place[cold]
            backwards = np.repeat(place[cold] - 1, n_left) - _ranges(np.zeros(len(cold), np.int64), n_left)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(cold), np.int8)), pa.array(anchor[cold]), pa.array(owner[~is_hot]), pa.array(inside[~is_hot]),
                    _binary(data[backwards], n_left), _binary(data[_ranges(place[cold], n_right)], n_right),
                ],
                names,
            )
            rows, earliest = [], {}
            some, end, owner, inside = some[is_hot], end[is_hot], owner[is_hot], inside[is_hot]
            for a, o, w, p, s, e in zip(
                anchor[some].tolist(), owner.tolist(), inside.tolist(), place[some].tolist(), first[some].tolist(), end.tolist()
            ):
                row = (1, a, o, w, raw[s:p][::-1], raw[p:e])
                other = earliest.setdefault(row[4:], row)
                if other[2:4] != row[2:4]:  # all but the earliest repeat it as a whole
                    late = max(other, row, key=lambda r: r[2:4])
                    earliest[row[4:]] = min(other, row, key=lambda r: r[2:4])
                    start = late[3] - len(late[4])
                    rows.append((2, late[3] + len(late[5]), late[2], start, b"", b""))
            yield _batch(rows + list(earliest.values()), [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], names)

    def sorted_groups(batches):
        parts, size = [], 0

        def tuples(table: pa.Table, before: tuple | None) -> dict[str, np.ndarray]:
            column = lambda name: table.column(name).combine_chunks()
            right, n_right = _matrix(column("right"), length)
            left, n_left = _matrix(column("left"), reach)
            anchor = column("anchor").to_numpy()
            unlike = right[1:] != right[:-1]
            lcp = np.where(unlike.any(1), unlike.argmax(1), length)
            lcp = np.minimum(np.minimum(lcp, n_right[1:]), n_right[:-1])
            lcp = np.where(anchor[1:] == anchor[:-1], lcp, 0)
            head = 0
            if before is not None:  # the chunk goes on with the group of the one before
                differ = np.flatnonzero(before[0] != right[0])
                head = min(before[1], int(n_right[0]), int(differ[0]) if len(differ) else length)
            return {
                "group": np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1]))), "reach": n_left.astype(np.int16),
                "lcp": np.concatenate(([head], lcp)).astype(np.int16), "left": left, "owner": column("owner").to_numpy(),
                "place": column("place").to_numpy(), "end": (right[-1], int(n_right[-1])),
            }

        def held_together(table: pa.Table):
            rows = tuples(table, None)
            owner, place = rows["owner"], rows["place"]
            order = np.lexsort((place, owner))
            fresh = np.concatenate(([0], (np.diff(owner[order]) != 0) | (np.diff(place[order]) != 0)))
            rows["rank"] = np.empty(len(order), np.int64)
            rows["rank"][order] = np.cumsum(fresh)
            flags = np.zeros((len(order), reach + 1), bool)
            sample = {"group": rows["group"], "lcp": rows["lcp"], "row": np.arange(len(order))}
            for layer, late in induce(iter([sample]), length, len(order), folder, rows):
                flags[late["row"], layer] = True
            return _marked(*_spans(flags, owner, place, length))

        source = (b for b in batches if b.num_rows)
        queue = []

        def one_group(first: pa.Table, key: int):
            """Chunks of a group that outgrows a batch, read as they come."""
            before, table = None, first
            while table is not None:
                chunk = tuples(table, before)
                before = chunk.pop("end")
                yield chunk
                table = None
                for more in source:
                    anchor = more.column("anchor").to_numpy()
                    cut = int(np.searchsorted(anchor != key, True))
                    if cut < len(anchor):
                        queue.append(more.slice(cut))
                    if cut:
                        table = pa.Table.from_batches([more.slice(0, cut)])
                    break
                if queue:
                    if table is not None:
                        yield {k: v for k, v in tuples(table, before).items() if k != "end"}
                    return

        while True:
            batch = queue.pop() if queue else next(source, None)
            if batch is None:
                break
            parts.append(batch)
            size += batch.num_rows
            if size < held:
                continue
            table = pa.Table.from_batches(parts)
            anchor = table.column("anchor").combine_chunks().to_numpy()
            others = np.flatnonzero(anchor != anchor[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:  # whole groups; the last one may go on
                yield held_together(table.slice(0, cut))
                parts, size = table.slice(cut).combine_chunks().to_batches(), len(anchor) - cut
            else:
                parts, size = [], 0
                for layer, late in induce(one_group(table, int(anchor[0])), length, held, folder):
                    yield _marked(late["owner"], late["place"] - layer, late["place"] - layer + length)
        if size:
            yield held_together(pa.Table.from_batches(parts))

    def _marked(owner, start, end) -> pa.RecordBatch:
        zero = np.zeros(len(owner), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (zero, owner, zero, owner, start, end)], ["kind", "h1", "h2", "owner", "start", "end"]
        )

    def windows(batch: pa.RecordBatch, last: list) -> Iterator[pa.RecordBatch]:
        """Of hot anchors: repeated surroundings as spans, else the digest of each window."""
        marks, found = [], {}
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            _, _, owner, place, left, right = row
            start = place - len(left)
            if last and last[0] == (left, right):  # in order of owner and place: the first came before
                if last[1] != (owner, place):
                    marks.append((owner, start, place + len(right)))
                continue
            last[:] = [(left, right), (owner, place)]
            whole = left[::-1] + right
            for k in range(len(whole) - length + 1):
                digest = hashlib.blake2b(whole[k : k + length], digest_size=16).digest()
                other = found.setdefault(digest, (owner, start + k))
                if other != (owner, start + k):
                    late = max(other, (owner, start + k))
                    found[digest] = min(other, (owner, start + k))
                    marks.append((*late, late[1] + length))
        if marks:
            yield _marked(*(np.array(c) for c in zip(*marks)))
        if found:
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            owner, start = np.array(list(found.values()), np.int64).T
            columns = (np.ones(len(owner), np.int64), halves[:, 0], halves[:, 1], owner, start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "h1", "h2", "owner", "start", "end"])

    def compare(batches):
        # rows of a task: cold ones by anchor, then hot ones, then spans that are known already
        rest, last = [], []

        def cold():
            for batch in batches:
                kind = batch.column("hot").to_numpy()
                if kind.any():
                    rest.append(batch)
                    yield batch.slice(0, int(np.argmax(kind != 0)))
                    return
                yield batch

        yield from sorted_groups(cold())
        for batch in (b for source in (rest, batches) for b in source):
            kind = batch.column("hot").to_numpy()
            ready = batch.filter(pa.array(kind == 2))
            yield _marked(*(ready.column(c).to_numpy() for c in ("owner", "place", "anchor")))
            yield from windows(batch.filter(pa.array(kind == 1)), last)

    mine = texts.join(firsts.select(*key, "owner"), key)
    listed = mine.select("owner", "n_bytes", "packed").mapInArrow(list_anchors, "anchor long, salt long, owner long")
    of = Window.partitionBy("anchor", "salt")
    twice = listed.withColumn("n", F.count(F.lit(1)).over(of)).where("n > 1 or salt >= 0")
    wanted = twice.groupBy("owner").agg(F.collect_set("anchor").alias("wanted"))  # of one text
    asked = wanted.join(firsts.select(*key, "owner"), "owner")
    around = texts.join(asked, key).select("owner", "n_bytes", "packed", "wanted").mapInArrow(
        surroundings, "hot byte, anchor long, owner long, place long, left binary, right binary"
    )
    deal = F.when(F.col("hot") == 0, F.col("anchor")).when(F.col("hot") == 1, F.xxhash64("left", "right")).otherwise(F.xxhash64("owner"))
    dealt = around.repartition(deal).sortWithinPartitions("hot", "anchor", "right", "left", "owner", "place")
    compared = dealt.mapInArrow(compare, "kind long, h1 long, h2 long, owner long, start long, end long")
    order = F.rank().over(Window.partitionBy("kind", "h1", "h2").orderBy("owner", "start"))
    return compared.withColumn("order", order).where("kind = 0 or order > 1").select("owner", "start", "end")


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def remove_repeats(
    df: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    held: int = HELD,
    hot_share: int = HOT_SHARE,
    hot_least: int = HOT_LEAST,
    keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a string of ``length`` bytes that covers it starts earlier
    too: in a row with a smaller id, or earlier in the same one. Strings never
    cross rows and are judged on the input; those that overlap themselves count.
    ``n_spans`` is the number of maximal removed runs, ``kept_sha256`` the digest
    of the bytes left. With ``keep_text`` the bytes left come as ``kept`` too.

    Null texts are empty. A null id comes before all others; rows of one id with
    unlike texts follow each other by the SHA-256 of the text; of rows that repeat
    id and text one comes first, whichever. An empty table gives no rows; other
    columns are ignored.
    """
    if not 2 <= length < 1 << 15:
        raise ValueError("length is 2 to 32767")
    spark = df.sparkSession
    key = ["given", "id", "sha"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        F.col("doc_id").isNotNull().cast("int").alias("given"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), "text",
    )
    rows = checkpoint(docs.groupBy(*key, "n_bytes").agg(F.count("*").alias("rows")))
    earliest = rows.groupBy("sha").agg(F.min(F.struct("given", "id")).alias("earliest"))
    rows = rows.join(earliest, "sha").withColumn("first", F.struct("given", "id") == F.col("earliest")).drop("earliest")
    # texts that occur first get a number in order: their owner's name from here on
    firsts = rows.where(F.col("first") & (F.col("n_bytes") >= length)).select(*key, "n_bytes")
    ranged = firsts.repartitionByRange(*key).sortWithinPartitions(*key)
    ranged = checkpoint(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33)))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one short row a partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    firsts = ranged.join(F.broadcast(offsets), "part").select(*key, (F.col("before") + F.col("at")).alias("owner"))

    long_enough = docs.where(F.col("n_bytes") >= length)
    hot = _hot_anchors(long_enough, length, hot_share, hot_least)

    def pack(batches):
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=3).compress
        for batch in _by_size(batches):
            packed = pa.array([squeeze(x.as_buffer()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "n_bytes")), packed], [*key, "n_bytes", "packed"])

    packed = long_enough.mapInArrow(pack, "given int, id long, sha binary, n_bytes long, packed binary")
    marks = _marks(packed, firsts, hot, length, held, f"{shared_folder(spark)}/queues")
    spans = marks.groupBy("owner").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    spans = spans.join(firsts, "owner")

    def cut(batches):
        for batch in _by_size(batches):
            raw, sizes = _unpacked(batch)
            out, begin = [], 0
            for size, own in zip(sizes.tolist(), batch.column("spans")):
                start, end = (own.values.field(i).to_numpy() for i in (0, 1))
                cover = np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1)
                gone = np.cumsum(cover)[:size] > 0
                kept = np.frombuffer(raw, np.uint8, size, begin)[~gone].tobytes()
                begin += size
                n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((size - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            tail = _batch(out, [pa.int64(), pa.int64(), pa.string(), pa.binary()], ["removed", "spans", "digest", "kept"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *tail.columns], [*key, *tail.schema.names])

    done = packed.join(spans.select(*key, "spans"), key).select(*key, "n_bytes", "packed", "spans")
    done = done.mapInArrow(cut, "given int, id long, sha binary, removed long, spans long, digest string, kept binary")
    if not keep_text:
        done = done.drop("kept")
    done = done.dropDuplicates(key)
    every = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    every = every.join(done.withColumn("copy", F.lit(1).cast("long")).withColumn("first", F.lit(True)), [*key, "first", "copy"], "left")
    whole = (F.col("n_bytes") >= length) & (~F.col("first") | (F.col("copy") > 1))
    out = every.select(
        F.when(F.col("given") == 1, F.col("id")).alias("doc_id"), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("digest", F.lower(F.hex("sha")))).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )
    return out
