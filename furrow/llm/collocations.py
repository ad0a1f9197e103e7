"""Phrase collocations by prefix-free parsing.

A piece of text is cut into chunks where its own words say so: wherever a window
of ``longest`` - 1 words has a hash divisible by ``modulus``, one chunk ends with
that window and the next one starts with it. Equal passages are so cut alike, and
the distinct chunks with their frequencies form a dictionary. Phrases are counted
inside the distinct chunks, weighted by frequency. A phrase that starts inside
the overlap belongs to the later chunk, so every occurrence counts once.

Chunks and phrases are counted in each task, dealt by a hash of the whole string
in compressed runs, and added up again, so that a string's occurrences never meet
in one place, only its partial counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm.common import bounded, checkpoint

LONGEST = 3
LEAST = 10
TOP = 2000
#: One window of words in so many ends a chunk.
MODULUS = 8
#: Text bytes whose phrases one run of partial counts stands for, and of a slice.
PART_BYTES, SLICE = 4 << 20, 4 << 20
NO_LANG = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z lowered, all ends of a piece as one, tabs as blanks.
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "
)
_RUNS = "part long, lang string, last boolean, strings binary, counts binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    places = np.concatenate(([0], np.cumsum(lengths)))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, length of each string) of an array or a slice of one."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    data = strings.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)


def _joined(values: pa.Array, lengths: np.ndarray, by: str) -> pa.Array:
    """Runs of strings, so many to each, joined by ``by``."""
    ends = np.cumsum(lengths)
    between = np.ones(len(values), np.int64)
    between[ends - 1] = 0
    data, own = _bytes(values)
    size = own + between
    out = np.full(size.sum(), ord(by), np.uint8)
    joint = np.zeros(len(out) + 1, bool)
    joint[(np.cumsum(size) - 1)[between == 1]] = True
    out[~joint[:-1]] = data
    return _strings(out, np.add.reduceat(size, ends - lengths) if len(lengths) else lengths)


def parse(texts: pa.Array, overlap: int = LONGEST - 1, modulus: int = MODULUS) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, last, row, hash): the chunks of all texts, words joined by one
    blank; whether a chunk ends its piece; which text it comes from; a hash."""
    raw, sizes = _bytes(texts)
    plain = np.frombuffer(raw.tobytes().translate(_PLAIN), np.uint8)
    inside = (plain != 10) & (plain != 32)
    edge = np.zeros(len(plain) + 1, bool)  # a text ends the word and the piece before it
    edge[np.cumsum(sizes)] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.searchsorted(np.cumsum(sizes), starts, "right")
    piece = (np.cumsum(plain == 10) + np.cumsum(edge[:-1]))[starts]
    kept = np.cumsum(inside)
    lengths = np.diff(np.concatenate((kept[starts] - 1, kept[-1:])))
    coded = _strings(plain[inside], lengths).dictionary_encode()
    code, n = coded.indices.to_numpy(), len(starts)
    first = np.concatenate(([True], piece[1:] != piece[:-1]))
    hashed = _mixed(_hashes(coded.dictionary))[code]
    window = hashed
    for k in range(1, overlap):
        window = _mixed(window[:-1] + hashed[k:])
    cut = np.zeros(n, bool)
    whole = piece[: len(window)] == piece[overlap - 1 :] if overlap else np.ones(n, bool)
    cut[: len(window)] = (window % np.uint64(modulus) == 0) & whole
    starts = np.flatnonzero(cut | first)
    last = np.concatenate((first[starts[1:]], [True]))
    ends = np.concatenate((starts[1:] + np.where(last[:-1], 0, overlap), [n]))
    at = _ranges(starts, ends - starts)
    place = (at - np.repeat(starts, ends - starts) + 1).astype(np.uint64)
    hashes = np.add.reduceat(_mixed(hashed[at] + place * _ODD), np.cumsum(ends - starts) - (ends - starts))
    return _joined(coded.dictionary.take(pa.array(code[at])), ends - starts, " "), last, row[starts], hashes


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, total weight of each, which of them each key is)."""
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(fresh) - 1
    totals = np.add.reduceat(weights[order], np.flatnonzero(fresh)) if len(keys) else weights[:0]
    return keys[fresh], totals, which


def count(chunks: pa.Array, last: np.ndarray, langs: pa.Array, weights: np.ndarray, longest: int = LONGEST):
    """(phrases, lang, hash, count, langs): the distinct phrases of one slice of
    the dictionary, with the empty phrase for all words of a lang."""
    lang = langs.dictionary_encode()
    split = pc.split_pattern(chunks.cast(pa.large_string()), " ")
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    coded = split.flatten().dictionary_encode()
    # words in order, so that runs of phrases are nearly so and compress well
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code, total = rank[coded.indices.to_numpy()], len(order)
    hashed = _hashes(words)
    left = np.repeat(offsets[1:], sizes) - np.arange(offsets[-1])  # words from here to the chunk's end
    own = np.flatnonzero((left > longest - 1) | np.repeat(last, sizes))
    left, weight = left[own], np.repeat(weights, sizes)[own]
    prefix = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes)[own]
    names, seeds = lang.dictionary.cast(pa.large_string()), _mixed(_hashes(lang.dictionary))
    of, hashes, text = np.arange(len(names)), seeds, pa.array([""] * len(names), pa.large_string())
    every = [(text, of, hashes, np.bincount(prefix, weight, len(names)).astype(np.int64))]
    for size in range(1, longest + 1):
        have = left >= size
        own, left, weight, prefix = own[have], left[have], weight[have], prefix[have]
        distinct, totals, prefix = _summed(prefix * total + code[own + size - 1], weight)
        before, word = np.divmod(distinct, max(total, 1))
        of, hashes = of[before], _mixed(hashes[before] * _ODD + hashed[word])
        spelt = words.take(pa.array(word))
        text = spelt if size == 1 else pc.binary_join_element_wise(text.take(pa.array(before)), spelt, pa.scalar(" ", pa.large_string()))
        every.append((text, of, hashes, totals))
    texts, of, hashes, counts = zip(*every)
    return pa.concat_arrays(texts), np.concatenate(of), np.concatenate(hashes), np.concatenate(counts), names


def _packed(strings: pa.Array, part: np.ndarray, lang: np.ndarray, names: pa.Array, last: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each part, lang and flag: its strings and their counts, compressed."""
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(level=1).compress
    group = (part * len(names) + lang) * 2 + last
    _, group = np.unique(group, return_inverse=True) if len(group) and group.max() >= 1 << 16 else (None, group)
    order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")
    group, counts = group[order], counts[order].astype("<i8")
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    ends = np.concatenate((starts[1:], [len(group)])).astype(np.int64) if len(starts) else starts
    joined = _joined(strings.take(pa.array(order)), ends - starts, "\n").cast(pa.large_binary())
    head = order[starts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[head], pa.int64()), names.take(pa.array(lang[head])).cast(pa.string()), pa.array(last[head].astype(bool)),
            pa.array([squeeze(x.as_buffer()) for x in joined], pa.binary()),
            pa.array([squeeze(counts[a:b].tobytes()) for a, b in zip(starts, ends)], pa.binary()),
        ],
        ["part", "lang", "last", "strings", "counts"],
    )


def _added(batches):
    """(lang, last, strings, counts) of each part, lang and flag, from rows in their order."""
    from zstandard import ZstdDecompressor

    spread = ZstdDecompressor().decompress
    key, held = None, []

    def total():
        strings, counts = zip(*held)
        coded = pa.concat_arrays(strings).dictionary_encode()
        # whole numbers below 2**53 add up exactly
        sums = np.bincount(coded.indices.to_numpy(), np.concatenate(counts), len(coded.dictionary))
        return *key[1:], coded.dictionary, sums.astype(np.int64)

    for batch in batches:
        for *now, strings, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "last", "strings", "counts"))):
            if now != key:
                if held:
                    yield total()
                key, held = now, []
            text = pa.array([spread(strings).decode()], pa.large_string())
            held.append((pc.split_pattern(text, "\n").flatten(), np.frombuffer(spread(counts), "<i8")))
    if held:
        yield total()


def frequencies(
    df: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    lang_col: str = "lang",
    text_col: str = "text",
    modulus: int = MODULUS,
) -> DataFrame:
    """(lang, phrase, n): phrases of up to ``longest`` words that occur at least
    ``least`` times in their lang, and under the empty phrase all its words."""
    docs = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-volume // PART_BYTES))
    dealt = lambda hashes: (hashes % np.uint64(parts)).astype(np.int64)

    def chunked(batches):
        for batch in bounded(batches, limit=SLICE):
            chunks, last, row, hashes = parse(batch.column("text"), longest - 1, modulus)
            lang, coded = batch.column("lang").dictionary_encode(), chunks.dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary).to_numpy()  # runs in order compress well
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = rank[coded.indices.to_numpy()]
            hashed = np.zeros(len(order), np.uint64)
            hashed[code] = hashes
            kinds = 2 * len(lang.dictionary)
            distinct, counts, _ = _summed(code * kinds + 2 * lang.indices.to_numpy()[row] + last, np.ones(len(code), np.int64))
            code, kind = np.divmod(distinct, kinds)
            strings = coded.dictionary.take(pa.array(order[code]))
            yield _packed(strings, dealt(hashed[code]), kind // 2, lang.dictionary, kind % 2, counts)

    def counted(batches):
        held, size = [], 0

        def phrases() -> pa.RecordBatch:
            lang, last, chunks, weights = (pa.concat_arrays(c) for c in zip(*held))
            found, of, hashes, totals, names = count(chunks, last.to_numpy(zero_copy_only=False), lang, weights.to_numpy(), longest)
            return _packed(found, dealt(hashes), of, names, np.zeros(len(of), np.int64), totals)

        for lang, last, chunks, weights in _added(batches):
            held.append((pa.repeat(lang, len(chunks)), pa.repeat(last, len(chunks)), chunks, pa.array(weights)))
            size += chunks.nbytes
            if size >= SLICE:
                yield phrases()
                held, size = [], 0
        if held:
            yield phrases()

    def frequent(batches):
        for lang, _, phrase, n in _added(batches):
            some = (n >= least) | pc.equal(phrase, "").to_numpy(zero_copy_only=False)
            phrase = phrase.filter(pa.array(some)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrase)), phrase, pa.array(n[some])], ["lang", "phrase", "n"])

    together = lambda runs: runs.repartition(parts, "part").sortWithinPartitions("part", "lang", "last")
    dictionary = together(docs.mapInArrow(chunked, _RUNS))
    return together(dictionary.mapInArrow(counted, _RUNS)).mapInArrow(frequent, "lang string, phrase string, n long")


def mine(
    df: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    share: int = 50,
    scale: int = 1_000_000,
    lang_col: str = "lang",
    text_col: str = "text",
    modulus: int = MODULUS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` phrases.

    Candidates have 2 to ``longest`` words and a >= ``least`` occurrences in
    their lang. The score of a cut into l and r occurrences is floor(scale * a *
    a / (l * r)); the lowest-scoring cut counts, then the shortest first part. A
    candidate inside a longer one with at least ``share`` percent of its
    occurrences is dropped. Order: score, then a, both descending, then phrase
    by UTF-8 bytes. n is the number of all words of the lang.

    A-Z are lowered; pieces end at . , ; : ! ? and line ends, words at blanks and
    tabs. A null text is empty, a null lang is ``und``. Repeated rows count each.
    Texts without words and empty tables give no rows; other columns are ignored.
    """
    grams = checkpoint(frequencies(df, longest, least, lang_col, text_col, modulus))
    words = F.split("phrase", " ")
    named = grams.where("phrase <> ''").withColumn("words", words).withColumn("size", F.size("words"))
    found = named.where("size > 1")
    spelt = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "lang", "phrase", F.col("n").alias("a"), "k", spelt(F.lit(1), F.col("k")).alias("left"),
        spelt(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    of = lambda name, part: grams.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    cuts = cuts.join(of("l", "left"), ["lang", "left"]).join(of("r", "right"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above, below = F.lit(scale).cast("decimal(8,0)") * (wide("a") * wide("a")), wide("l") * wide("r")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", F.call_function("div", above, below).alias("score"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.where("size > 2").select("lang", "n", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "n", "words", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at"))
    inner = inner.groupBy("lang", spelt(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("n").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {share} * a"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    return best.join(of("n", "none").where("none = ''").drop("none"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
