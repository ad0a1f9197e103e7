"""License scans: exact short phrases, and fuzzy search for short notices.

A notice that may hold k edits is cut into k + 1 pieces of words; in any match
with at most k edits one piece is whole (pigeonhole). Pieces are sought exactly,
a window around each hit is verified by the regex library's bounded-error
matching, and the verified span and its edits are reported.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.common import bounded, per_process, texts

#: Phrase words and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices as normalised words: (label, words, edits that are forgiven).
NOTICES = (
    ("gpl", "this work is licensed under the gnu general public license", 4),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", 6),
    ("lgpl", "gnu lesser general public license", 2),
    ("agpl", "gnu affero general public license", 2),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("bsd", "licensed under the bsd license", 2),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", 5),
    ("mpl", "mozilla public license", 2),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    ("cc-by", "licensed under cc by nc 4 0", 2),
    ("cc-by", "licensed under a creative commons attribution", 3),
    ("cc0", "creative commons zero public domain dedication", 3),
    ("public-domain", "released into the public domain", 2),
    ("proprietary", "all rights reserved", 1),
)

#: Short phrases: (label, words that stand as they are, words that may be misspelt, edits that are forgiven).
#: Two letters leave no room for an edit, so "cc by" is sought as it is and by its long name.
SHORT = (
    ("gpl", "gnu", "general public license", 2),
    ("apache", "apache", "license", 2),
    ("mit", "mit", "license", 2),
    ("cc-by", "creative", "commons by", 1),
)

#: Bytes of a text to word bytes: A-Z lowered, digits, a-z and all beyond ASCII kept, the rest a blank.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def seeds(notice: str, edits: int) -> list[tuple[bytes, int]]:
    """The notice cut into ``edits`` + 1 pieces of nearly equal size: (piece, offset)."""
    raw = notice.encode()
    cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
    return [(raw[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES, short=SHORT):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label, p.count(" ") + 1) for p, label in phrases]
        self.notices = [
            (label, len(n), k, regex.compile(rb"(?be)(?:" + regex.escape(n.encode()) + rb"){e<=%d}" % k))
            for label, n, k in notices
        ]
        # one automaton over all pieces; bytes are searched as Latin-1 text
        self.pieces = ahocorasick.Automaton()
        for i, (_, n, k) in enumerate(notices):
            for piece, offset in seeds(n, k):
                key = piece.decode("latin-1")
                held = self.pieces.get(key, [])
                self.pieces.add_word(key, [*held, (i, len(piece), offset)])
        self.short = len(self.notices)  # from here on: the first words are the one whole piece
        for label, first, rest, k in short:
            head, tail = regex.escape(f" {first} ".encode()), regex.escape(rest.encode())
            expression = regex.compile(rb"(?be)%b(?:%b){e<=%d}(?=\x20)" % (head, tail, k))
            key = f" {first} "
            held = self.pieces.get(key, [])
            self.pieces.add_word(key, [*held, (len(self.notices), len(key), 0)])
            self.notices.append((label, len(key) + len(rest), k, expression))
        self.pieces.make_automaton()

    def base(self, joined: bytes, starts: list[int]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        out = []
        for phrase, label, _ in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                out.append((bisect_right(starts, at + 1) - 1, label))
                at = joined.find(phrase, at + 1)
        return out

    def windows(self, joined: bytes) -> dict[int, list[tuple[int, int]]]:
        """Stretches of the text to verify, by notice: one for each place where
        a whole piece puts the notice, wide enough for its edits."""
        found: dict[int, set[tuple[int, int]]] = {}
        for end, hits in self.pieces.iter(joined.decode("latin-1")):
            for i, size, offset in hits:
                _, length, edits, _ = self.notices[i]
                start = end + 1 - size - offset
                low = start if i >= self.short else max(0, start - edits)
                found.setdefault(i, set()).add((low, min(len(joined), start + length + edits + (i >= self.short))))
        return {i: sorted(spans) for i, spans in found.items()}

    def matches(self, i: int, joined: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of notice ``i``, not overlapping, fewest edits first.

        A stretch whose best match overlaps one already taken is searched again
        beside it, so a near match next to a better one is found as well.
        """
        _, length, most, expression = self.notices[i]
        heap: list[tuple[int, int, int, int, int]] = []

        def seek(a: int, b: int) -> None:
            m = expression.search(joined, a, b) if b - a >= length - most else None
            if m and m.end() > m.start():
                heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in spans:
            seek(a, b)
        taken: list[tuple[int, int, int]] = []  # by start
        while heap:
            edits, start, end, a, b = heappop(heap)
            at = bisect_left(taken, (start, end, 0))
            over = [t for t in taken[max(0, at - 1) : at + 1] if t[0] < end and start < t[1]]
            if not over:
                taken.insert(at, (start, end, edits))
            else:
                low, high, _ = over[0]
                seek(a, low)
                seek(high, b)
        return taken

    def fuzzy(self, joined: bytes, starts: list[int]) -> list[tuple[int, int, str, int, int]]:
        """(first word, end word, label, edits, notice length) of verified notices.

        A short phrase counts where it is misspelt and no longer notice of its
        label has been found.
        """
        out = []
        for i, spans in sorted(self.windows(joined).items()):
            label, length, _, _ = self.notices[i]
            for start, end, edits in self.matches(i, joined, spans):
                first = bisect_right(starts, start + (joined[start] == 32)) - 1
                last = bisect_right(starts, end - 1) - 1
                if i >= self.short and (not edits or any(x == label and a <= last and first < b for a, b, x, _, _ in out)):
                    continue
                out.append((first, last + 1, label, edits, length))
        return sorted(set(out))

    def scan(self, raw: bytes) -> dict:
        words = words_of(raw)
        joined = b" " + b" ".join(words) + b" "
        starts = [1, *accumulate((len(w) + 1 for w in words), initial=1)][1:-1] if words else []
        base = self.base(joined, starts) if words else []
        fuzzy = self.fuzzy(joined, starts) if words else []
        places = [w for w, _ in base]
        labels = {x for _, x in base}
        best = max((1 - e / n for _, _, _, e, n in fuzzy), default=0.0)
        return {
            "n_words": len(words), "n_base": len(base),
            "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {x for _, _, x, _, _ in fuzzy})),
            "score": 1.0 if base else best,
            "spans": ",".join(f"{x}:{a}:{b}:{e}" for a, b, x, e, _ in fuzzy),
        }


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """License phrases and notices of every whole text.

    doc_id, n_words, n_base (places of exact phrases), first_word and last_word
    (their smallest and largest first word from 0, else null), base_labels,
    labels (with the fuzzy notices'), score (1 for an exact phrase, else the
    share of the best notice that is free of edits, else 0) and spans
    (label:first word:end word:edits of each notice). Null and empty texts have
    no words, empty labels and score 0. Repeated rows and null ids come back as
    they are; an empty table gives no rows; other columns are ignored.
    """

    schema = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string()),
    ])

    def run(batches):
        scanner = per_process(("licenses", phrases, notices), lambda: Scanner(phrases, notices))
        for batch in bounded(batches):
            found = pa.RecordBatch.from_pylist([scanner.scan(t.as_buffer().to_pybytes()) for t in batch.column("text")], schema)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], ["doc_id", *schema.names])

    return texts(df, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string",
    )
