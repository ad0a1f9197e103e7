"""Secret scans: fixed patterns, and password guess cost in credential contexts.

The fixed patterns find assigned values, access keys and long hex runs. Beside
them, every value in a wider credential context (more key names, several
languages, logins inside URLs) is judged by how many guesses it takes: a dynamic
programme finds the cheapest segmentation of the value into common words, dates,
repeats, keyboard walks and brute-force stretches. Values that cost at least
``10 ** least`` guesses become spans of kind ``guess``. Common words are a short
fixed list and, behind it, the most frequent words of the corpus itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm.common import bounded, raw_bytes, strings_of, texts

#: Patterns: (kind, expression, group that is measured, least length of it).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS = ("assign", "access", "hex", "guess")
#: Names that announce a credential, and a login inside a URL.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|authorization|bearer"""
    r"""|(?:api|access|private|client|secret|signing|encryption)[_-]?key|contraseña|clave|mot\ de\ passe|passwort|kennwort)"""
    r"""["']?\x20{0,3}[:=]\x20{0,3}(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']+))""",
    re.I,
)
URL_LOGIN = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")
#: Letters that a context contains, in lower case, so that most texts are passed over.
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key", "contrase", "clave", "kennwort", "://")
#: log10 of the guesses from which a value counts as a secret.
LEAST = 10.0
LEAST_LENGTH = 8

#: Common password words, most common first.
WORDS = """password admin root user login letmein welcome qwerty monkey dragon master secret
hello test guest default changeme temp sample example demo access pass word iloveyou sunshine
princess football baseball soccer hockey shadow superman batman michael jordan charlie thomas
daniel andrew joshua matthew robert jennifer jessica ashley nicole summer winter spring autumn
january february march april june july august september october november december monday
tuesday wednesday thursday friday saturday sunday love angel flower cookie cheese banana orange
apple coffee pepper ginger tiger lion eagle falcon phoenix buster killer hunter ranger trustno
money freedom internet computer server system service database backup manager office company
public private token apikey key value string none null true false required optional hidden
redacted removed placeholder your here my the and for new old""".split()
#: Rows of a keyboard from the top; each next row stands half a key to the right.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Signs that stand for letters.
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}

#: Words that the corpus itself adds to the list, by their counts, and their lengths.
CORPUS_WORDS = 10_000
LENGTHS = (3, 20)

_BRUTE = 1.0  # log10 of the guesses for a sign
_JOIN = math.log10(2)  # for each further segment
_LENGTH = 1.0  # for the length of a walk or the number of repeats
_KEYS = math.log10(len("".join(KEYBOARD)))  # for the start of a walk
_TURN = math.log10(4)  # for a walk's turn back to the key before
_ORDER = math.log10(36 * 2)  # for the start and direction of a run of letters or digits
_PERIODS = 8  # the longest unit of a repeat
_DATE = re.compile(r"(?:19|20)\d\d([-/._ ]?)(?:0?[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._ ]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE_COST, _YEAR_COST = math.log10(365 * 120 * 4), math.log10(120)


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (2 * x + y, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
    return {
        (a, b)
        for a, (xa, ya) in at.items()
        for b, (xb, yb) in at.items()
        if a != b and ((ya == yb and abs(xa - xb) == 2) or (abs(ya - yb) == 1 and abs(xa - xb) == 1))
    }


_NEXT = _neighbours()


class Words:
    """Common words, most common first."""

    def __init__(self, ranked: list[str]):
        self.rank = {w: i for i, w in reversed(list(enumerate(ranked, 1)))}
        self.longest = max(map(len, ranked), default=0)

    def cost(self, part: str) -> float | None:
        """log10 guesses of a stretch as a common word, also reversed, capitalised
        or with signs for letters."""
        lower = part.lower()
        plain = "".join(LEET.get(c, c) for c in lower)
        forms = ((lower, 0.0), (lower[::-1], math.log10(2)), (plain, math.log10(4)), (plain[::-1], math.log10(8)))
        found = [math.log10(self.rank[form]) + extra for form, extra in forms if form in self.rank]
        if not found:
            return None
        capitals = sum(c.isupper() for c in part)
        shape = 0.0 if not capitals else math.log10(2) if part.istitle() or part.isupper() else math.log10(2) * min(capitals, len(part) - capitals)
        return min(found) + shape


FIXED = Words(WORDS)


def _in_order(a: str, b: str, step: int) -> bool:
    return a.isalnum() and b.isalnum() and ord(b) - ord(a) == step


def segments(value: str, words: Words = FIXED) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 guesses, cheapest segmentation as (kind, start, end)).

    Every further segment doubles the guesses. Offered are all common words, all
    dates and years, every stretch of three or more neighbouring keys or of
    letters or digits in order, every repeat (three or more of one sign, two or
    more of a unit of up to eight), and any brute-force stretch. Stretches that
    may have any length are open states of the programme, so that the work grows
    with the length of the value.
    """
    n = len(value)
    if not n:
        return 0.0, []
    inf = math.inf
    lower = value.lower()
    best, last = [0.0] + [inf] * n, [(0, "")] * (n + 1)
    # cheapest that ends in an open stretch of each kind, and where that starts
    brute = keys = up = down = (inf, 0)
    repeats = [(inf, 0)] * (_PERIODS + 1)
    alike = [0] * (_PERIODS + 1)  # signs up to here that equal the one a period before

    def opened(i: int, cost: float) -> tuple[float, int]:
        return best[i] + (_JOIN if i else 0.0) + cost, i

    for j in range(1, n + 1):
        brute = min((brute[0] + _BRUTE, brute[1]), opened(j - 1, _BRUTE))
        offers = [(*brute, "brute")]
        if j >= 3:
            a, b, c = lower[j - 3 : j]
            if (b, c) in _NEXT:
                turn = _TURN if a == c else 0.0
                keys = (keys[0] + turn, keys[1])
                if (a, b) in _NEXT:
                    keys = min(keys, opened(j - 3, _KEYS + _LENGTH + turn))
            else:
                keys = (inf, 0)
            runs = []
            for run, step in ((up, 1), (down, -1)):
                if not _in_order(b, c, step):
                    run = (inf, 0)
                elif _in_order(a, b, step):
                    run = min(run, opened(j - 3, _ORDER + _LENGTH))
                runs.append(run)
            up, down = runs
            offers += [(*keys, "walk"), (*up, "walk"), (*down, "walk")]
        for p in range(1, min(_PERIODS, j - 1) + 1):
            if value[j - 1] != value[j - 1 - p]:
                repeats[p], alike[p] = (inf, 0), 0
                continue
            alike[p] += 1
            least = max(2 * p, 3)
            if alike[p] >= least - p:
                repeats[p] = min(repeats[p], opened(j - least, _BRUTE * p + _LENGTH))
                offers.append((*repeats[p], "repeat"))
        for size in range(2, min(words.longest, j) + 1):
            if (cost := words.cost(value[j - size : j])) is not None:
                offers.append((*opened(j - size, cost), "word"))
        if value[j - 1].isdecimal():
            for size in range(4, min(10, j) + 1):
                if size == 4 and _YEAR.fullmatch(value, j - 4, j):
                    offers.append((*opened(j - 4, _YEAR_COST), "date"))
                if size >= 6 and _DATE.fullmatch(value, j - size, j):
                    offers.append((*opened(j - size, _DATE_COST), "date"))
        best[j], start, kind = min(offers, key=lambda o: o[0])
        last[j] = (start, kind)
    out, j = [], n
    while j:
        i, kind = last[j]
        out.append((kind, i, j))
        j = i
    return best[n], out[::-1]


def guess_cost(value: str, words: Words = FIXED) -> float:
    return segments(value, words)[0]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, sorted by start, then kind."""
    found = [
        (m.start(), k, m.end())
        for k, (_, expression, group, least) in enumerate(BASE)
        for m in expression.finditer(text)
        if len(m[group]) >= least
    ]
    return [(BASE[k][0], start, end) for start, k, end in sorted(found)]


def guess_spans(text: str, least: float = LEAST, words: Words = FIXED) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of hard-to-guess values in credential contexts."""
    lower = text.lower()
    if not any(h in lower for h in HINTS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        group = m.lastindex
        found.append((m.start(group), m.end(group)))
    found += [m.span(1) for m in URL_LOGIN.finditer(text)]
    out = []
    for start, end in sorted(set(found)):
        value = text[start:end]
        if len(value) >= LEAST_LENGTH and (cost := guess_cost(value, words)) >= least:
            out.append((start, end, cost))
    return out


def find(text: str, least: float = LEAST, words: Words = FIXED) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], float]:
    """(fixed spans, all spans, largest log10 guesses of a value in context).

    A guessed value inside a fixed span makes no span of its own.
    """
    base = base_spans(text)
    guessed = guess_spans(text, least, words)
    starts = [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # the furthest end of the spans up to here
    covered = lambda s, e: (k := bisect_right(starts, s)) > 0 and reach[k - 1] >= e
    own = [("guess", s, e) for s, e, _ in guessed if not covered(s, e)]
    every = sorted(base + own, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return base, every, max((c for _, _, c in guessed), default=0.0)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each stretch covered by spans replaced by ``mark``."""
    out, at = [], 0
    for start, end in _merged(spans):
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def corpus_words(df: DataFrame, text_col: str = "text", limit: int = CORPUS_WORDS) -> list[str]:
    """The ``limit`` most frequent words of all texts, most frequent first, ties
    by the alphabet: runs of LENGTHS letters a to z, in lower case.

    Counts cover every text. Null and empty texts have no words, repeated rows
    count each, an empty table gives none.
    """

    def run(batches):
        low = np.zeros(256, np.uint8)
        for c in range(97, 123):
            low[c] = low[c - 32] = c
        for batch in bounded(batches, "text"):
            raw, sizes = raw_bytes(batch.column("text"))
            letters = low[raw]
            inside = letters > 0
            edge = np.zeros(len(raw) + 1, bool)
            edge[np.cumsum(sizes)] = True
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            starts = np.flatnonzero(begins)
            if not len(starts):
                continue
            kept = np.cumsum(inside)
            lengths = np.diff(np.concatenate((kept[starts] - 1, kept[-1:])))
            words = strings_of(letters[inside], lengths).filter(pa.array((lengths >= LENGTHS[0]) & (lengths <= LENGTHS[1])))
            coded = words.dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    counts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "word string, n long")
    total = counts.groupBy("word").agg(F.sum("n").alias("n"))
    # the best of each of a few parts, so that what reaches the driver does not grow with the tasks
    part = Window.partitionBy(F.pmod(F.hash("word"), F.lit(8))).orderBy(F.desc("n"), "word")
    best = total.withColumn("place", F.row_number().over(part)).where(F.col("place") <= limit)
    return [r["word"] for r in best.orderBy(F.desc("n"), "word").limit(limit).select("word").collect()]


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, common: list[str] | None = None
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, hardest_log10.

    ``common`` are words that rank behind the fixed ones (``corpus_words``). Spans are kind:start:end in code points, end exclusive, by start, then kind
    in the order assign, access, hex, guess. A null text is empty: counts 0, no
    spans, the checksum of the empty string. Repeated rows and null ids come
    back as they are; an empty table gives no rows; other columns are ignored.
    """

    ranked = WORDS + (common or [])

    def run(batches):
        words = Words(ranked)
        for batch in bounded(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, every, hardest = find(text, least, words)
                kinds = [k for k, _, _ in base]
                rows.append((
                    *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_join(base).encode()).hexdigest(),
                    _join(every), len(every) - len(base), hardest,
                ))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds_of)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "hardest_log10"]
    kinds_of = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.float64()]
    return texts(df, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, hardest_log10 double",
    )


def redact(
    df: DataFrame, text_col: str = "text", size_col: str | None = None, mark: str = "<secret>", least: float = LEAST,
    common: list[str] | None = None,
) -> DataFrame:
    """``df`` with every found stretch of the text replaced by ``mark``.

    ``common`` as in ``scan``. All columns stay, whatever their names; a null
    text stays null, an empty one empty. Null ids and repeated rows stay as they
    are; an empty table gives an empty one. ``size_col`` names a column that
    takes the new number of code points.
    """
    at, ranked = df.columns.index(text_col), WORDS + (common or [])

    def run(batches):
        words = Words(ranked)
        for batch in bounded(batches, text_col):
            done = [None if t is None else redacted(t, find(t, least, words)[1], mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    out = df.mapInArrow(run, df.schema)
    if size_col is None:
        return out
    return out.withColumn(size_col, F.length(text_col).cast(df.schema[size_col].dataType))
