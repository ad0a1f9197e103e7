import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from furrow.llm import collocations
from furrow.llm.collocations import parse
from tests.llm.conftest import ODD_TEXTS

SCHEMA = "doc_id long, text string, lang string, n string, phrase string, rank string"


def by_hand(rows, longest=3, least=10, top=2000, share=50):
    """Plain loops; a row is (text, lang)."""
    f = {}
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            own = f.setdefault(lang or "und" if lang is None else lang, Counter())
            for size in range(1, longest + 1):
                own.update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if " " not in p)
        candidates = {p: c for p, c in own.items() if " " in p and c >= least}
        scored = []
        for p, a in candidates.items():
            w = p.split(" ")
            inside = lambda q: any(q[i : i + len(w)] == w for i in range(len(q) - len(w) + 1))
            if any(100 * c >= share * a and q.count(" ") > p.count(" ") and inside(q.split(" ")) for q, c in candidates.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                l, r = own[" ".join(w[:k])], own[" ".join(w[k:])]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            scored.append((-score, -a, p.encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(1, t, g, None, None, None) for t, g in rows], SCHEMA).repartition(parts)
    got = collocations.mine(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("longest,modulus", [(3, 1), (3, 8), (3, 1 << 62), (2, 3), (4, 2)])
def test_against_plain_loops(spark, longest, modulus, monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 2000)  # several runs
    rng = random.Random(longest * 10 + modulus % 7)
    words = ["the", "The", "of", "new", "york", "city", "é", "Ünder", "x y", "日本", "a'b", "$", "\x00"]
    passage = "in new york city the mayor of new york said no, twice"
    rows = []
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(rng.randrange(60)))
        rows.append((text + passage * rng.randrange(2), rng.choice(["en", "fr", None, "und", ""])))
    got = found(spark, rows, longest=longest, modulus=modulus)
    assert got == by_hand(rows, longest) and len(got) > 5


def test_top_ties_and_repeats(spark):
    rows = [("a b. c d. e f", "en")] * 10 + [("long " * 5000, "en")]
    assert found(spark, rows, top=2) == by_hand(rows, top=2)
    assert [r[2] for r in found(spark, rows)][:3] == ["a b", "c d", "e f"]


def test_odd_rows(spark, odd, none):
    rows = [(t, None) for _, t in ODD_TEXTS]
    assert sorted(tuple(r) for r in collocations.mine(odd).collect()) == by_hand(rows)
    assert collocations.mine(none).count() == 0
    assert found(spark, [(None, "en"), ("", "en"), (" .,", None)]) == []


def test_chunks_of_equal_passages_are_equal_and_cover_every_place():
    passage = " ".join(f"w{i}" for i in range(200))
    chunks, last, row, _ = parse(pa.array([f"x y z {passage} q r", f"other {passage}", "", None and "" or "one"]))
    first, second = ([c for c, r in zip(chunks.to_pylist(), row) if r == i] for i in (0, 1))
    assert second[1:-1] and set(second[1:-1]) <= set(first)
    glued = first[0].split()
    for c in first[1:]:
        words = c.split()
        assert glued[-2:] == words[:2]  # the overlap of two words
        glued += words[2:]
    assert " ".join(glued) == f"x y z {passage} q r"
    assert last.tolist() == [i + 1 == len(row) or row[i] != row[i + 1] for i in range(len(row))]


def test_slices_of_an_array_are_cut_like_the_whole():
    texts = pa.array([f"Äbc {i} DÉF, GHI jkl" for i in range(50)])
    whole, _, row, hashes = parse(texts)
    part, _, own, again = parse(texts.slice(20, 10))
    assert part.to_pylist() == [c for c, r in zip(whole.to_pylist(), row) if 20 <= r < 30]
    by_chunk = dict(zip(whole.to_pylist(), hashes.tolist()))
    assert again.tolist() == [by_chunk[c] for c in part.to_pylist()] and len(set(by_chunk.values())) == len(by_chunk)
