import random
import re
from collections import Counter

import pytest

from furrow.llm import licenses
from furrow.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS, SF


def base_by_hand(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [
        (i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(rows, docs):
    texts = dict(docs)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_hand(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_query(spark, given):
    rows = QUERIES["op8_license_scans"](spark, SF).collect()
    assert len(rows) == len(given)
    check(rows, given)


@pytest.mark.parametrize("seed", range(30))
def test_base_against_a_plain_walk(seed):
    rng = random.Random(seed)
    parts = ["GNU", "general", "Public", "license", "apache", "cc", "by", "CC-BY", "mit", "MIT License", "é", "x", "0", "\n", "_", "gnu general public license"]
    text = " ".join(rng.choice(parts) for _ in range(80))
    r = licenses.Scanner().scan(text.encode())
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_hand(text)


def changed(rng, notice, edits):
    raw = list(notice)
    for _ in range(edits):
        at = rng.randrange(len(raw))
        kind = rng.randrange(3)
        if kind == 0:
            raw[at] = "q"
        elif kind == 1:
            raw.insert(at, "q")
        elif len(raw) > 1:
            del raw[at]
    return "".join(raw)


def test_every_notice_within_its_edits_is_found():
    rng = random.Random(2)
    scanner = licenses.Scanner()
    for label, notice, edits in licenses.NOTICES:
        for _ in range(15):
            text = f"Lorem ipsum, dolor! {changed(rng, notice, edits)} (sit amet) 42."
            assert label in scanner.scan(text.encode())["labels"].split(","), text


def test_spans_and_edits():
    r = licenses.Scanner().scan(b"One two. Releesed under the MlT license, three")
    assert r["base_labels"] == "" and r["labels"] == "mit" and r["spans"] == "mit:2:7:2"
    assert r["score"] == pytest.approx(1 - 2 / len("released under the mit license"))
    assert licenses.Scanner().scan(b"clean text about nothing of the kind")["labels"] == ""


@pytest.mark.parametrize("text,label", [
    ("Apache Licence, version 2", "apache"), ("under MIT licens.", "mit"), ("GNU Genral Public License v3", "gpl"),
    ("GNU general publik licence", "gpl"), ("Creative Comons BY 4.0", "cc-by"), ("the apache  lisence;", "apache"),
])
def test_base_phrases_with_a_misspelling(text, label):
    r = licenses.Scanner().scan(text.encode())
    assert r["base_labels"] == "" and r["labels"] == label and 0.8 < r["score"] < 1


@pytest.mark.parametrize("text", ["limit license", "submit licence fees", "apache server", "mit student", "gnu tools", "creative work by us", "kit license"])
def test_other_phrases_make_no_label(text):
    assert licenses.Scanner().scan(text.encode())["labels"] == ""


def test_many_short_phrases_take_linear_time():
    found = licenses.Scanner().scan(b"mit licence and apache licens " * 20_000)
    assert found["spans"].count(",") + 1 == 40_000


def test_a_near_notice_beside_a_better_one_is_found():
    scanner = licenses.Scanner()
    r = scanner.scan(b"released under the mut license released under the mit license releasd under the mit licence")
    assert r["spans"] == "mit:0:5:1,mit:5:10:0,mit:10:15:2"


def test_repeated_near_notices_are_all_found():
    rng = random.Random(4)
    for label, notice, edits in licenses.NOTICES:
        other = [(x, n, k) for x, n, k in licenses.NOTICES if n == notice]
        scanner = licenses.Scanner(notices=tuple(other))
        parts = [changed(rng, notice, rng.randrange(edits // 2 + 1)) for _ in range(40)]
        found = scanner.scan(" ".join(parts).encode())["spans"].split(",")
        assert len(found) == len(parts), (notice, len(found))


def test_odd_rows(odd, none):
    rows = licenses.scan(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD_TEXTS)
    check([r for r in rows if r["doc_id"] is not None], [d for d in ODD_TEXTS if d[0] is not None])
    assert licenses.scan(none).count() == 0
