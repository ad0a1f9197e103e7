import hashlib
from collections import Counter

import pytest

from furrow.llm import fingerprints
from furrow.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS, SF


def expected(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    prints = [fingerprints.fingerprint(t) for _, t in docs]
    out = []
    for n, (i, t) in enumerate(docs):
        nxt = docs[(n + 1) % len(docs)][1]
        changed = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        e = fingerprints.fingerprint(changed)
        bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
        out.append((
            i, len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[n].hex(), e.hex(),
            1 - bits(prints[n], e) / 128, 1 - bits(prints[n], prints[(n + 1) % len(docs)]) / 128,
        ))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_query(spark, given):
    assert rows_of(QUERIES["op6_fingerprints"](spark, SF)) == expected(given)


def test_edits_stay_near(spark):
    rows = QUERIES["op6_fingerprints"](spark, SF).where("n_chars > 300").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_few_rows_and_ranges(make_docs, n):
    docs = [(i, f"text number {i} of a few") for i in range(n)]
    assert rows_of(fingerprints.compare_with_edit(make_docs(docs).repartition(4))) == expected(docs)


def test_rows_of_one_id_are_divided(spark, make_docs):
    docs = [(None, f"{i % 70} text with a common end é") for i in range(150)] + [(5, "one"), (5, "two")]
    assert rows_of(fingerprints.compare_with_edit(make_docs(docs).repartition(4))) == expected(docs)


def test_odd_rows(odd, none):
    assert rows_of(fingerprints.compare_with_edit(odd)) == expected(ODD_TEXTS)
    assert fingerprints.compare_with_edit(none).count() == 0
    assert Counter(r["doc_id"] for r in fingerprints.prints(odd).collect()) == Counter(i for i, _ in ODD_TEXTS)


def test_votes_by_hand():
    # one word: the fingerprint is its term's own bits; repeats change nothing
    assert fingerprints.fingerprint("word") == fingerprints.fingerprint(" WORD ")
    # the commoner of two terms outvotes the other, with three the sum decides
    assert fingerprints.fingerprint("a b a b a b") == fingerprints.fingerprint("a b")
    one, two, three = (int.from_bytes(fingerprints.fingerprint(t)) for t in ("a b", "b c", "c d"))
    assert int.from_bytes(fingerprints.fingerprint("a b c d")) == (one & two) | (one & three) | (two & three)
    assert fingerprints.fingerprint("") == fingerprints.fingerprint(" \n") == bytes(16)


def test_within_finds_every_pair(spark):
    import random

    rng = random.Random(8)
    prints = [rng.getrandbits(128) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 6))) for p in prints for _ in range(3)]
    stored = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    found = {(r["query"], r["found"], r["bits"]) for r in fingerprints.within(stored, stored, 4).collect()}
    distinct = set(prints)
    assert found == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in distinct for b in distinct if (a ^ b).bit_count() <= 4}


def test_texts_without_blanks_and_short_texts():
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    near = lambda a, b: fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    for make in (lambda: word(600), lambda: " ".join(word(6) for _ in range(8)), lambda: "漢字仮名交文章" + word(3) + word(200)):
        pairs = [(make(), make()) for _ in range(40)]
        won = sum(near(a, fingerprints.edited(a, b)) > near(a, b) for a, b in pairs)
        assert won >= 36
    assert fingerprints.fingerprint("ab") == fingerprints.fingerprint(" AB ") != fingerprints.fingerprint("ac")
    # the weight of byte runs fades out: no jump from one word more
    words = [word(7) for _ in range(129)]
    assert near(" ".join(words[:127]), " ".join(words[:128])) > 0.9
