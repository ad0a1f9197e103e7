import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from furrow.llm import repeats
from furrow.llm.repeats import Queue, anchors, induce
from tests.llm.conftest import ODD_TEXTS

SCHEMA = "doc_id long, text string, owner string, start string, n_bytes string, sha string"


def by_hand(rows, length):
    """Plain loops over every string of ``length`` bytes; rows of one id and text: one comes first."""
    raw = sorted(((i is not None, i or 0, hashlib.sha256((t or "").encode()).digest(), (t or "").encode(), i) for i, t in rows), key=lambda r: r[:3])
    seen, out = set(), []
    for _, _, _, text, doc in raw:
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            string = text[s : s + length]
            if string in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(spark, rows, length, parts=3, **options):
    df = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], SCHEMA).repartition(parts)
    got = repeats.remove_repeats(df, length, **options)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return Counter(tuple(r) for r in got.collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé漢 ") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(2, 12))) for _ in range(6)]
    texts = []
    for _ in range(40):
        kind = rng.random()
        if kind < 0.2 and texts:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 2)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        elif kind < 0.3:
            texts.append(rng.choice("ab") * rng.randint(0, 60))  # overlaps itself
        else:
            texts.append("".join(rng.choice([word(), rng.choice(passages)]) for _ in range(rng.randint(0, 8))))
    rows = [(rng.choice([None, 5, 5, *range(30)]), t) for t in texts]
    return rows + rows[:3]


@pytest.mark.parametrize("seed,length,held,hot", [(1, 12, 1 << 18, 1 << 20), (2, 7, 20, 1 << 20), (3, 12, 5, 1 << 20), (4, 12, 1 << 18, 1), (5, 2, 50, 4), (6, 20, 8, 6)])
def test_against_plain_loops(spark, seed, length, held, hot, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 300)  # several slices a task
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    rows = corpus(seed)
    truth = by_hand(rows, length)
    assert sum(r[2] for r in truth) > 100
    assert found(spark, rows, length, held=held, hot_least=hot, hot_share=1 << 20) == truth


def test_odd_rows(spark, odd, none):
    got = Counter(tuple(r) for r in repeats.remove_repeats(odd).collect())
    assert got == by_hand(ODD_TEXTS, 100)
    assert repeats.remove_repeats(none).count() == 0
    text = "x" * 150 + "tail"
    kept = {r["doc_id"]: bytes(r["kept"] or b"") for r in repeats.remove_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), keep_text=True).collect()}
    assert kept == {1: by_kept(text), 2: b""}


def by_kept(text):
    raw, gone, seen = text.encode(), set(), set()
    for s in range(len(raw) - 99):
        if raw[s : s + 100] in seen:
            gone.update(range(s, s + 100))
        seen.add(raw[s : s + 100])
    return bytes(b for k, b in enumerate(raw) if k not in gone)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    sizes = np.array([1200, 5, 0, 1795])
    text, anchor, place, first, number = anchors(raw, sizes, 24)
    assert number.sum() == (1200 - 23) + (1795 - 23)
    at = {}
    for t, p, f, n in zip(text, place, first, number):
        for s in range(f, f + n):
            assert s <= p <= s + 20
            assert at.setdefault(raw[s : s + 24].tobytes(), p - s) == p - s


@pytest.mark.parametrize("chunk", [1, 3, 7, 200])
def test_one_group_in_several_chunks_through_files(tmp_path, chunk):
    """All places of one byte as the sample: the induced windows are the late ones of all strings."""
    rng = random.Random(chunk)
    text = "".join(rng.choice("ab") for _ in range(160)).encode()
    length, reach = 8, 5
    sample = sorted((text[p : p + length], p) for p in range(reach, len(text) - length + 1) if text[p] == 97)
    lcp = [0]
    for (a, _), (b, _) in zip(sample, sample[1:]):
        lcp.append(next((i for i in range(length) if a[i] != b[i]), length))
    column = lambda v, kind=np.int64: np.array(v, kind)
    whole = {
        "group": column([0] * len(sample)), "lcp": column(lcp, np.int16), "reach": column([reach] * len(sample), np.int16),
        "left": column([list(text[p - reach : p][::-1]) for _, p in sample], np.uint8), "owner": column([0] * len(sample)),
        "place": column([p for _, p in sample]),
    }
    chunks = ({k: v[i : i + chunk] for k, v in whole.items()} for i in range(0, len(sample), chunk))
    got = Counter()
    for layer, late in induce(chunks, length, chunk, str(tmp_path)):
        got.update((layer, int(p)) for p in late["place"])
    truth = Counter()
    for layer in range(reach + 1):
        seen = set()
        for p in sorted(p for _, p in sample):
            string = text[p - layer : p - layer + length]
            if string in seen:
                truth[layer, p] += 1
            seen.add(string)
    # windows of one layer are compared with each other; their strings reach no further than the sample's
    assert got == truth
    assert not list(tmp_path.iterdir())  # files are deleted as they are read


def test_queue_keeps_order_within_a_key():
    queue = Queue(4, "/nowhere")
    queue.held = 100
    lcp = np.array([0, 5, 2, 7], np.int16)
    queue.push(np.arange(4), np.array([3, 1, 3, 1]), {"lcp": lcp, "v": np.array([10, 11, 12, 13])})
    queue.push(np.arange(2), np.array([1, 3]), {"lcp": np.array([4, 1], np.int16), "v": np.array([14, 15])})
    (out,) = queue.pop()
    assert out["v"].tolist() == [11, 13, 14, 10, 12, 15]
    assert out["lcp"].tolist() == [0, 3, 5, 0, 3, 2]
