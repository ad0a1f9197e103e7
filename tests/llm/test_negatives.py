import random
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import negatives
from furrow.llm.negatives import Block

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block string, score string, kind string"


def by_hand(rows, every=1, positives=5, negatives=10, low=30, high=90):
    """Plain loops; a row is (vec_id, vector, label)."""
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    taken = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not isfinite(x) for x in v):
            continue
        taken[(i, label, tuple(floor(256 * x) for x in v) + (0,) * (width - len(v)))] = None
    anchors = {}
    for i, label, v in sorted(taken, key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2])):
        if i is not None and i % every == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        order = lambda t: (-t[0], t[1] is None, t[1] or 0)
        scored = [(sum(x * y for x, y in zip(v, w)), i, m == label) for i, m, w in taken if i != a]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            fit = sorted((s for s in scored if not s[2] and low * ps <= 100 * s[0] <= high * ps), key=order)
            out += [(a, p, r, n, ps, ns) for r, (ns, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out, key=str)


def found(df, **options):
    got = negatives.mine(df, F.col("vec_id") % options.pop("every", 1) == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_loops_with_ties(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_BLOCK", 40)  # several blocks
    rng = random.Random(seed)
    grid = [x / 256 for x in range(-3, 4)] if seed == 1 else [x / 64 for x in range(-1, 9)]
    rows = [(i, [rng.choice(grid) for _ in range(6)], rng.randrange(3)) for i in range(200)]
    rows += rows[:20] + [(i, v, (l + 1) % 3) for i, v, l in rows[30:40]]  # repeated rows, one id on unlike rows
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA).repartition(3)
    assert found(df, every=5) == by_hand(rows, every=5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0), (3, [0.25, 0.125], 1), (None, [0.25, 0.125], 1), (4, [0.25], 1), (5, [], 1),
        (6, None, 0), (7, [0.5, None], 0), (8, [nan, 0.1], 1), (9, [inf, 0.1], 1), (10, [0.5, 0.25], None), (11, [-0.5, -0.25], 1),
        (None, [0.5, 0.25], 0), (12, [0.0, 0.0], 2), (13, [0.0, 0.0], 2),
    ]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = found(df)
    assert got == by_hand(rows)
    assert any(r[3] is None for r in got) and any(r[1] is None for r in got)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    alone = spark.createDataFrame([(1, [], 0, None, None, None, None), (2, [], 1, None, None, None, None)], SCHEMA)
    assert found(alone) == []
    with pytest.raises(ValueError):
        found(spark.createDataFrame([(1, [1e30], 0, None, None, None, None)], SCHEMA))


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(4000, 3)).round(2) * 100
    rows[:40] += 1000
    block = Block(pa.array(range(4000)), np.zeros(4000, np.int64), rows)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and isinstance(at[0], np.ndarray):
                reads.append(len(at[0]))
            return super().__getitem__(at)

    block.lists = block.lists.view(Counted)
    anchor = np.array([5.0, 3.0, 0.0])
    (places, scores), = block.best(-1, 0, anchor, [(-1e15, 1e15)], 10, True)
    truth = rows @ anchor
    order = np.lexsort((np.arange(4000), -truth))[:10]
    assert places.tolist() == order.tolist() and scores.tolist() == truth[order].tolist()
    assert sum(reads) < 400  # of 8,000 entries of two lists
