import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from furrow.llm import neardup
from furrow.llm.components import components
from furrow.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS, SF


def simhash_by_hand(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), text.encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=2):
    """doc -> smallest doc reachable, from all pairs; docs of one fingerprint by list."""
    values = list(prints)
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    least = {}
    for v in values:
        for d in prints[v]:
            least[top(v)] = min(least.get(top(v), d), d)
    return {d: least[top(v)] for v in values for d in prints[v]}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    prints, of = {}, {}
    for i, t in docs:
        of[i] = simhash_by_hand(t)
        prints.setdefault(of[i], []).append(i)
    root = classes(prints)
    rows = QUERIES["op7_simhash_near_dedup"](spark, folder).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{of[i]:016x}", root[i]) for i, _ in docs}
    assert len(rows) == len(docs)


@pytest.mark.parametrize("walk", [3, 512])
def test_links_against_all_pairs(spark, walk):
    rng = random.Random(walk)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = set(seeds)
    for s in seeds:
        at = s
        for _ in range(rng.randint(0, 25)):  # chains of small steps, and stars
            at = (at if rng.random() < 0.7 else s) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            values.add(at)
    signed = {np.uint64(v).astype(np.int64).item(): v for v in values}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(neardup.link(df, 2, walk)).collect()}
    got = {s: roots.get(s, s) for s in signed}
    truth = classes({v: [s] for s, v in signed.items()})
    groups = lambda of: {frozenset(k for k in of if of[k] == g) for g in set(of.values())}
    assert groups(got) == groups(truth)


def test_masks_cover_every_pair_of_positions():
    from itertools import combinations

    masks = neardup.covering_masks(2)
    assert len(masks) == 7
    for i, j in combinations(range(64), 2):
        assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (None, 5), (401, 400), (400, 401)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 260)}, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD_TEXTS)
    empty = [r for r in rows if int(r["fingerprint"], 16) == 0]
    assert len(empty) == 4 and {r["component_id"] for r in empty} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(odd, neardup.near_duplicates(odd, marks=True))
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 7, -9, None])
    assert neardup.keep_one(none, neardup.near_duplicates(none, marks=True)).count() == 0


def test_one_row_of_each_component_stays(make_docs):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = a + " more"
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (7, near), (None, c), (None, "alone"), (None, "alone")]
    df = make_docs(rows)
    found = neardup.near_duplicates(df, radius=8, marks=True)
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.keep_one(df, found).collect())
    assert kept == Counter([(1, a), (5, b), (7, c), (None, "alone")])
    assert neardup.keep_one(df.where("doc_id is null"), neardup.near_duplicates(df.where("doc_id is null"), marks=True)).count() == 2
