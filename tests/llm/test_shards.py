import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from furrow.llm import shards
from furrow.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS, SF


def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_against_the_plain_loop():
    keys = np.array([0, 1, 2**63, 2**64 - 1, *range(5, 3000, 7)], np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert shards.jump(keys, n).tolist() == [jump_by_hand(int(k), n) for k in keys]


def test_query(spark, given):
    rows = QUERIES["op2_sharding"](spark, SF).collect()
    texts = dict(given)
    assert len(rows) == len(given)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        key = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == jump_by_hand(key, 16) and r["grown_shard"] == jump_by_hand(key, 17)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_are_even(spark):
    rows = shards.assign(spark.range(40_000).selectExpr("id doc_id", "'x' text"), shards=10, blocks=8).collect()
    assert all(3_600 < n < 4_400 for n in Counter(r["shard"] for r in rows).values())


def test_rows_of_one_id_are_divided(spark):
    rows = shards.assign(spark.range(3_000).selectExpr("cast(null as long) doc_id", "cast(id as string) text"), shards=4, blocks=8).collect()
    assert len({r["shard"] for r in rows}) == 1
    assert sorted(r["slot"] for r in rows) == list(range(3_000))
    assert [r["slot"] for r in rows] != [r["slot"] for r in sorted(rows, key=lambda r: (r["size"], r["text_crc32"]))]


def test_odd_rows(odd, none):
    rows = shards.assign(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD_TEXTS)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert shards.assign(none).count() == 0
