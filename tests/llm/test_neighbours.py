import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import neighbours
from furrow.llm.queries import QUERIES
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, ids string"


def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        scored = sorted((-float(np.dot(vectors[i], v)), n) for n, v in zip(ids, vectors) if n != q)
        out[q] = scored[:k]
    return out


def recall(rows, truth):
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, best in truth.items():
        got = sorted(found.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        names = {n for _, n in best}
        hits += sum(r["vec_id"] in names for r in got)
        total += len(best)
    return hits / total


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_query_recall(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in given], np.array([r["embedding"] for r in given], float)
    rows = QUERIES["op3_nearest_neighbours"](spark, folder).collect()
    at = {n: i for i, n in enumerate(ids)}
    assert all(r["score"] == pytest.approx(float(vectors[at[r["query_id"]]] @ vectors[at[r["vec_id"]]]), abs=1e-12) for r in rows)
    assert all(r["query_id"] != r["vec_id"] for r in rows)
    assert recall(rows, exact(ids, vectors, [n for n in ids if n % 20 == 0], 20)) >= 0.9


def test_narrow_windows_do_for_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 4
    vectors = np.concatenate([c + rng.standard_normal((60, 16)) * 0.2 for c in centres]).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, v.tolist(), 0, None, None, None) for i, v in zip(ids, vectors)], SCHEMA)
    rows = neighbours.search(df, F.col("vec_id") % 50 == 0, k=10, share=0.15).collect()
    assert recall(rows, exact(ids, vectors.astype(float), ids[::50], 10)) >= 0.9


def test_longer_vectors_win(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.standard_normal((600, 8)) * rng.uniform(0.1, 5, (600, 1))).astype(np.float32)
    ids = list(range(600))
    df = spark.createDataFrame([(i, v.tolist(), 0, None, None, None) for i, v in zip(ids, vectors)], SCHEMA)
    rows = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    assert recall(rows, exact(ids, vectors.astype(float), ids[::20], 10)) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0, None, None, None) for i in range(50)]
    rows += [(0, same, 0, None, None, None), (100, None, 0, None, None, None), (120, [0.0, 0.0, 0.0], 0, None, None, None)]
    rows += [(140, [1.0, None, 1.0], 0, None, None, None), (160, [float("nan"), 1.0, 1.0], 0, None, None, None), (None, same, 0, None, None, None)]
    rows += [(180, [1.0], 0, None, None, None), (200, [-1.0, 0.0, 0.0], 0, None, None, None), (220, [], 0, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4]}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, same, 0, None, None, None)], SCHEMA)
    assert neighbours.search(one, F.col("vec_id") % 20 == 0).count() == 0


def test_many_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-1, 2, (500, 4)).astype(float)  # few values, so that most scores tie
    vectors[(vectors == 0).all(1), 0] = 1
    df = spark.createDataFrame([(int(i), v.tolist(), 0, None, None, None) for i, v in zip(rng.permutation(500), vectors)], SCHEMA)
    of = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, k=5, share=1.0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, found in got.items():
        assert found == sorted((i for i in of if i != q), key=lambda i: (-float(of[q] @ of[i]), i))[:5]
    assert len(got) == 10


def test_hilbert_keys_walk_through_neighbouring_cells():
    for dims, bits in ((1, 3), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
