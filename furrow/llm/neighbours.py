"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are lifted so that the largest inner product is the smallest distance
(one more component fills them up to the longest norm), projected onto a few
random directions, shifted, and ordered along a Hilbert curve; each of several
curves has its own directions and shift. A curve is cut into ranges. A query is
sent to the ranges around its own key, every range reports its best candidates
by exact inner product, and the reports of all ranges and curves are merged and
ranked again.

Equal vectors are searched once, by their smallest ids. Ranges are fitted on a
bounded sample; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.llm.common import checkpoint

K = 20
CURVES = 4
#: Projected directions of a curve, and bits of a coordinate on it.
DIMS, CELL_BITS = 4, 8
#: Part of each curve that a query's window covers. Isotropic vectors have no
#: near cells to prune, so the window has to be wide; clustered ones need less.
SHARE = 0.45
#: Ranges of a curve at least, and vectors of a range at most (more ranges then).
RANGES, RANGE_ROWS = 32, 50_000
#: Queries that meet a range in one group.
QUERY_BLOCK = 20_000
#: Vectors on which scale and range borders are fitted.
SAMPLE = 5_000
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (n, dims)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


class Curves:
    """Directions, shifts, scale and range borders of all curves."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int, ranges: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.longest = max(longest, 1e-300)
        width = sample.shape[1] + 1
        dims = min(DIMS, width)
        self.axes = [np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 0.5, dims) for _ in range(curves)]
        placed = [self._lifted(sample, False) @ a for a in self.axes]
        self.middle = [p.mean(0) for p in placed]
        self.scale = [np.maximum(p.std(0), 1e-9) for p in placed]
        quantiles = np.arange(1, ranges) / ranges
        self.borders = [np.quantile(self.key(c, sample, False), quantiles).astype(np.int64) for c in range(curves)]

    def _lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(vectors, axis=1)
        if query:  # scaled to the longest norm: that leaves its ranking as it is
            return np.column_stack((vectors / np.maximum(norm, 1e-300)[:, None], np.zeros(len(vectors))))
        short = vectors / self.longest
        return np.column_stack((short, np.sqrt(np.maximum(0.0, 1 - (norm / self.longest) ** 2))))

    def key(self, curve: int, vectors: np.ndarray, query: bool) -> np.ndarray:
        at = (self._lifted(vectors, query) @ self.axes[curve] - self.middle[curve]) / self.scale[curve]
        cells = np.clip((at + 3 + self.shifts[curve]) / 6.5, 0, 1 - 1e-9) * (1 << CELL_BITS)
        return hilbert_keys(cells.astype(np.int64), CELL_BITS)

    def ranges(self, curve: int, vectors: np.ndarray, query: bool) -> np.ndarray:
        return np.searchsorted(self.borders[curve], self.key(curve, vectors, query), side="right")


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def search(
    df: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    share: float = SHARE,
    ranges: int = RANGES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query.

    ``is_query`` picks the queries by the column ``vec_id``. A row is never its
    own neighbour, nor are repeated rows of its id. Score is the inner product
    in double precision; ties go to the smaller id. Rows with a null id, and
    vectors that are null, empty, zero or hold null or non-finite components,
    take no part; vectors of other lengths than most take none either. A repeated
    row counts once. Without candidates a query has no rows. Other columns are
    ignored.
    """
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & _usable(F.col("v"))).dropDuplicates(["vec_id", "v"])
    usual = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if usual is None:
        return empty
    own = own.where(F.size("v") == usual["n"])
    # the smallest k + 1 ids of equal vectors are all that any query can return
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = own.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    points = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = checkpoint(points.withColumn("point", F.col("ids")[0]))
    asked = own.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    asked = asked.join(points.select("v", "point"), "v").select("query_id", "point")

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = points.agg(F.max(norm).alias("longest"), F.count("*").alias("n")).first()
    # at most SAMPLE vectors by hash of their smallest id, a few more leave the tasks
    drawn = F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.3 * SAMPLE / facts["n"]) + 1)
    fitted = points.where(drawn).orderBy(F.xxhash64("point"), "v").select("v").limit(SAMPLE).collect()
    ranges = max(ranges, -(-facts["n"] // RANGE_ROWS))
    window = min(ranges, max(1, round(share * ranges)))
    index = Curves(np.array([r["v"] for r in fitted]), facts["longest"], curves, ranges)
    queries = points.join(asked.select("point").distinct(), "point", "left_semi")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                vectors = np.stack(pdf["v"].to_list())
                for c in range(curves):
                    yield pdf.assign(curve=c, part=index.ranges(c, vectors, False))

    def send(batches):
        for pdf in batches:
            if len(pdf):
                vectors = np.stack(pdf["v"].to_list())
                for c in range(curves):
                    first = np.clip(index.ranges(c, vectors, True) - window // 2, 0, ranges - window)
                    for step in range(window):
                        yield pdf.assign(curve=c, part=first + step)

    stored = points.select("ids", "v").mapInPandas(place, "ids array<long>, v array<double>, curve int, part int")
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int").alias("block")
    sent = queries.select("point", "v").mapInPandas(send, "point long, v array<double>, curve int, part int").select("*", block)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Best k + 1 ids for each query of a range, by exact inner product."""
        if not len(left) or not len(right):
            return pd.DataFrame({"point": [], "ids": [], "scores": []}, dtype=object)
        asking, ids = np.stack(left["v"].to_list()), right["ids"].to_list()
        vectors = np.stack(right["v"].to_list())
        lead = np.array([i[0] for i in ids])
        order = np.argsort(lead, kind="stable")
        vectors, ids = vectors[order], [ids[i] for i in order]
        out_ids, out_scores = [], []
        for at in range(0, len(asking), 256):
            part = asking[at : at + 256]
            rough = part @ vectors.T
            few = min(k + 1, rough.shape[1])
            least = np.partition(rough, rough.shape[1] - few, axis=1)[:, rough.shape[1] - few]
            # all that may tie: the product's last digits may differ from the exact score
            slack = 1e-13 * vectors.shape[1] * np.abs(part).sum(axis=1) * np.abs(vectors).max()
            for q, own, limit in zip(part, rough, least - slack):
                chosen = np.flatnonzero(own >= limit)
                scores = (vectors[chosen] * q).sum(axis=1)
                first = np.lexsort((chosen, -scores))[: k + 1]  # vectors lie in order of their smallest id
                found = sorted((-s, i) for s, c in zip(scores[first].tolist(), chosen[first].tolist()) for i in ids[c])[: k + 1]
                out_ids.append([i for _, i in found])
                out_scores.append([-s for s, _ in found])
        return pd.DataFrame({"point": left["point"], "ids": out_ids, "scores": out_scores})

    keys = ["curve", "part", "block"]
    reports = sent.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(meet, "point long, ids array<long>, scores array<double>")
    # at most curves * window * (k + 1) entries a query
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("far"), F.col("ids").alias("id"))
    best = reports.groupBy("point").agg(F.flatten(F.collect_list(pairs)).alias("all"))
    best = best.select("point", F.slice(F.array_sort(F.array_distinct("all")), 1, k + 1).alias("best"))
    found = asked.join(best, "point").select(
        "query_id", F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k).alias("best")
    )
    return found.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.far")).alias("score")
    )
