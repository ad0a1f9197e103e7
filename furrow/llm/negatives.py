"""Hard negatives by Fagin's threshold algorithm on integer scores.

Rows are dealt into blocks. A block keeps one list of its rows per dimension,
sorted by component. An anchor reads all lists at once, each from the end that
its own component's sign makes the better one; every row met for the first time
is scored in full. The threshold is what the components at the present depth
would add up to: no row not yet met scores more. A block is done with an anchor
once the threshold lies strictly below the kth score of each window asked for
(or below the window's floor). The best of all blocks are then merged.

Anchors are sent to the blocks, never blocks to the anchors: a task reads a
block's rows, builds the lists and lets the anchors stream past.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm.common import checkpoint

#: Rows of a block; also rows below which a block is not split for parallelism.
BLOCK, LEAST_BLOCK = 1 << 18, 1 << 12
#: Magnitude of a score up to which sums of doubles are exact.
EXACT = 1 << 53


class Block:
    """Rows with their per-dimension lists."""

    def __init__(self, ids: pa.Array, labels: np.ndarray, rows: np.ndarray):
        # a smaller place is a smaller id, so that places settle ties
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((self.ids, self.none))
        self.none, self.ids = self.none[order], self.ids[order]
        self.labels, self.rows = labels[order], rows[order]
        self.lists = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.lists, axis=0)

    def name(self, place: int) -> int | None:
        return None if self.none[place] else int(self.ids[place])

    def best(self, own: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, same: bool):
        """[(places, scores)] of each window's first k rows in this block.

        A window is (floor, ceiling) on scores, both included. Only rows of the
        anchor's label count if ``same``, else only rows of other labels; rows
        whose id is ``own`` never count.
        """
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        sign = np.sign(anchor[dims])
        right = ((self.labels == label) == same) & (self.none | (self.ids != own))
        met = np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        floor = min(w[0] for w in windows)
        found, depth, step = [], 0, max(16, n // 256)
        while True:
            end = min(n, depth + step) if len(dims) else n
            at = np.arange(depth, end)
            if len(dims):
                near = np.concatenate([self.lists[at if s < 0 else n - 1 - at, d] for d, s in zip(dims, sign)])
                new = np.zeros(n, bool)
                new[near] = True
                new &= ~met
            else:  # every score is 0
                new = ~met
            met |= new
            new = np.flatnonzero(new & right)
            got = self.rows[new] @ anchor
            useful = got >= floor
            places, scores = np.concatenate((places, new[useful])), np.concatenate((scores, got[useful]))
            depth, step = end, step * 2
            last = [self.values[end - 1 if s < 0 else n - end, d] for d, s in zip(dims, sign)]
            threshold = float(np.dot(anchor[dims], last))
            found, done = [], True
            for low, high in windows:
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                inside = inside[np.lexsort((places[inside], -scores[inside]))][:k]
                found.append((places[inside], scores[inside]))
                enough = scores[inside[-1]] if len(inside) == k else low
                done &= threshold < enough
            if done or depth == n or met.all():
                return found


def _searched(rows: DataFrame, asked: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score): each block's first k rows of each window.

    ``rows`` has vec_id, label, row, block; ``asked`` vec_id, label, row, slots
    (what a window stands for), lows, highs.
    """
    nothing = [F.lit(None).cast("array<long>").alias(c) for c in ("slots", "lows", "highs")]
    stored = rows.select("block", F.lit(0).alias("kind"), "vec_id", "label", "row", *nothing)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asking = asked.select(every, F.lit(1).alias("kind"), "vec_id", "label", "row", "slots", "lows", "highs")
    dealt = stored.unionByName(asking).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches):
        parts, block, number = [], None, None
        for batch in batches:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers * 2 + kinds)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                flat = piece.column("row").flatten().to_numpy().astype(np.float64)
                matrix = flat.reshape(b - a, len(flat) // (b - a))
                labels = piece.column("label").to_numpy()
                if int(numbers[a]) != number:
                    parts, block, number = [], None, int(numbers[a])
                if kinds[a] == 0:
                    parts.append((piece.column("vec_id"), labels, matrix))
                    continue
                if not parts and block is None:  # a block without rows
                    continue
                if block is None:
                    ids, kept, matrices = zip(*parts)
                    block, parts = Block(pa.concat_arrays(ids), np.concatenate(kept), np.concatenate(matrices)), []
                out = []
                for i, own in enumerate(piece.column("vec_id").to_pylist()):
                    slots, lows, highs = (piece.column(c)[i].as_py() for c in ("slots", "lows", "highs"))
                    for slot, (at, scores) in zip(slots, block.best(own, labels[i], matrix[i], list(zip(lows, highs)), k, same)):
                        out += [(own, slot, block.name(p), int(s)) for p, s in zip(at.tolist(), scores.tolist())]
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "slot", "vec_id", "score"])

    return dealt.mapInArrow(run, "anchor_id long, slot long, vec_id long, score long")


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, row): rows that take part, components as floor(scale * x).

    Rows that repeat id, label and vector count once. Shorter vectors are
    filled up with zeros to the longest.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    width, most = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if width and ((most or 0) * scale + 1) ** 2 * width >= EXACT:
        raise ValueError("components too large for exact integer scores")
    filled = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width or 0) - F.size("x")))
    return rows.select("vec_id", "label", F.transform(filled, lambda x: F.floor(x * scale).cast("long")).alias("row")).distinct()


def mine(
    df: DataFrame,
    anchors,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    relabel=None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Score of two rows: inner product of their components floor(scale * x), x as
    double; higher first, ties by smaller vec_id, null ids last. ``anchors`` is a
    condition on vec_id; an anchor's positives are its first rows of its own
    label. For each of them come the first rows of other labels whose score is
    ``low`` to ``high`` percent of the positive's. ``relabel`` maps the label
    column (vec_id, label) before all else.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part. Rows that repeat id, label and vector count once; a row with
    the anchor's own id is never its positive or negative. An anchor without
    positives, a positive without negatives, and an empty table give no rows. A
    null id is no anchor; of several different rows with one id the least (by
    label, then components) is the anchor, all are candidates. Vectors of no components score 0. Other columns are
    ignored. Components must be so small that no score passes 2**53, else it is
    an error.
    """
    given = df if relabel is None else df.withColumn(label_col, relabel)
    rows = checkpoint(usable(given, id_col, vector_col, label_col, scale))
    total = rows.count()
    wide = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // BLOCK), min(wide, -(-total // LEAST_BLOCK)), 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "row"), F.lit(blocks)).cast("int"))
    once = Window.partitionBy("vec_id").orderBy("label", "row")
    asking = rows.where(F.col("vec_id").isNotNull() & anchors).withColumn("copy", F.row_number().over(once)).where("copy = 1").drop("copy")
    whole = F.array(F.lit(0).cast("long")), F.array(F.lit(-EXACT)), F.array(F.lit(EXACT))
    first = _searched(dealt, asking.select("*", *(c.alias(n) for c, n in zip(whole, ("slots", "lows", "highs")))), blocks, positives, True)
    by_score = lambda *key: Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = first.withColumn("place", F.row_number().over(by_score("anchor_id"))).where(F.col("place") <= positives)
    # 100 * negative lies from low * positive to high * positive, both included
    best = best.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = checkpoint(best)
    floor = F.ceil(F.col("positive_score") * low / F.lit(100).cast("decimal(20,0)")).cast("long")
    ceiling = F.floor(F.col("positive_score") * high / F.lit(100).cast("decimal(20,0)")).cast("long")
    windows = best.select("anchor_id", F.struct(F.col("place").cast("long").alias("place"), floor.alias("low"), ceiling.alias("high")).alias("w"))
    windows = windows.where("w.low <= w.high").groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("w"))  # at most ``positives``
    asked = asking.join(windows, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "row", F.col("w.place").alias("slots"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")
    )
    last = _searched(dealt, asked, blocks, negatives, False)
    ranked = last.withColumn("rank", F.row_number().over(by_score("anchor_id", "slot"))).where(F.col("rank") <= negatives)
    return ranked.join(best.withColumnRenamed("place", "slot"), ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
