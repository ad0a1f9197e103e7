"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with words that speak for toxicity
has a probability from a logistic model over them, and the document's is their
noisy-or with a leak: 1 - (1 - leak) * prod(1 - p). Only document labels are
needed to train it, and the sentence scores then say which sentence offends.
Sentences without such words add nothing, so a clean text stays clean however
long it is.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from furrow.llm.common import bounded, checkpoint, fresh, texts

#: Labelled documents that a fit reads, the first by checksum of the id.
SAMPLE = 20_000
#: Words a model may weigh, and in how many sampled documents a word has to be.
VOCABULARY = 2_000
LEAST_DOCS = 12
#: Likelihood-ratio statistic from which a word tells the classes apart.
LEAST_GAIN = 24.0
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
WORD = re.compile(r"[^\W\d_]+")


class Model:
    """Word weights, the bias of a sentence that has a known word, and the leak."""

    def __init__(self, words: list[str], weights: np.ndarray, bias: float, leak: float):
        self.weights = dict(zip(words, map(float, weights)))
        self.bias, self.leak = float(bias), float(leak)

    def sentences(self, text: str) -> list[tuple[float, int, int]]:
        """(probability, start, end) of each sentence that has a known word."""
        known, out = self.weights, []
        for s in SENTENCE.finditer(text):
            hit = known.keys() & WORD.findall(s[0].lower())
            if hit:
                z = self.bias + sum(sorted(known[w] for w in hit))
                out.append((1 / (1 + math.exp(-z)) if z > -700 else 0.0, s.start(), s.end()))
        return out

    def score(self, text: str) -> tuple[float, int, int, float]:
        """(document's probability, start, end and probability of its worst sentence).

        A text without known words has the leak as its probability, and its
        worst sentence is (0, 0) with probability 0.
        """
        found = self.sentences(text)
        log_clean = math.log1p(-self.leak) + sum(math.log1p(-min(p, 1 - 1e-12)) for p, _, _ in found)
        p, start, end = max(found, key=lambda x: (x[0], -x[1]), default=(0.0, 0, 0))
        return -math.expm1(log_clean), start, end, p


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def _sample(labels: DataFrame, label_col: str, sample: int, where: Column | None) -> DataFrame:
    rows = labels.where(where) if where is not None else labels
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    return rows.orderBy(F.crc32(F.col("_id").cast("string").cast("binary")), "_id").limit(sample)


def _gain(pos: Column, neg: Column, all_pos: int, all_neg: int) -> Column:
    """Likelihood-ratio statistic of word against label."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    total = all_pos + all_neg
    n = pos + neg
    return 2 * (
        part(pos, n * all_pos / total) + part(neg, n * all_neg / total)
        + part(F.lit(all_pos) - pos, (F.lit(total) - n) * all_pos / total)
        + part(F.lit(all_neg) - neg, (F.lit(total) - n) * all_neg / total)
    )


def fit(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    where: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    vocabulary: int = VOCABULARY,
) -> Model:
    """Learn sentence weights from document labels.

    Reads the texts of at most ``sample`` labelled documents (``where`` chooses
    among the labels), weighs at most ``vocabulary`` words, and fits on the
    driver from those documents' known words alone. Rows without id or label are
    left out; a document labelled twice has its larger label; equal texts are
    learnt from once. Only words that are commoner in toxic documents are
    weighed. Without labelled documents of both classes the model knows no words
    and its leak is the share of toxic ones.
    """
    chosen = _sample(labels, label_col, sample, where)
    docs = texts(df, id_col, text_col)
    # at most ``sample`` short rows
    learnt = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy(F.xxhash64("text").alias("h")).agg(
        F.min("text").alias("text"), F.max("y").alias("y")
    )
    learnt = checkpoint(learnt.select("text", "y"))
    by_label = {r["y"]: r["n"] for r in learnt.groupBy("y").agg(F.count("*").alias("n")).collect()}
    all_pos, all_neg = by_label.get(1, 0), by_label.get(0, 0)
    if not all_pos or not all_neg:
        return Model([], np.zeros(0), 0.0, (all_pos + 0.5) / (all_pos + all_neg + 1))

    def counts(batches):
        for batch in bounded(batches):
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for w in set(WORD.findall(text.lower())):
                    seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict(
                {"w": list(seen), "pos": [c[1] for c in seen.values()], "neg": [c[0] for c in seen.values()]}
            )

    words = (
        learnt.mapInArrow(counts, "w string, pos long, neg long").groupBy("w")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((F.col("pos") + F.col("neg") >= LEAST_DOCS) & (F.col("pos") * all_neg > F.col("neg") * all_pos))
        .withColumn("gain", _gain(F.col("pos"), F.col("neg"), all_pos, all_neg))
        .where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "w").limit(vocabulary)
    )
    known = [r["w"] for r in words.select("w").collect()]
    number = {w: i for i, w in enumerate(known)}

    def bags(batches):
        for batch in bounded(batches):
            rows = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                hits = (number.keys() & WORD.findall(s.lower()) for s in SENTENCE.findall(text))
                rows.append({"y": y, "told": sorted(sorted(number[w] for w in hit) for hit in hits if hit)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("y", pa.int32()), ("told", pa.list_(pa.list_(pa.int32())))]))

    found = learnt.mapInArrow(bags, "y int, told array<array<int>>")
    # equal bags weigh together: at most ``sample`` short rows reach the driver
    found = found.groupBy("y", "told").agg(F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["y"], r["told"]))
    return Model(known, *_descend(found, len(known)))


def _descend(
    bags: list, words: int, steps: int = 400, rate: float = 0.1, ridge: float = 2e-5
) -> tuple[np.ndarray, float, float]:
    """Full-batch Adam on the noisy-or likelihood; (weights, bias, leak)."""
    y = np.array([b["y"] for b in bags], float)
    n = np.array([b["n"] for b in bags], float)
    n /= n.sum()
    of_doc, of_sentence, of_word, sentences = [], [], [], 0
    for d, b in enumerate(bags):
        for s in b["told"]:
            of_doc.append(d)
            of_sentence += [sentences] * len(s)
            of_word += s
            sentences += 1
    of_doc, of_sentence, of_word = (np.array(x, int) for x in (of_doc, of_sentence, of_word))
    theta = np.append(np.zeros(words), [-2.0, -4.0])  # then bias, leak
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-2] + np.bincount(of_sentence, theta[of_word], sentences)
        # -log(1 - P) is a sum over sentences
        total = np.logaddexp(0, theta[-1]) + np.bincount(of_doc, np.logaddexp(0, z), len(bags))
        # d(-log likelihood)/d(total): 1 for clean documents, -1/(e^total - 1) for toxic ones
        pull = n * np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        by_z = pull[of_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(of_word, by_z[of_sentence], words), [by_z.sum(), pull.sum() / (1 + np.exp(-theta[-1]))])
        grad[:-2] += ridge * theta[:-2]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, worst_start, worst_end, worst_score of every row.

    The worst sentence is given in code points, end exclusive. Null and empty
    texts score like any text without a known word. Repeated rows and null
    ids come back as they are; other columns are ignored.
    """

    def run(batches):
        for batch in bounded(batches):
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            p, start, end, worst = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()),
                    pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(worst, pa.float64()),
                ],
                ["doc_id", "score", "predicted", "worst_start", "worst_end", "worst_score"],
            )

    return texts(df, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, predicted int, worst_start long, worst_end long, worst_score double"
    )


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is not predicted toxic, all columns as they are."""
    mark = fresh(df, "row_text")
    given = df.withColumn(mark, F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def run(batches):
        for batch in bounded(batches, mark):
            stay = pa.array([model.score(t)[0] < 0.5 for t in batch.column(mark).to_pylist()])
            yield batch.filter(stay).drop_columns([mark])

    return given.mapInArrow(run, df.schema)
