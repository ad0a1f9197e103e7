import zlib
from collections import Counter

import numpy as np
import pytest

from furrow.llm import toxicity
from furrow.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS, SF


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in set(scores):
        own = [i for i, x in enumerate(scores) if x == s]
        ranks[own] = ranks[own].mean()
    pos = np.array(truth) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op5_toxicity"](spark, folder)
    held = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    truth = [r["toxic"] for r in held]
    assert auc([r["score"] for r in held], truth) >= 0.75  # a third of the toxic labels have no toxic word
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.01 * truth.count(0)
    assert sum(r["predicted"] for r in held if r["toxic"]) >= 0.55 * truth.count(1)


def test_query_shape(spark, given):
    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in given]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(list("abcdefghij"), 6)) + "." for _ in range(5)]
        if i % 5 == 0:
            sentences[i % 3] = "you are a horrid person."
        docs.append((i, " ".join(sentences)))
        labels.append((i, 1, int(i % 5 == 0)))
    return toxicity.fit(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )


def test_offending_sentence_is_found(model):
    text = "a b c d. you are a horrid person! e f g."
    p, start, end, worst = model.score(text)
    assert text[start:end].strip() == "you are a horrid person!" and p >= 0.5 and worst >= 0.5
    assert model.score("a b c d. e f g.")[0] < 0.5 and model.score("")[0] < 0.5


def test_noisy_or_of_sentences(model):
    text = "a horrid one. a b c. person here. you."
    by_hand = 1 - (1 - model.leak) * np.prod([1 - p for p, _, _ in model.sentences(text)])
    assert model.score(text)[0] == pytest.approx(by_hand)


def test_gradient_descends_to_the_likelihood_optimum():
    # one word: toxic in 30 of 40 bags with it, never without it
    from pyspark.sql import Row

    bags = [Row(y=1, told=[[0]], n=30), Row(y=0, told=[[0]], n=10), Row(y=1, told=[], n=6), Row(y=0, told=[], n=54)]
    weights, bias, leak = toxicity._descend(bags, 1, steps=3000, ridge=0.0)
    assert leak == pytest.approx(0.1, abs=0.005)
    assert toxicity.Model(["w"], weights, bias, leak).score("w")[0] == pytest.approx(0.75, abs=0.01)


def test_odd_rows(spark, odd, none, model):
    rows = toxicity.score(odd, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD_TEXTS)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 6)}) <= 2
    assert toxicity.score(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (4, 0), (4, 1), (5, 0), (6, 0)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels).weights == {}
    assert toxicity.fit(none, labels.limit(0)).score("")[0] == pytest.approx(0.5)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD_TEXTS)
