"""Each stage of the corpus pipeline against plain loops, and the chain of them."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from furrow.llm import secrets, toxicity
from furrow.llm.wordids import word_ids
from furrow.llm.queries import WORD_TOKENIZER
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_neardup import classes, simhash_by_hand

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with odd rows added: repeated and null ids, nulls, long and empty texts."""
    path = str(tmp_path_factory.mktemp("data"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    odd = [(i, t, None, None, None) for i, t in ODD_TEXTS] + [(3, "other words under the id of another row entirely", None, None, None)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("extra", F.lit("x")).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def one_of_each(found):
    """The row with the smallest id (then any text) of each component of plain SimHash links."""
    prints = {}
    for k, (_, text) in enumerate(found):
        prints.setdefault(simhash_by_hand(text or ""), []).append(k)
    groups = {}
    for k, root in classes(prints).items():
        groups.setdefault(root, []).append(k)
    return [[found[k] for k in g] for g in groups.values()]


def test_stages_and_chain(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    released = []
    release = P.release
    monkeypatch.setattr(P, "release", lambda spark, f: released.append(f) or release(spark, f))

    clean = P.drop_toxic(spark, docs, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), where=toxicity.remainder() != 0)
    assert clean.columns == docs.columns
    want = Counter((i, t) for i, t in rows(docs) if model.score(t or "")[0] < 0.5)
    assert Counter(rows(clean)) == want and 0 < sum(want.values()) < docs.count()

    kept = P.drop_near_copies(spark, docs, folder)
    groups, left = one_of_each(rows(docs)), Counter(rows(kept))
    order = lambda row: (row[0] is None, row[0] or 0)
    assert sum(left.values()) == len(groups)
    for group in groups:
        stays = [row for row in set(group) if left[row]]
        assert len(stays) == 1 and order(stays[0]) == min(map(order, group))
    assert kept.columns == docs.columns

    hidden = P.hide_secrets(spark, docs, folder)
    words = secrets.Words(secrets.WORDS + secrets.corpus_words(docs))
    plain = lambda t: None if t is None else secrets.redacted(t, secrets.find(t, words=words)[1], "<secret>")
    assert Counter(rows(hidden)) == Counter((i, plain(t)) for i, t in rows(docs))
    assert all(r["n_chars"] == len(r["text"]) for r in hidden.where("text is not null").collect())

    tokenizer = word_ids(WORD_TOKENIZER).tokenizer
    tokens = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    packed = P.pack(spark, docs, folder).collect()
    placed = Counter()
    for r in packed:
        placed[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert placed == sum((Counter({(i, tokens(t)): tokens(t)}) for i, t in rows(docs)), Counter())

    # the chain: each stage on all that the one before has kept
    given = docs
    for name, stage in P.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, given, folder).write.parquet(path)
        given = spark.read.parquet(path)
    want = Counter((r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in P.pack(spark, given, folder).collect())
    got = Counter((r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(spark, folder).collect())
    assert got == want
    assert len(released) == len(P.STAGES) - 2 and not any(os.path.exists(f.removeprefix("file:")) for f in released)


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0
