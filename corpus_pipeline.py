"""Corpus pipeline over the documents table: toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. Stages keep the columns of documents, the
last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import neardup, packing, secrets, toxicity
from furrow.llm.common import read
from furrow.llm.queries import WORD_TOKENIZER
from furrow.session import release, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labels does not predict toxic; null
    ids and texts, repeated rows and all columns stay as they are."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), where=toxicity.remainder() != 0)
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate group."""
    return neardup.keep_one(docs, neardup.near_duplicates(docs, shingle=3, radius=2, marks=True))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced in the text; n_chars follows the new text, a null text
    stays null."""
    return secrets.redact(docs, size_col="n_chars", common=secrets.corpus_words(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens, placed into sequences; a null or empty
    text is its end token alone."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", hide_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Every result but the last is stored in between; a stage's input is deleted
    once its result is stored. An empty table goes through all stages; null ids
    and texts, repeated rows and further columns are treated as each stage says.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark)
        stored = stage(spark, docs, sf_dir)
        stored.write.parquet(folder)
        docs = spark.read.schema(stored.schema).parquet(folder)
        if before is not None:
            release(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
