"""A training-data pipeline over documents: each stage is an operator of lodestone.llm.

Stages work on all that the one before kept. Rows with null or empty texts have no letter, so the first stage
drops them; all stages carry further columns of whatever name along, and give an empty table for an empty one. Where an
id has several texts, each is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard_join, language_id, pieces, pii
from lodestone.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language ("und")."""
    taken = max(map(len, docs.columns)) * "_"
    lang, score = f"{taken}lang", f"{taken}score"
    judged = language_id.identify(docs, language_id.profiles_of(docs), lang, score)
    return judged.where(f"{lang} <> 'und'").drop(lang, score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out and drops documents that mostly consist of them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts marks in place of personal data."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip."""
    return pieces.encode(docs, pieces.model_path())


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark),
    ("pii", private),
    ("sentencepiece", encoded),
]

#: MinHash and learned profiles can't be written in SQL; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
