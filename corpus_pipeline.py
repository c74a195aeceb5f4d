"""The corpus pipeline: five stages over ``documents``, each read back from Parquet.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfathom.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_codec, shared

#: The vocabulary of the last stage, by the name its package knows.
VOCABULARY = "piece_bpe_32k.model"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from labelled documents of the directory outside the held-out fold;
    a score of one half or more stays. Null texts are scored as empty ones.
    """
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, machine, score_col="__score")
    return scored.where("__score >= 0.5").select(*shared.named(*docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest identifier."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest identifier.

    Five-word shingles, similarity 0.8 or more. A document with a null identifier
    is linked with nothing and stays.
    """
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as a mix of sources by weight takes them.

    A document may come once for each of up to three passes over its source, and
    one at the edge of a taken block keeps only the words taken.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, checked by decoding them again."""
    return sentencepiece_codec.encode(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The classifier, the draws of the mix and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.materialise(docs, f"stage-{name}")
    return docs
