"""Canaries: texts and vectors of an embedding profile, kept as JSON and compared later.

The first capture of a profile stays; what a provider gives later for the same texts is
compared with it bit by bit, so a model that was exchanged behind one name is seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.functions import vectors as V
from sparkfathom.operators import embedding

CANARIES = "embedding_profile_id long, payload string"
_DECODED = "array<struct<text: string, vector: array<float>>>"

#: Texts that every profile is asked for: plain, long, numeric, accented and odd ones.
TEXTS = (
    "the quick brown fox jumps over the lazy dog",
    "a measurement of 12.5 mm at 300 K, repeated 1000 times",
    "naïve café façade über straße",
    "def total(rows): return sum(r.amount for r in rows)",
    "one",
)


def fresh(spark: SparkSession, provider: Callable[[], embedding.Provider], texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """``text, vector`` as the provider gives them now; a refused text is an error."""
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    made = embedding.embed(rows, provider).collect()
    failed = [r["error"] for r in made if r["error"] is not None]
    if failed:
        raise ValueError(f"canary texts were refused: {failed[0]}")
    return spark.createDataFrame([(r["content"], r["embedding"]) for r in made], "text string, vector array<float>")


def captured(vectors: DataFrame, profile: int) -> DataFrame:
    """One row, ``embedding_profile_id, payload``, of ``text, vector`` rows."""
    packed = F.to_json(F.sort_array(F.collect_list(F.struct("text", "vector"))))
    return vectors.agg(F.lit(profile).cast("long").alias("embedding_profile_id"), packed.alias("payload"))


def decoded(stored: DataFrame, key: str = "embedding_profile_id", payload: str = "payload") -> DataFrame:
    """``key, text, vector`` of stored payloads; a payload that is no such JSON has no rows."""
    return stored.select(key, F.inline(F.from_json(payload, _DECODED)))


def compared(stored: DataFrame, now: DataFrame) -> str:
    """``identical``, ``scheduling`` or ``semantic``; other texts or dimensions are an error.

    They mean that the texts or the model's shape changed, which is no drift.
    """
    both = stored.select("text", F.col("vector").alias("was")).join(now.select("text", F.col("vector").alias("now")), "text", "full")
    shape = both.agg(
        F.count_if(F.col("was").isNull() | F.col("now").isNull()).alias("unmatched"),
        F.count_if(F.size("was") != F.size("now")).alias("resized"),
        F.bool_and(F.col("was") == F.col("now")).alias("same"),
    ).first()
    if shape["unmatched"]:
        raise ValueError(f"{shape['unmatched']} canary texts have no counterpart")
    if shape["resized"]:
        raise ValueError(f"{shape['resized']} canary vectors have another dimension")
    if shape["same"]:
        return "identical"
    row = V.worst_agreement(both, "was", "now").first()
    return embedding.canary_verdict(row["worst_cosine"], row["max_difference"])
