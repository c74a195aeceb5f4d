"""Embedding: providers, batches with isolated failures, pooling and canaries."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from sparkfathom.functions import text as T
from sparkfathom.functions import vectors as V

#: A cheap count times this is an upper estimate of tokens; tokens a
#: window keeps for the model; the least cosine of an unchanged model.
ESTIMATE, RESERVED, SAME_MODEL = 1.45, 3, 0.99


class Refused(Exception):
    """A text that the provider can never embed; other errors are tried again."""


class Provider(ABC):
    """Embeds batches of texts. One instance lives in each Python worker."""

    dimension: int
    n_ctx: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def count_tokens(self, text: str) -> int:
        return len(text.split())


class HashProvider(Provider):
    """Deterministic vectors from word hashes, for tests and offline use."""

    def __init__(self, dimension: int = 16, n_ctx: int = 512):
        self.dimension, self.n_ctx = dimension, n_ctx

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                v[h % self.dimension] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


#: Provider factories by name.
PROVIDERS: dict[str, Callable[..., Provider]] = {"hash": HashProvider}


def pooled(vectors: list[list[float]]) -> list[float]:
    """The normalised mean; a zero mean stays as it is."""
    mean = np.mean(np.array(vectors), 0)
    return (mean / (np.linalg.norm(mean) or 1)).tolist()


def embed_batch(provider: Provider, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """``(vector, error)`` of each text.

    Texts over the budget are split by halves and pooled. A refused batch is
    tried again by groups and then one by one, so only what is refused fails.
    """
    budget = provider.n_ctx - RESERVED
    over = lambda t: len(t.split()) * ESTIMATE > budget and provider.count_tokens(t) > budget

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            parts = T.fitting_parts(text, lambda t: not over(t))
            made = provider.embed(parts)
            return (made[0] if len(made) == 1 else pooled(made)), None
        except Refused as e:
            return None, str(e)

    def group(batch: list[str]) -> list[tuple[list[float] | None, str | None]]:
        if len(batch) == 1 or any(map(over, batch)):
            return [one(t) for t in batch]
        try:
            vectors = provider.embed(batch)
        except Refused:
            cut = max(1, len(batch) // 2)
            return group(batch[:cut]) + group(batch[cut:])
        if len(vectors) != len(batch):
            raise RuntimeError(f"provider returned {len(vectors)} vectors for {len(batch)} texts")
        return [(v, None) for v in vectors]

    return group(texts) if texts else []


def embed(chunks: DataFrame, provider: Callable[[], Provider], text_col: str = "content", batch: int = 32) -> DataFrame:
    """``chunks`` with ``embedding`` and ``error``; one of the two is null.

    A retryable failure fails the task, and Spark runs it again.
    """
    schema = T_.StructType(
        [*chunks.schema, T_.StructField("embedding", T_.ArrayType(T_.FloatType())), T_.StructField("error", T_.StringType())]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = provider()
        for frame in frames:
            texts = frame[text_col].fillna("").tolist()
            made = [x for at in range(0, len(texts), batch) for x in embed_batch(own, texts[at : at + batch])]
            yield frame.assign(embedding=[v for v, _ in made], error=[e for _, e in made])

    return chunks.mapInPandas(run, schema)


def canary_verdict(worst_cosine: float, max_difference: float) -> str:
    """What differs between stored and fresh vectors of the same texts."""
    if max_difference == 0:
        return "identical"
    return "scheduling" if worst_cosine >= SAME_MODEL else "semantic"


def canary(stored: DataFrame, fresh: DataFrame, key: str = "text") -> str:
    pairs = stored.select(key, F.col("vector").alias("a")).join(fresh.select(key, F.col("vector").alias("b")), key)
    row = V.worst_agreement(pairs, "a", "b").first()
    return canary_verdict(row["worst_cosine"], row["max_difference"])
