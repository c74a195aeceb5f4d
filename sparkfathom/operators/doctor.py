"""Integrity checks: stranded chunkings, missing vectors, drift of profiles and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfathom.functions import identity
from sparkfathom.operators import lifecycle


def stranded(chunked: DataFrame, chunks: DataFrame) -> dict:
    """Finished chunkings without chunks: their documents cannot be found."""
    found = lifecycle.stranded(chunked.withColumnRenamed("id", "chunked_document_id"), chunks)
    n = found.count()
    return {"check": "stranded_chunkings", "ok": n == 0, "detail": f"{n} finished chunkings without chunks"}


def vectors_of_chunks(chunks: DataFrame, vectors: DataFrame) -> dict:
    """Vectors whose chunk is gone, which searches would still return."""
    n = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()
    return {"check": "orphan_vectors", "ok": n == 0, "detail": f"{n} vectors without a chunk"}


def profile_drift(stored: dict, current: dict, name: str) -> dict:
    """Settings that differ from those an index was built with."""
    changes = identity.drift(stored, current)
    listed = "; ".join(f"{k}: {a!r} -> {b!r}" for k, a, b in changes)
    return {"check": f"{name}_drift", "ok": not changes, "detail": listed or "unchanged"}


def chunk_budget(size: int, n_ctx: int) -> dict:
    return {"check": "chunk_budget", "ok": size + 8 <= n_ctx, "detail": f"chunks of {size} tokens for a window of {n_ctx}"}


def text_index(damaged: int, unindexed: int) -> dict:
    """Segments that cannot be read, and chunks that no segment covers."""
    detail = f"{damaged} damaged segments, {unindexed} chunks without postings"
    return {"check": "text_index", "ok": not damaged and not unindexed, "detail": detail}


def model_canary(verdict: str) -> dict:
    return {"check": "model_canary", "ok": verdict != "semantic", "detail": verdict}


def status_report(counts: DataFrame) -> list[dict]:
    """Counts of each collection with percentages, as plain rows."""
    p = lifecycle.percent
    rows = counts.withColumns(
        {
            "extracted_percent": p(F.col("extracted_done"), F.col("documents")),
            "chunked_percent": p(F.col("chunked_done"), F.col("extracted_done")),
            "embedded_percent": p(F.col("embeddings_done"), F.col("chunks")),
        }
    )
    return [r.asDict() for r in rows.orderBy("collection").collect()]
