"""Identity: content hashes, canonical JSON, fingerprints, labels and drift."""

from __future__ import annotations

import hashlib
import json
import zlib
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes or of binary content."""
    return F.sha2(content, 256)


def lock_key(name: str) -> int:
    return zlib.crc32(name.encode())


def canonical_json(payload: Any) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))


def fingerprint(payload: Any) -> str:
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()


def revision_label(*fingerprints: Column) -> Column:
    """The first eight characters of each fingerprint, joined by hyphens."""
    return F.concat_ws("-", *[F.substring(f, 1, 8) for f in fingerprints])


def drift(stored: dict, current: dict, prefix: str = "") -> list[tuple[str, Any, Any]]:
    """``(key, stored, current)`` of everything that differs, nested keys dotted."""
    found = []
    for key in sorted({*stored, *current}):
        a, b = stored.get(key), current.get(key)
        if isinstance(a, dict) and isinstance(b, dict):
            found += drift(a, b, f"{prefix}{key}.")
        elif a != b:
            found.append((f"{prefix}{key}", a, b))
    return found


def extractor_profile(backends: dict, use_ocr: bool, version: str, registry: list[str], **extra: Any) -> dict:
    return {"backends": backends, "use_ocr": use_ocr, "version": version, "registry": sorted(registry), **extra}


def chunk_profile(chunk_size: int, chunk_overlap: int, tokenizer: str, version: str = "v3") -> dict:
    return {"chunk_size": chunk_size, "chunk_overlap": chunk_overlap, "tokenizer": tokenizer, "version": version}


def embedding_profile(provider: str, model: str, digest: str, dim: int, metric: str, n_ctx: int, **extra: Any) -> dict:
    """A model is known by its name and content digest, never by its path."""
    return {
        "provider": provider, "model": model.rsplit("/", 1)[-1], "model_digest": digest, "embedding_dim": dim,
        "distance_metric": metric, "n_ctx": n_ctx, **extra,
    }


def reused_hash(size: Column, mtime: Column, old_size: Column, old_mtime: Column, old_hash: Column) -> Column:
    """The stored hash of a file whose size and time have not changed, else null."""
    return F.when(size.eqNullSafe(old_size) & mtime.eqNullSafe(old_mtime), old_hash)


def version_parts(version: Column) -> Column:
    return F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
