"""Configuration from a TOML file and the environment: environment, file, default."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field

PREFIX = "SPARKFATHOM_"


@dataclass
class ChunkConfig:
    size: int = 320
    overlap: int = 80


@dataclass
class SearchConfig:
    hybrid: bool = True
    top_k: int = 10
    lexical_lead_max_documents: int = 20
    lexical_candidate_pool: int = 2000


@dataclass
class IndexConfig:
    method: str = "exact"
    cells: int = 16
    probes: int = 4


@dataclass
class Config:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    n_ctx: int = 512

    def checked(self) -> Config:
        if not 0 <= self.chunk.overlap < self.chunk.size:
            raise ValueError("chunk.overlap must be smaller than chunk.size")
        if self.chunk.size + 8 > self.n_ctx:
            raise ValueError("chunk.size + 8 must not exceed n_ctx")
        return self


def _typed(text: str, like):
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    return type(like)(text)


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Config:
    """The configuration; unknown keys of the file are errors."""
    environ = os.environ if environ is None else environ
    given = {}
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f)
    config = Config()
    for name, value in given.items():
        if not hasattr(config, name):
            raise ValueError(f"unknown setting {name!r}")
        part = getattr(config, name)
        if not dataclasses.is_dataclass(part):
            setattr(config, name, value)
            continue
        for key, x in value.items():
            if not hasattr(part, key):
                raise ValueError(f"unknown setting {name}.{key}")
            setattr(part, key, x)
    for f in dataclasses.fields(config):
        part = getattr(config, f.name)
        if not dataclasses.is_dataclass(part):
            if (v := environ.get(PREFIX + f.name.upper())) is not None:
                setattr(config, f.name, _typed(v, part))
            continue
        for g in dataclasses.fields(part):
            if (v := environ.get(f"{PREFIX}{f.name}_{g.name}".upper())) is not None:
                setattr(part, g.name, _typed(v, getattr(part, g.name)))
    return config.checked()
