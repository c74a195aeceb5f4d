"""File sources: directory scans, extractors, and line-oriented inputs."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text suffixes, directories that are passed over, the largest file,
#: and how long a command may take.
TEXT_SUFFIXES = (".txt", ".md", ".markdown")
IGNORED_DIRECTORIES = (
    ".git .hg .svn .venv venv node_modules __pycache__ .cache .tox .mypy_cache .pytest_cache .ruff_cache .idea .vscode"
).split()
MAX_FILE_BYTES = 512 * 1024 * 1024
COMMAND_TIMEOUT_S = 900

Extractor = Callable[[str, bytes], str]


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def supported(path: Column, suffixes: tuple[str, ...]) -> Column:
    return suffix_of(path).isin(*[s.lower() for s in suffixes])


def in_ignored_directory(path: Column, root: str) -> Column:
    """Whether a directory below the root, not the root itself, is to be passed over."""
    below = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    parts = F.split(below, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*IGNORED_DIRECTORIES))


def symbolic_links(root: str) -> list[str]:
    """Links below a local directory; none for other stores."""
    return [
        os.path.join(where, name)
        for where, folders, names in os.walk(root)
        for name in (*folders, *names)
        if os.path.islink(os.path.join(where, name))
    ]


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, content: bool = True) -> DataFrame:
    """``path, size, modified, suffix, content`` of the admitted files below ``root``.

    Content is read only where a later step uses it, and is null for files over
    ``MAX_FILE_BYTES``, which an extraction refuses. Symbolic links below a local
    root are refused.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^file:/*", "/")
    size = F.col("length")
    columns = [plain.alias("path"), size.alias("size"), F.col("modificationTime").alias("modified"), suffix_of(F.col("path")).alias("suffix")]
    if content:  # two reads, as a file too large to read fails the read of its content
        small = files.where(size <= MAX_FILE_BYTES).select(*columns, "content")
        kept = small.unionByName(files.where(size > MAX_FILE_BYTES).select(*columns, F.lit(None).cast("binary").alias("content")))
    else:
        kept = files.select(*columns)
    kept = kept.where(supported(F.col("path"), suffixes) & ~in_ignored_directory(F.col("path"), root))
    if links := symbolic_links(root):
        kept = kept.join(spark.createDataFrame([(x,) for x in links], "path string"), "path", "left_anti")
    return kept


def plain_text(content: Column) -> Column:
    """UTF-8 with replacement of what is not, NUL characters taken out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\0"), F.lit(""))


def command_extractor(argv: list[str], timeout: int = COMMAND_TIMEOUT_S) -> Extractor:
    """An extractor that runs a command; ``{path}`` stands for the file, output is the text."""

    def extract(path: str, _: bytes) -> str:
        done = subprocess.run([path if a == "{path}" else a for a in argv], capture_output=True, timeout=timeout)
        if done.returncode:
            raise RuntimeError(f"exit {done.returncode}: {done.stderr.decode(errors='replace')[:500]}")
        return done.stdout.decode(errors="replace")

    return extract


def pdf_extractor(layout: bool = False) -> Extractor:
    """A PDF extractor on an optional library; a clear error where it is missing."""

    def extract(_: str, content: bytes) -> str:
        try:
            import pymupdf
        except ImportError as missing:
            raise RuntimeError("PDF extraction needs the optional pymupdf package") from missing
        with pymupdf.open(stream=content, filetype="pdf") as pages:
            if layout:  # a block is a tuple whose fifth member is its text
                return "\n\n".join(block[4].strip() for page in pages for block in page.get_text("blocks"))
            return "\n".join(page.get_text() for page in pages)

    return extract


class Registry:
    """Extractors by suffix; the first one registered for a suffix serves it."""

    def __init__(self) -> None:
        self.by_suffix: dict[str, list[tuple[str, Extractor | None]]] = {}

    def register(self, name: str, suffixes: tuple[str, ...], extractor: Extractor | None) -> None:
        """``None`` stands for plain text, which is read without Python."""
        for s in suffixes:
            self.by_suffix.setdefault(s.lower(), []).append((name, extractor))

    def resolve(self, suffix: str, chosen: str | None = None) -> tuple[str, Extractor | None]:
        options = self.by_suffix.get(suffix.lower())
        if not options:
            raise ValueError(f"no extractor for {suffix!r}")
        if chosen is None:
            return options[0]
        for option in options:
            if option[0] == chosen:
                return option
        raise ValueError(f"extractor {chosen!r} does not serve {suffix!r}")

    def suffixes(self) -> tuple[str, ...]:
        return tuple(self.by_suffix)

    def extract(self, files: DataFrame, chosen: dict[str, str] | None = None) -> DataFrame:
        """``files`` without content, with ``text`` and ``error``.

        Plain text stays in the JVM. Others run in Python workers, apart from the
        JVM and from each other; what one file raises is its error alone. Empty
        text is an error, and so is null content.
        """
        refused = files.where("content IS NULL").withColumns(
            {"text": F.lit(None).cast("string"), "error": F.lit(f"file is over {MAX_FILE_BYTES} bytes")}
        )
        files = files.where("content IS NOT NULL")
        picks = {s: self.resolve(s, (chosen or {}).get(s)) for s in self.by_suffix}
        plain = [s for s, (_, f) in picks.items() if f is None]
        others = {s: f for s, (_, f) in picks.items() if f is not None}
        done = files.where(F.col("suffix").isin(*plain)).withColumns(
            {"text": plain_text(F.col("content")), "error": F.lit(None).cast("string")}
        )
        if others:
            fresh = [T.StructField(n, T.StringType()) for n in ("text", "error")]
            schema = T.StructType([*files.schema, *fresh])

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    texts, errors = [], []
                    for path, suffix, content in zip(frame["path"], frame["suffix"], frame["content"], strict=True):
                        try:
                            texts.append(others[suffix](path, content))
                            errors.append(None)
                        except Exception as e:
                            texts.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                    yield frame.assign(text=texts, error=errors)

            rest = files.where(F.col("suffix").isin(*others)).mapInPandas(run, schema)
            done = done.unionByName(rest)
        done = done.unionByName(refused)
        blank = F.col("error").isNull() & (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == "")
        return done.drop("content").withColumn("error", F.when(blank, F.lit("extraction is empty")).otherwise(F.col("error")))


def default_registry() -> Registry:
    registry = Registry()
    registry.register("plaintext", TEXT_SUFFIXES, None)
    registry.register("pdf-text", (".pdf",), pdf_extractor())
    registry.register("pdf-layout", (".pdf",), pdf_extractor(layout=True))
    return registry


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: whole files as texts."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_chunks_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``chunk_index, content`` of a JSON lines file; strict fails at a bad line.

    A chunk without content is refused when strict and marked otherwise.
    """
    schema = "chunk_index int, content string, _corrupt string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("content").isNull() | (F.trim("content") == "")
    if strict:
        content = F.when(~bad, F.col("content")).otherwise(F.raise_error(F.lit("invalid chunk line")).cast("string"))
        return rows.select("chunk_index", content.alias("content"))
    return rows.select("chunk_index", "content", bad.alias("invalid"))
