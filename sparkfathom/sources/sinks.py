"""Sinks: keyed upserts, partition replacement, JSON output, derived tables.

Parquet has no transactions. A new version of a table is written beside the old
one; then an empty file whose name holds a number and the version is created. The
largest number counts, and files are only added until ``vacuum``, so readers see
the old version or the new one whole. One driver writes a table at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.operators import lifecycle


class Changed(Exception):
    """Another version came between reading and replacing."""


class VersionedTable:
    """A Parquet table under ``root`` whose last manifest names the current version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _manifests(self) -> list[str]:
        """``number-version`` of every version, oldest first."""
        fs, at = self._fs(f"{self.root}/_manifest")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def exists(self) -> bool:
        return bool(self._manifests())

    def version(self) -> str | None:
        """The version that counts; null before the first."""
        known = self._manifests()
        return known[-1].split("-", 1)[1] if known else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version()}")

    def is_empty(self) -> bool:
        return not self.exists() or self.read().isEmpty()

    def replace(self, rows: DataFrame, partition_by: list[str] | None = None, expect: str | None = None) -> None:
        """Make ``rows`` the table; with ``expect``, only if that version still counts."""
        version = f"v-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.root}/{version}")
        known = self._manifests()
        if expect is not None and (not known or known[-1].split("-", 1)[1] != expect):
            raise Changed(f"{self.root} has a newer version")
        number = int(known[-1].split("-", 1)[0]) + 1 if known else 1
        fs, at = self._fs(f"{self.root}/_manifest/{number:012d}-{version}")
        fs.create(at, False).close()

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions; how many went."""
        old = self._manifests()[: -max(keep, 1)]
        for name in old:
            for path in (f"{self.root}/_manifest/{name}", f"{self.root}/{name.split('-', 1)[1]}"):
                fs, at = self._fs(path)
                fs.delete(at, True)
        return len(old)

    def append(self, rows: DataFrame) -> int:
        """Add rows that the table does not hold; how many."""
        n = rows.count()
        self.replace(self.read().unionByName(rows) if self.exists() else rows)
        return n

    def upsert(self, rows: DataFrame, key: str, order: str, required: tuple[str, ...] = ()) -> None:
        """Write rows over those of the same key, the last of several by ``order``."""
        if required and not rows.where(" OR ".join(f"{c} IS NULL" for c in required)).isEmpty():
            raise ValueError(f"columns {', '.join(required)} must not be null")
        self.replace(lifecycle.upserted(self.read(), rows, key, order) if self.exists() else rows)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``rows`` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def json_lines(rows: DataFrame) -> Iterator[str]:
    """Rows as JSON, one at a time, without gathering them."""
    made = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"))
    for row in made.toLocalIterator():
        yield row["j"]


def json_document(rows: DataFrame, **more) -> str:
    """A small report as one JSON document."""
    return json.dumps({"rows": [json.loads(x) for x in json_lines(rows)], **more}, sort_keys=True)


def not_null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many nulls each column that must have none holds."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
