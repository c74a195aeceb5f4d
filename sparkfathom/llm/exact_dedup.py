"""Exact deduplication over a log-structured merge index of digests.

``LsmIndex`` keeps ``(digest, n, keep_id)`` entries in levels of sorted runs:

* a memtable is one scan task's rows; flushing sorts them by digest and writes
  one run per task, without a shuffle, and with a Bloom filter on the digest in
  the Parquet footer (level 0);
* compaction merges all runs of a level by digest, keeping the smallest (or
  largest) identifier, and writes the next level, sorted and filtered again;
* compaction also writes a filter of the digests that occur more than once. Looking
  up a row probes that filter first: a row it rules out is alone and needs no join.
  The others meet their entry in a join by digest. A hit is only a proposal until
  its bytes are compared with those of the document that stays.

Everything runs in DataFrame functions. Partial aggregation folds a hot digest
before the shuffle; where rows must meet their entry, hot digests (at most
``shared.HOT_SHARE`` of them) are salted. Digests and texts move only for documents
that pass the bounded filter of repeated digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.llm import shared

class LsmIndex:
    """A digest index in the shared folder.

    ``keep`` is ``"min"`` or ``"max"``: which identifier of equal digests the
    compaction keeps.
    """

    def __init__(self, spark: SparkSession, keep: str = "min") -> None:
        if keep not in ("min", "max"):
            raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
        self.spark, self.keep = spark, keep
        self.runs: list[DataFrame] = []
        self.level: DataFrame | None = None
        self.repeated: DataFrame | None = None

    def flush(self, rows: DataFrame) -> DataFrame:
        """Write ``rows(digest, ident)`` as sorted level-0 runs and return them."""
        run = shared.materialise(
            rows.select("digest", "ident").sortWithinPartitions("digest"),
            "lsm-l0",
            **{"parquet.bloom.filter.enabled#digest": "true"},
        )
        self.runs.append(run)
        return run

    def compact(self) -> DataFrame:
        """Merge all runs and the level below them into one level of entries."""
        pick = F.min if self.keep == "min" else F.max
        entries = None
        for run in self.runs:
            part = run.select("digest", F.lit(1).cast("long").alias("n"), F.col("ident").alias("keep_id"))
            entries = part if entries is None else entries.unionByName(part)
        if self.level is not None:
            entries = self.level if entries is None else entries.unionByName(self.level)
        if entries is None:
            raise ValueError("nothing has been flushed")
        merged = entries.groupBy("digest").agg(F.sum("n").alias("n"), pick("keep_id").alias("keep_id"))
        self.level = shared.materialise(
            merged.sortWithinPartitions("digest"),
            "lsm-l1",
            **{"parquet.bloom.filter.enabled#digest": "true"},
        )
        self.repeated = shared.materialise(shared.bitmap(self.level.where("n > 1"), "digest"), "lsm-filter")
        self.runs = []
        return self.level

    def hits(self, rows: DataFrame) -> DataFrame:
        """Rows whose digest may be repeated in the level; all others are alone in it."""
        return shared.flagged(rows, self.repeated, "digest", "__hit").where("__hit").drop("__hit")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Flushed ``rows(digest, ident)`` with ``n`` and ``keep_id`` of their entry.

        Rows and entries that the filter rules out take no part in the join; hot
        digests are salted.
        """
        probed = shared.flagged(rows, self.repeated, "digest", "__hit")
        alone = probed.where("not __hit").select("digest", "ident", F.lit(1).cast("long").alias("n"), F.col("ident").alias("keep_id"))
        met = shared.salted_lookup(self.hits(rows), self.hits(self.level), "digest", "n", "ident")
        return met.select("digest", "ident", "n", "keep_id").unionByName(alone)


def digest_of(text: Column, bits: int = 256) -> Column:
    """SHA-256 of the text's UTF-8 bytes, cut to ``bits`` (for tests)."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", bits: int = 256
) -> DataFrame:
    """One row per input row: ``ident, digest, keep_id, group_size``.

    Texts are equal when identical after lower-casing A to Z; null counts as
    empty. Of equal texts the smallest (``keep="min"``) or largest identifier
    stays. Null identifiers are never kept while their group holds another one;
    a group of null identifiers alone has a null ``keep_id``. Repeated rows each
    count and each return a row. An empty table gives an empty result. Only the
    two named columns are read, so other columns may have any name.

    Every member of a group is compared byte by byte with the text that stays.
    Should digests collide, the rows of those digests are grouped by their
    texts instead.
    """
    spark = docs.sparkSession
    base = docs.select(
        docs[id_col].cast("long").alias("ident"),
        shared.lower_ascii(F.coalesce(docs[text_col], F.lit(""))).alias("body"),
    ).withColumn("digest", digest_of(F.col("body"), bits))
    index = LsmIndex(spark, keep)
    rows = index.flush(base)
    index.compact()

    collided = unequal(index.hits(base))
    looked_up = index.lookup(rows)
    if not collided.count():
        return looked_up.select("ident", "digest", "keep_id", F.col("n").alias("group_size"))
    pick = F.min if keep == "min" else F.max
    apart = base.join(collided, "digest", "left_semi")
    groups = apart.groupBy("digest", "body").agg(
        F.count(F.lit(1)).alias("group_size"), pick("ident").alias("keep_id")
    )
    split = apart.join(groups, ["digest", "body"]).select("ident", "digest", "keep_id", "group_size")
    return (
        looked_up.join(collided, "digest", "left_anti")
        .select("ident", "digest", "keep_id", F.col("n").alias("group_size"))
        .unionByName(split)
    )


def unequal(hits: DataFrame) -> DataFrame:
    """Digests of ``hits(digest, body)`` whose members differ in bytes.

    All members are equal if the least and the greatest of their texts are. Each
    task folds its own members first, so a hot digest ships two texts a task.
    """
    return (
        hits.groupBy("digest")
        .agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
        .where("least != greatest")
        .select("digest")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` without the rows whose text another row keeps.

    Columns and their order stay. A row with a null identifier stays only if no
    row of its group has one; rows that repeat the kept identifier all stay.
    """
    body = shared.lower_ascii(F.coalesce(docs[text_col], F.lit("")))
    gone = shared.materialise(
        exact_groups(docs, id_col, text_col, keep)
        .where(~F.col("ident").eqNullSafe(F.col("keep_id")))
        .select("ident", "digest")
        .distinct(),
        "exact-gone",
    )
    return shared.without(docs, gone, {"ident": docs[id_col].cast("long"), "digest": digest_of(body)})
