"""Incremental ingest: event streams, snapshot differences and staged pipelines.

The file source of Structured Streaming sees new files only. Changes, moves and
deletions come from comparing a listing with the table of known documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

#: How long events of a path settle, and skipped files that are kept.
SETTLE, KEPT_SKIPS = "2 seconds", 50


def debounced(events: DataFrame, path: str = "path", ts: str = "ts") -> DataFrame:
    """The last event of each path: a fold, so a busy path costs one row a task.

    Of events at one time the greatest by its other columns counts.
    """
    others = [c for c in events.columns if c not in (path, ts)]
    last = F.max_by(F.struct(*others), F.struct(ts, *others)).alias("last")
    return events.groupBy(path).agg(F.max(ts).alias(ts), last).select(path, ts, "last.*")


def snapshot_diff(listing: DataFrame, known: DataFrame, key: str = "path", content: str = "file_hash") -> DataFrame:
    """``key, change`` of what differs: ``created``, ``modified`` or ``deleted``."""
    a = listing.select(key, F.col(content).alias("__new"), F.lit(True).alias("__here"))
    b = known.select(key, F.col(content).alias("__old"), F.lit(True).alias("__known"))
    change = (
        F.when(F.col("__known").isNull(), "created")
        .when(F.col("__here").isNull(), "deleted")
        .when(~F.col("__new").eqNullSafe(F.col("__old")), "modified")
    )
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def missing(known: DataFrame, listing: DataFrame, roots: list[str], key: str = "path") -> DataFrame:
    """Known documents under the watched roots that the listing lacks."""
    under = F.lit(False)
    for root in roots:
        under = under | F.startswith(F.col(key), F.lit(root.rstrip("/") + "/"))
    return known.where(under).join(listing.select(key), key, "left_anti")


def tombstoned(documents: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Documents with those gone marked deleted and their hash cleared."""
    marked = documents.join(gone.select(key, F.lit(True).alias("__gone")), key, "left")
    is_gone = F.col("__gone").isNotNull()
    return marked.select(
        *[c for c in documents.columns if c not in ("status", "file_hash")],
        F.when(is_gone, "deleted").otherwise(F.col("status")).alias("status"),
        F.when(~is_gone, F.col("file_hash")).alias("file_hash"),
    )


def renamed(gone: DataFrame, created: DataFrame) -> DataFrame:
    """``id, path``: rows that keep their work under a new path.

    A created file takes the row of a missing one of the same content and name: the
    first path the oldest row, the next path the next one.
    """
    name = lambda c: F.substring_index(F.col(c), "/", -1)
    place = lambda by: F.row_number().over(Window.partitionBy("file_hash", "__name").orderBy(by))
    old = gone.select("id", "file_hash", name("path").alias("__name")).withColumn("__place", place("id"))
    new = created.select("path", "file_hash", name("path").alias("__name")).withColumn("__place", place("path"))
    return old.join(new, ["file_hash", "__name", "__place"]).select("id", "path")


def skip_ledger(skips: DataFrame, order: str = "ts", kept: int = KEPT_SKIPS) -> tuple[DataFrame, DataFrame]:
    """The exact number of skipped files, and the last of them with their reasons."""
    return skips.agg(F.count(F.lit(1)).alias("skipped")), skips.orderBy(F.desc(order), "path").limit(kept)


def is_fresh(last: Column, now: Column, seconds: int) -> Column:
    """Whether a lease taken at ``last`` still holds."""
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) <= seconds * 1_000_000


def stage(
    stream: DataFrame, claim: Callable[[DataFrame], DataFrame], work: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None,
) -> DataStreamWriter:
    """A pipeline stage over micro-batches: claim, work, write.

    Nothing is written until the work of a batch is done, so a batch that fails
    is claimed again as it was.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        claimed = claim(batch).persist()
        try:
            if not claimed.isEmpty():
                write(work(claimed))
        finally:
            claimed.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": SETTLE}))
    )
