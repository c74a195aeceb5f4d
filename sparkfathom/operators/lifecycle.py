"""Revisions, claims, progress, upserts and integrity: set-based operators.

Each is a DataFrame to DataFrame function over the tables of the data model. The
driver is the only writer; state changes are new tables or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNFINISHED = ("pending", "processing")
IN_FLIGHT = ("ready", "building")

#: Fixed value: claims interrupted so often are given up.
MAX_ATTEMPTS = 3


# -- scopes and predicates ---------------------------------------------------------------


def live(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status") != "deleted")


def current_extraction(source_hash: Column, extracted_hash: Column) -> Column:
    return source_hash == extracted_hash


def under_directory(path: Column, directory: str) -> Column:
    """Whether a path lies below a directory; a longer name beside it does not."""
    return F.startswith(path, F.lit(directory.rstrip("/") + "/"))


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def in_targets(rows: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Rows of any target: a semi-join, however many targets there are."""
    return rows.join(targets, on, "left_semi")


# -- claims ------------------------------------------------------------------------------


def extract_claims(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Live documents without a finished, current extraction, oldest first by ``id``.

    ``documents(id, status, file_hash)``, ``extracted(document_id, status,
    source_file_hash)`` of one profile.
    """
    e = extracted.select("document_id", F.col("status").alias("e_status"), "source_file_hash")
    stale = differs(F.col("source_file_hash"), F.col("file_hash"))
    wanted = F.col("e_status").isNull() | stale | ~F.col("e_status").isin("done", "failed")
    return live(documents).join(e, F.col("id") == F.col("document_id"), "left").where(wanted).select(documents.columns)


def chunk_claims(extracted: DataFrame, documents: DataFrame, chunked: DataFrame) -> DataFrame:
    """Finished extractions of live documents without a finished, current chunking."""
    d = live(documents).select(F.col("id").alias("document_id"))
    c = chunked.select("extracted_document_id", F.col("status").alias("c_status"), "source_content_hash")
    stale = differs(F.col("source_content_hash"), F.col("content_hash"))
    wanted = F.col("c_status").isNull() | stale | ~F.col("c_status").isin("done", "failed")
    return (
        extracted.where("status = 'done'")
        .join(d, "document_id", "left_semi")
        .join(c, F.col("id") == F.col("extracted_document_id"), "left")
        .where(wanted)
        .select(extracted.columns)
    )


def embed_claims(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks whose embedding row waits."""
    waiting = embeddings.where("status = 'pending'").select("chunk_id")
    return chunks.join(waiting, "chunk_id")


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without any embedding row."""
    return chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def stranded(chunkings: DataFrame, chunks: DataFrame, key: str = "chunked_document_id") -> DataFrame:
    """Finished chunkings that no chunk belongs to."""
    return chunkings.where("status = 'done'").join(chunks.select(key), key, "left_anti")


def claimed_attempts(previous: Column, same_input: Column) -> Column:
    """Claims in a row without an end, this one included; another input starts anew."""
    return F.when(same_input, F.coalesce(previous, F.lit(0)) + 1).otherwise(F.lit(1)).cast("int")


def requeued(rows: DataFrame) -> DataFrame:
    """Failed and interrupted rows wait again; what was interrupted too often is given up.

    Rows without ``attempts`` are never given up. A row that is given up says so in
    ``error_message``, if the table has that column.
    """
    tried = F.coalesce(F.col("attempts"), F.lit(0)) if "attempts" in rows.columns else F.lit(0)
    spent = tried >= MAX_ATTEMPTS
    state = F.col("status")
    status = F.when((state == "processing") & spent, "failed").when(state.isin("failed", "processing") & ~spent, "pending").otherwise(state)
    if "error_message" not in rows.columns:
        return rows.withColumn("status", status)
    said = F.when((state == "processing") & spent, F.concat(F.lit("interrupted "), tried, F.lit(" times in a row"))).otherwise(F.col("error_message"))
    return rows.withColumns({"status": status, "error_message": F.when(status != "pending", said)})


# -- upserts and outcomes ----------------------------------------------------------------


def upserted(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``existing`` with ``new`` written over it; of several new rows the last by ``order`` counts."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    newest = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return existing.join(newest, key, "left_anti").unionByName(newest)


def with_outcomes(rows: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Rows with the status and message of their outcome, if there is one."""
    o = outcomes.select(key, F.col("status").alias("__s"), F.col("error_message").alias("__e"))
    return rows.join(o, key, "left").select(
        *[c for c in rows.columns if c not in ("status", "error_message")],
        F.coalesce("__s", "status").alias("status"),
        F.when(F.col("__s").isNotNull(), F.col("__e")).otherwise(F.col("error_message")).alias("error_message"),
    )


def purged(rows: DataFrame, superseded: DataFrame, key: str) -> DataFrame:
    return rows.join(superseded.select(key), key, "left_anti")


# -- counts and progress -----------------------------------------------------------------


def percent(done: Column, total: Column) -> Column:
    """One decimal; 0 without a total; 100 only when all is done."""
    share = F.round(done / F.nullif(total, F.lit(0)) * 100, 1)
    return F.when(total <= 0, 0.0).when((share >= 100) & (done < total), 99.9).otherwise(share)


def status_counts(rows: DataFrame, by: str, statuses: list[str], status_col: str = "status") -> DataFrame:
    """A row for each value of ``by`` and a column for each status: one pass."""
    counts = [F.count_if(F.col(status_col) == s).alias(f"n_{s}") for s in statuses]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *counts)


def completeness(counts: DataFrame) -> DataFrame:
    """``complete`` and ``failures`` from counts; no documents is never complete."""
    failures = F.col("extracted_failed") + F.col("chunked_failed") + F.col("embeddings_failed")
    done = (
        (F.col("documents") > 0)
        & (F.col("extracted_done") + F.col("extracted_failed") >= F.col("documents"))
        & (F.col("chunked_done") + F.col("chunked_failed") >= F.col("extracted_done"))
        & (F.col("embeddings_done") + F.col("embeddings_failed") >= F.col("chunks"))
    )
    return counts.withColumns({"failures": failures, "complete": done})


def progress_rank(e_status: Column, c_status: Column) -> Column:
    """Failed files first (0), then unfinished (1), then finished (2).

    A missing row is unfinished, and is told before its null status is compared.
    """
    return (
        F.when(e_status == "failed", 0)
        .when(c_status == "failed", 0)
        .when(e_status.isNull(), 1)
        .when(e_status != "done", 1)
        .when(c_status.isNull(), 1)
        .when(c_status != "done", 1)
        .otherwise(2)
    )


def file_progress(documents: DataFrame, extracted: DataFrame, chunked: DataFrame, limit: int | None = None) -> DataFrame:
    """Files with their states, those that want a reader first.

    Only current artifacts count: their hashes equal the content they came from.
    """
    e = extracted.select(
        F.col("document_id").alias("id"), F.col("id").alias("e_id"), F.col("status").alias("e_status"),
        "content_hash", F.col("source_file_hash").alias("file_hash"),
    )
    c = chunked.select(
        F.col("extracted_document_id").alias("e_id"), F.col("status").alias("c_status"),
        F.col("source_content_hash").alias("content_hash"), "total_chunks",
    )
    rows = live(documents).join(e, ["id", "file_hash"], "left").join(c, ["e_id", "content_hash"], "left")
    ranked = rows.select(
        "id", "source_path", "e_status", "c_status", "total_chunks",
        progress_rank(F.col("e_status"), F.col("c_status")).alias("progress"),
    ).orderBy("progress", "source_path")
    return ranked if limit is None else ranked.limit(limit)


# -- revisions ---------------------------------------------------------------------------


def newest_by_slot(revisions: DataFrame) -> DataFrame:
    """The newest active, ready and building revision of each collection."""
    w = Window.partitionBy("collection", "status").orderBy(F.desc("id"))
    slots = revisions.where(F.col("status").isin("active", *IN_FLIGHT))
    return slots.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prune_plan(revisions: DataFrame) -> DataFrame:
    """``removable`` for each revision: superseded ones, and retired ones but the newest."""
    newest = F.row_number().over(Window.partitionBy("collection", "status").orderBy(F.desc("id")))
    old = (F.col("status") == "retired") & (F.col("__n") > 1)
    return (
        revisions.withColumn("__n", newest)
        .withColumn("removable", (F.col("status") == "superseded") | old)
        .drop("__n")
    )


def droppable_profiles(planned: DataFrame, profile: str = "embedding_profile_id") -> DataFrame:
    """Profiles that only removable revisions refer to, with ``kept_references`` 0."""
    kept = planned.groupBy(profile).agg(F.count_if(~F.col("removable")).alias("kept_references"))
    return kept.where("kept_references = 0")


def targets(revisions: DataFrame) -> DataFrame:
    """The revision whose progress a collection shows: one in flight, else the active one."""
    order = F.when(F.col("status").isin(*IN_FLIGHT), 0).when(F.col("status") == "active", 1)
    w = Window.partitionBy("collection").orderBy("__o", F.desc("id"))
    return (
        revisions.withColumn("__o", order)
        .where("__o is not null")
        .withColumn("__n", F.row_number().over(w))
        .where("__n = 1")
        .drop("__n", "__o")
    )


def promotion_outcome(status: str | None, documents: int, complete: bool, failures: int, force: bool = False) -> str:
    """Why a revision cannot be promoted, or ``promote``. Force never covers an empty one."""
    if status != "ready":
        return "no_ready"
    if documents == 0:
        return "empty"
    if not force and not complete:
        return "incomplete"
    if not force and failures:
        return "blocked_by_failures"
    return "promote"


def promoted(revisions: DataFrame, revision_id: int) -> DataFrame:
    """The revision table after promotion: ready becomes active, the old active retired."""
    chosen = revisions.where(F.col("id") == revision_id).select("collection")
    mine = F.col("__mine").isNotNull()
    status = (
        F.when(F.col("id") == revision_id, "active")
        .when(mine & (F.col("status") == "active"), "retired")
        .otherwise(F.col("status"))
    )
    marked = revisions.join(F.broadcast(chosen.withColumn("__mine", F.lit(True))), "collection", "left")
    return marked.withColumn("status", status).select(revisions.columns)


def targeted(revisions: DataFrame, collection: str, profiles: dict[str, int], next_id: int) -> DataFrame:
    """The revision table with a building revision for these profiles.

    An active or in-flight one is reused, a retired or superseded one takes up
    building again; other revisions in flight of the collection are superseded.
    """
    same = F.lit(True)
    for name, value in profiles.items():
        same = same & (F.col(name) == value)
    own = F.col("collection") == collection
    exists = not revisions.where(own & same).isEmpty()
    status = (
        F.when(own & same & F.col("status").isin("retired", "superseded"), "building")
        .when(own & ~same & F.col("status").isin(*IN_FLIGHT), "superseded")
        .otherwise(F.col("status"))
    )
    out = revisions.withColumn("status", status)
    if exists:
        return out
    row = {"id": next_id, "collection": collection, "status": "building", **profiles}
    fresh = revisions.sparkSession.createDataFrame([tuple(row.get(c) for c in revisions.columns)], revisions.schema)
    return out.unionByName(fresh)


# -- choice of rows ----------------------------------------------------------------------


def chosen_row(paths: DataFrame, *candidates: tuple[DataFrame, list[str]]) -> DataFrame:
    """``paths`` with ``row_id`` from the first candidate table that has one, else null.

    Each candidate is ``(table with its keys and row_id, keys)``, in priority.
    """
    out, names = paths, []
    for i, (table, keys) in enumerate(candidates):
        names.append(f"__row{i}")
        least = table.groupBy(*keys).agg(F.min("row_id").alias(names[-1]))
        out = out.join(least, keys, "left")
    return out.withColumn("row_id", F.coalesce(*names)).drop(*names)


def moved(documents: DataFrame) -> DataFrame:
    """Pairs of rows of one collection and content whose path changed.

    Each row is paired with the next of its content by ``id``, so that a content
    in many places gives as many pairs as rows and not their square.
    """
    same = Window.partitionBy("collection", "file_hash").orderBy("id")
    following = documents.where("file_hash is not null").withColumns(
        {"new_id": F.lead("id").over(same), "new_path": F.lead("source_path").over(same)}
    )
    return following.where("source_path != new_path").select(
        "collection", "file_hash", F.col("id").alias("old_id"), F.col("source_path").alias("old_path"), "new_id", "new_path"
    )
