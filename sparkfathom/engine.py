"""A document index over a warehouse folder: ingest, build, promote, search, check.

All state is Parquet. Stages are set-based: each looks for what is missing or
stale, works on all of it, and writes a new version of its table. A revision is a
collection with three profiles (extractor, chunker, embedder); searches read one
revision of each collection, and promotion swaps which.
"""

from __future__ import annotations

import functools
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.functions import chunking, identity, validation
from sparkfathom.operators import canary, doctor, embedding, knn, lifecycle
from sparkfathom.operators.lexical_index import LexicalIndex
from sparkfathom.operators.search import Corpus, Searcher, check_one_model, searchable_revisions
from sparkfathom.sources import files, sinks
from sparkfathom.sources.config import Config
from sparkfathom.streaming import ingest

#: Columns of the tables under the warehouse.
SCHEMAS = {
    "documents": "id long, collection string, source_path string, file_hash string, size long, modified timestamp, status string",
    "extracted": "id long, document_id long, extractor_profile_id long, source_file_hash string, content_hash string, content string, status string, error_message string, attempts int",
    "chunked": "id long, extracted_document_id long, chunk_profile_id long, source_content_hash string, status string, total_chunks int, error_message string, attempts int",
    "chunks": "chunk_id long, document_id long, chunked_document_id long, chunk_index int, content string",
    "embeddings": "chunk_id long, embedding_profile_id long, status string, error_message string",
    "vectors": "chunk_id long, embedding_profile_id long, embedding array<float>, collection string, extractor_profile_id long, chunk_profile_id long",
    "revisions": "id long, collection string, extractor_profile_id long, chunk_profile_id long, embedding_profile_id long, status string",
    "canaries": canary.CANARIES,
    "profiles": "id long, kind string, fingerprint string, config_json string",
}


#: Columns that tell the revision of a chunk.
ROUTE = ("collection", "extractor_profile_id", "chunk_profile_id")

#: Segments of the text index that are not merged, and revisions that a search names.
MOST_SEGMENTS, MOST_NAMED = 8, 200


@dataclass
class Outcome:
    """What a promotion did, or why it did not."""

    result: str
    revision_id: int | None = None


class Engine:
    """One driver writes; readers see whole versions of tables."""

    def __init__(
        self, spark: SparkSession, root: str, config: Config | None = None, registry: files.Registry | None = None,
        provider: Callable[[], embedding.Provider] = embedding.HashProvider, provider_name: str = "hash",
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.config, self.registry = config or Config(), registry or files.default_registry()
        self.provider, self.provider_name = provider, provider_name

    # -- tables --------------------------------------------------------------------------

    def _table(self, name: str) -> sinks.VersionedTable:
        return sinks.VersionedTable(self.spark, f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        """The table; columns that it was written without are null."""
        table, empty = self._table(name), self.spark.createDataFrame([], SCHEMAS[name])
        if not table.exists():
            return empty
        rows = table.read()
        return rows.select(*[c.name if c.name in rows.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in empty.schema])

    def write(self, name: str, rows: DataFrame, expect: str | None = None) -> None:
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        self._table(name).replace(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]), expect=expect)

    def vacuum(self, keep: int = 2) -> int:
        """Delete superseded versions of all tables."""
        return sum(self._table(name).vacuum(keep) for name in SCHEMAS)

    def _numbered(self, rows: DataFrame, table: str, key: str, by: str) -> DataFrame:
        """``rows`` with fresh numbers above those of the table.

        Numbers come from the rows' partition and place: unique, not gapless.
        """
        last = self.read(table).agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
        return rows.sortWithinPartitions(by).withColumn(key, F.monotonically_increasing_id() + last + 1)

    # -- profiles and revisions ----------------------------------------------------------

    def profile(self, kind: str, payload: dict) -> int:
        """The number of a profile, made if its fingerprint is new."""
        print_ = identity.fingerprint(payload)
        profiles = self.read("profiles")
        known = profiles.where((F.col("kind") == kind) & (F.col("fingerprint") == print_)).select("id").collect()
        if known:
            return known[0]["id"]
        number = (profiles.agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(number, kind, print_, identity.canonical_json(payload))], SCHEMAS["profiles"])
        self.write("profiles", profiles.unionByName(row))
        return number

    def payloads(self) -> dict[str, dict]:
        names = {s: options[0][0] for s, options in self.registry.by_suffix.items()}
        own = self.provider()
        return {
            "extractor": identity.extractor_profile(names, False, "1", sorted(names)),
            "chunk": identity.chunk_profile(self.config.chunk.size, self.config.chunk.overlap, "words"),
            "embedding": identity.embedding_profile(self.provider_name, self.provider_name, "", own.dimension, "cosine", own.n_ctx),
        }

    def target(self, collection: str) -> dict:
        """The revision that a build works on; changed settings start another."""
        ids = {f"{kind}_profile_id": self.profile(kind, p) for kind, p in self.payloads().items()}
        revisions = self.read("revisions")
        number = (revisions.agg(F.max("id")).first()[0] or 0) + 1
        self.write("revisions", lifecycle.targeted(revisions, collection, ids, number))
        same = F.col("collection") == collection
        for name, value in ids.items():
            same = same & (F.col(name) == value)
        return self.read("revisions").where(same).first().asDict()

    # -- ingest --------------------------------------------------------------------------

    def register(self, collection: str, directory: str) -> dict[str, int]:
        """Bring the documents of a collection in line with a directory.

        Unchanged files (by size and time) keep their hash. A moved file keeps its
        row, a changed one keeps it and is built again, a missing one is marked.
        """
        collection = validation.check_collection_name(collection)
        directory = os.path.abspath(directory)
        if not os.path.isdir(directory):
            raise ValueError(f"{directory} is not a directory")
        found = files.scan(self.spark, directory, self.registry.suffixes(), content=True)
        documents = self.read("documents")
        mine = documents.where((F.col("collection") == collection) & (F.col("status") != "deleted"))
        stored = mine.select(F.col("source_path").alias("path"), F.col("size").alias("o_size"), F.col("modified").alias("o_time"), F.col("file_hash").alias("o_hash"))
        kept = identity.reused_hash(F.col("size"), F.col("modified"), F.col("o_size"), F.col("o_time"), F.col("o_hash"))
        unread = identity.content_hash(F.concat_ws(":", F.lit("unread"), "size", F.col("modified").cast("string")))
        hashed = F.coalesce(kept, identity.content_hash(F.col("content")), unread)
        listing = found.join(stored, "path", "left").select("path", "size", "modified", hashed.alias("file_hash"))
        known = mine.select("id", F.col("source_path").alias("path"), "file_hash")
        gone = ingest.missing(known, listing, [directory])
        created = listing.join(known.select("path"), "path", "left_anti")
        moves = ingest.renamed(gone, created)
        rows = documents.join(moves.select("id", F.col("path").alias("moved_to")), "id", "left")
        rows = rows.withColumn("source_path", F.coalesce("moved_to", "source_path")).drop("moved_to")
        lost = gone.join(moves.select("id"), "id", "left_anti")
        rows = ingest.tombstoned(rows, lost).select(documents.columns)
        fresh_hash = listing.select(F.col("path").alias("source_path"), F.col("file_hash").alias("n_hash"), F.col("size").alias("n_size"), F.col("modified").alias("n_time"))
        here = (F.col("collection") == collection) & (F.col("status") != "deleted") & F.col("n_hash").isNotNull()
        rows = rows.join(fresh_hash, "source_path", "left")
        pick = lambda old, new: F.when(here, F.col(new)).otherwise(F.col(old)).alias(old)
        rows = rows.select("id", "collection", "source_path", pick("file_hash", "n_hash"), pick("size", "n_size"), pick("modified", "n_time"), "status")
        new = created.join(moves.select("path"), "path", "left_anti").select(
            F.lit(collection).alias("collection"), F.col("path").alias("source_path"), "file_hash", "size", "modified", F.lit("active").alias("status")
        )
        counts = {"new": new.count(), "moved": moves.count(), "deleted": lost.count()}
        self.write("documents", rows.unionByName(self._numbered(new, "documents", "id", "source_path")))
        if counts["deleted"]:
            dead = self.read("documents").where("status = 'deleted'").select(F.col("id").alias("document_id"))
            self._drop_chunkings(self.read("extracted").join(dead, "document_id", "left_semi").select(F.col("id").alias("extracted_document_id")))
        return counts

    # -- stages --------------------------------------------------------------------------

    def _scoped(self, revision: dict) -> DataFrame:
        return self.read("documents").where(F.col("collection") == revision["collection"])

    def extract(self, revision: dict) -> int:
        """Extract what is missing, stale or unfinished; returns how many."""
        table, profile = self.read("extracted"), revision["extractor_profile_id"]
        own = table.where(F.col("extractor_profile_id") == profile)
        claims = lifecycle.extract_claims(self._scoped(revision), own).select("id", "source_path", "file_hash")
        n = claims.count()
        if not n:
            return 0
        # The claim is on record before the work: a run that dies leaves it in processing.
        known = own.select("document_id", F.col("id").alias("known_id"), "source_file_hash", F.col("attempts").alias("tried"))
        joined = claims.withColumnRenamed("id", "document_id").join(known, "document_id", "left")
        tries = lifecycle.claimed_attempts(F.col("tried"), F.col("source_file_hash").eqNullSafe(F.col("file_hash")))
        numbered = self._numbered(joined.withColumn("attempts", tries), "extracted", "id", "document_id")
        path = f"{self.root}/_stage/claimed-{time.time_ns()}"
        numbered.withColumn("id", F.coalesce("known_id", "id")).select("id", "document_id", "source_path", "file_hash", "attempts").write.parquet(path)
        claims = self.spark.read.parquet(path)
        null = F.lit(None).cast("string")
        claimed = claims.select(
            "id", "document_id", F.lit(profile).alias("extractor_profile_id"), F.col("file_hash").alias("source_file_hash"), null.alias("content_hash"),
            null.alias("content"), F.lit("processing").alias("status"), null.alias("error_message"), "attempts",
        )
        self.write("extracted", table.join(claims.select("id"), "id", "left_anti").unionByName(claimed))
        roots = [r["d"] for r in claims.select(F.regexp_extract("source_path", "^(.*)/[^/]*$", 1).alias("d")).distinct().collect()]
        root = os.path.commonpath(roots) or "/"
        content = files.scan(self.spark, root, self.registry.suffixes()).join(claims.select(F.col("source_path").alias("path")), "path", "left_semi")
        texts = self.registry.extract(content).select("path", "text", "error")
        done = claims.join(texts, F.col("source_path") == F.col("path"), "left").select(
            "id",
            "document_id",
            F.lit(profile).alias("extractor_profile_id"),
            F.col("file_hash").alias("source_file_hash"),
            F.when(F.col("error").isNull(), identity.content_hash(F.col("text"))).alias("content_hash"),
            F.when(F.col("error").isNull(), F.col("text")).alias("content"),
            F.when(F.col("text").isNull() | F.col("error").isNotNull(), "failed").otherwise("done").alias("status"),
            F.coalesce("error", F.when(F.col("text").isNull(), "file is missing")).alias("error_message"),
            F.lit(0).alias("attempts"),
        )
        path = f"{self.root}/_stage/extracted-{time.time_ns()}"
        done.write.parquet(path)
        rows = self.spark.read.parquet(path)
        self._drop_chunkings(rows.select(F.col("id").alias("extracted_document_id")))
        self.write("extracted", table.join(rows.select("id"), "id", "left_anti").unionByName(rows))
        self._clear_stage()
        return n

    def _drop_chunkings(self, extracted: DataFrame) -> None:
        """Chunkings of superseded extractions go, with their chunks and vectors."""
        chunked = self.read("chunked")
        gone = chunked.join(extracted, "extracted_document_id", "left_semi").select("id", F.col("id").alias("chunked_document_id"))
        if not gone.isEmpty():
            self.write("chunks", self.read("chunks").join(gone, "chunked_document_id", "left_anti"))
            self.write("chunked", chunked.join(gone.select("id"), "id", "left_anti"))
            self._purge()

    def chunk(self, revision: dict) -> int:
        """Chunk finished extractions, refused ones fail alone; chunks of superseded ones go."""
        profile = revision["chunk_profile_id"]
        own = self.read("extracted").where(F.col("extractor_profile_id") == revision["extractor_profile_id"])
        chunked, chunks = self.read("chunked"), self.read("chunks")
        mine = chunked.where(F.col("chunk_profile_id") == profile)
        claims = lifecycle.chunk_claims(own, self._scoped(revision), mine)
        n = claims.count()
        if not n:
            return 0
        made = self._numbered(
            claims.select(F.col("id").alias("extracted_document_id"), F.lit(profile).alias("chunk_profile_id"), F.col("content_hash").alias("source_content_hash"), "document_id", "content", chunking.run_error(F.col("content")).alias("error")),
            "chunked", "id", "extracted_document_id",
        )
        path = f"{self.root}/_stage/chunked-{time.time_ns()}"
        made.write.parquet(path)  # pins the new numbers
        made = self.spark.read.parquet(path)
        keys = ["extracted_document_id", "chunk_profile_id"]
        before = mine.select(*keys, F.col("source_content_hash").alias("old_hash"), F.col("attempts").alias("tried"))
        tries = lifecycle.claimed_attempts(F.col("tried"), F.col("old_hash").eqNullSafe(F.col("source_content_hash")))
        claimed = made.join(before, keys, "left").select(
            "id", *keys, "source_content_hash", F.lit("processing").alias("status"), F.lit(0).alias("total_chunks"),
            F.lit(None).cast("string").alias("error_message"), tries.alias("attempts"),
        )
        self.write("chunked", chunked.join(made.select(*keys), keys, "left_anti").unionByName(claimed))
        windows = chunking.chunk_words(made.where("error is null"), ["id", "document_id"], "content", self.config.chunk.size, self.config.chunk.overlap)
        fresh = windows.select("document_id", F.col("id").alias("chunked_document_id"), "chunk_index", "content")
        counts = fresh.groupBy(F.col("chunked_document_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
        rows = made.join(counts, "id", "left").select(
            "id", "extracted_document_id", "chunk_profile_id", "source_content_hash", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"),
            F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.col("error").alias("error_message"), F.lit(0).alias("attempts"),
        )
        replaced = chunked.join(made.select(*keys), keys, "left_semi").select(F.col("id").alias("chunked_document_id"))
        live = chunks.join(replaced, "chunked_document_id", "left_anti")
        self.write("chunks", live.unionByName(self._numbered(fresh, "chunks", "chunk_id", "chunked_document_id")))
        self.write("chunked", chunked.join(made.select(*keys), keys, "left_anti").unionByName(rows))
        self._purge()
        self._clear_stage()
        return n

    def _purge(self) -> None:
        """Embeddings and vectors of chunks that are gone go too."""
        chunks = self.read("chunks").select("chunk_id")
        for name in ("embeddings", "vectors"):
            if self._table(name).exists():
                self.write(name, self.read(name).join(chunks, "chunk_id", "left_semi"))

    def _own_chunks(self, revision: dict) -> DataFrame:
        """Current chunks of live documents of a revision."""
        docs = lifecycle.live(self._scoped(revision)).select(F.col("id").alias("document_id"), "file_hash")
        ext = self.read("extracted").where((F.col("extractor_profile_id") == revision["extractor_profile_id"]) & (F.col("status") == "done"))
        ext = ext.join(docs, "document_id").where("source_file_hash = file_hash").select(F.col("id").alias("extracted_document_id"), "content_hash")
        chk = self.read("chunked").where((F.col("chunk_profile_id") == revision["chunk_profile_id"]) & (F.col("status") == "done"))
        chk = chk.join(ext, "extracted_document_id").where("source_content_hash = content_hash").select(F.col("id").alias("chunked_document_id"))
        return self.read("chunks").join(chk, "chunked_document_id", "left_semi")

    def embed(self, revision: dict) -> int:
        """Embed chunks without a finished embedding row; refused ones fail alone."""
        profile = revision["embedding_profile_id"]
        table = self.read("embeddings")
        settled = table.where((F.col("embedding_profile_id") == profile) & ~F.col("status").isin(*lifecycle.UNFINISHED))
        pending = lifecycle.pending_embeddings(self._own_chunks(revision), settled)
        n = pending.count()
        if not n:
            return 0
        path = f"{self.root}/_stage/embedded-{time.time_ns()}"
        embedding.embed(pending.select("chunk_id", "content"), self.provider).drop("content").write.parquet(path)
        done = self.spark.read.parquet(path)
        status = F.when(F.col("error").isNull(), "done").otherwise("failed")
        rows = done.select("chunk_id", F.lit(profile).alias("embedding_profile_id"), status.alias("status"), F.col("error").alias("error_message"))
        keys = ["chunk_id", "embedding_profile_id"]
        self.write("embeddings", table.join(rows.select(*keys), keys, "left_anti").unionByName(rows))
        routed = done.where("error is null").select(
            "chunk_id", F.lit(profile).alias("embedding_profile_id"), "embedding", F.lit(revision["collection"]).alias("collection"),
            F.lit(revision["extractor_profile_id"]).alias("extractor_profile_id"), F.lit(revision["chunk_profile_id"]).alias("chunk_profile_id"),
        )
        self.write("vectors", self.read("vectors").unionByName(routed))
        self.capture_canary(profile)
        self._clear_stage()
        return n

    def _clear_stage(self) -> None:
        """Delete what stages have pinned; all of it is committed by now."""
        fs, at = self._table("documents")._fs(f"{self.root}/_stage")
        fs.delete(at, True)

    def requeue(self, revision: dict) -> None:
        """Let failed and interrupted work of a revision's live documents wait again."""
        live = lifecycle.live(self._scoped(revision)).select(F.col("id").alias("document_id"))
        ext = self.read("extracted").where(F.col("extractor_profile_id") == revision["extractor_profile_id"]).join(live, "document_id", "left_semi")
        chk = self.read("chunked").where(F.col("chunk_profile_id") == revision["chunk_profile_id"])
        chk = chk.join(ext.select(F.col("id").alias("extracted_document_id")), "extracted_document_id", "left_semi")
        chunks = self.read("chunks").join(chk.select(F.col("id").alias("chunked_document_id")), "chunked_document_id", "left_semi")
        emb = self.read("embeddings").where(F.col("embedding_profile_id") == revision["embedding_profile_id"]).join(chunks, "chunk_id", "left_semi")
        for name, keys, rows in (
            ("embeddings", ["chunk_id", "embedding_profile_id"], emb), ("chunked", ["id"], chk), ("extracted", ["id"], ext),
        ):
            stuck = rows.where(F.col("status").isin("failed", "processing"))
            if not stuck.isEmpty():
                again = lifecycle.requeued(stuck.select(*self.read(name).columns))
                self.write(name, self.read(name).join(stuck.select(*keys), keys, "left_anti").unionByName(again))

    def reindex(self, collection: str) -> dict:
        """Make the chunks and vectors of a collection's working revision anew.

        Extractions stay. The revision is ready again once all is done.
        """
        revision = self.target(collection)
        live = lifecycle.live(self._scoped(revision)).select(F.col("id").alias("document_id"))
        own = self.read("extracted").where(F.col("extractor_profile_id") == revision["extractor_profile_id"]).join(live, "document_id", "left_semi")
        self._drop_chunkings(own.select(F.col("id").alias("extracted_document_id")))
        return self.build(collection)

    def build(self, collection: str, directory: str | None = None) -> dict:
        """Register, extract, chunk and embed until nothing is left; then mark ready.

        What an earlier run left failed or unfinished is tried again, once a build.
        """
        if directory:
            self.register(collection, directory)
        revision = self.target(collection)
        self.requeue(revision)
        while self.extract(revision) + self.chunk(revision) + self.embed(revision):
            pass
        self.index_text()
        counts = self.counts(revision)
        if counts["complete"] and revision["status"] == "building":
            ready = F.when((F.col("id") == revision["id"]) & (F.col("status") == "building"), "ready").otherwise(F.col("status"))
            self.write("revisions", self.read("revisions").withColumn("status", ready))
        self.vacuum()
        return counts

    def capture_canary(self, profile: int) -> bool:
        """Keep what the provider gives for the canary texts; the first capture of a profile stays."""
        known = self.read("canaries")
        if not known.where(F.col("embedding_profile_id") == profile).isEmpty():
            return False
        self.write("canaries", known.unionByName(canary.captured(canary.fresh(self.spark, self.provider), profile)))
        return True

    def _canary_state(self) -> list[dict]:
        """The canary of the current embedding profile, if one was captured."""
        fingerprint = identity.fingerprint(self.payloads()["embedding"])
        ids = self.read("profiles").where((F.col("kind") == "embedding") & (F.col("fingerprint") == fingerprint)).select(F.col("id").alias("embedding_profile_id"))
        stored = canary.decoded(self.read("canaries").join(ids, "embedding_profile_id", "left_semi"))
        if stored.isEmpty():
            return []
        try:
            return [doctor.model_canary(canary.compared(stored, canary.fresh(self.spark, self.provider)))]
        except ValueError as e:
            return [{"check": "model_canary", "ok": False, "detail": str(e)}]

    # -- index of texts ------------------------------------------------------------------

    def text_index(self) -> LexicalIndex:
        return LexicalIndex(self.spark, f"{self.root}/text_index", "english", ROUTE)

    def _routed_chunks(self) -> DataFrame:
        """Chunks with the columns that tell their revision."""
        docs = self.read("documents").select(F.col("id").alias("document_id"), "collection")
        ext = self.read("extracted").select(F.col("id").alias("extracted_document_id"), "extractor_profile_id")
        chk = self.read("chunked").select(F.col("id").alias("chunked_document_id"), "extracted_document_id", "chunk_profile_id")
        return self.read("chunks").join(chk.join(ext, "extracted_document_id"), "chunked_document_id").join(docs, "document_id")

    def index_text(self) -> int:
        """Give new chunks a segment, damaged segments another; how many chunks got one.

        Postings of chunks that are gone stay, unseen, until they are a fifth of all
        or segments are many; then segments are merged without them.
        """
        index, chunks = self.text_index(), self._routed_chunks()
        n = index.add(chunks)
        held = sum(r["chunks"] for r in index.segments())
        if len(index.segments()) > MOST_SEGMENTS or held > 1.25 * self.read("chunks").count():
            index.merge(chunks)
        index.vacuum()
        return n

    # -- counts, promotion, upkeep -------------------------------------------------------

    def counts(self, revision: dict) -> dict:
        docs = lifecycle.live(self._scoped(revision))
        count = lambda df, s: df.where(F.col("status") == s).count()
        current = docs.select(F.col("id").alias("document_id"), "file_hash")
        ext = self.read("extracted").where(F.col("extractor_profile_id") == revision["extractor_profile_id"]).join(current, "document_id").where("source_file_hash = file_hash")
        ids = ext.select(F.col("id").alias("extracted_document_id"), "content_hash")
        chk = self.read("chunked").where(F.col("chunk_profile_id") == revision["chunk_profile_id"]).join(ids, "extracted_document_id").where("source_content_hash = content_hash")
        own = self._own_chunks(revision).select("chunk_id")
        emb = self.read("embeddings").where(F.col("embedding_profile_id") == revision["embedding_profile_id"]).join(own, "chunk_id")
        row = {
            "collection": revision["collection"], "documents": docs.count(), "extracted_done": count(ext, "done"), "extracted_failed": count(ext, "failed"),
            "chunked_done": count(chk, "done"), "chunked_failed": count(chk, "failed"), "chunks": own.count(),
            "embeddings_done": count(emb, "done"), "embeddings_failed": count(emb, "failed"),
        }
        frame = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'collection' else 'long'}" for k in row))
        return lifecycle.completeness(frame).first().asDict()

    def promote(self, collection: str, force: bool = False) -> Outcome:
        """Make the ready revision the active one; its predecessor is retired.

        Should the revisions change while this one is judged, nothing is done and
        the outcome is ``lost_race``.
        """
        seen = self._table("revisions").version()
        own = self.read("revisions").where((F.col("collection") == collection) & (F.col("status") == "ready")).orderBy(F.desc("id")).limit(1).collect()
        if not own:
            return Outcome("no_ready")
        revision = own[0].asDict()
        counts = self.counts(revision)
        result = lifecycle.promotion_outcome("ready", counts["documents"], counts["complete"], counts["failures"], force)
        if result == "promote":
            try:
                self.write("revisions", lifecycle.promoted(self.read("revisions"), revision["id"]), expect=seen)
            except sinks.Changed:
                return Outcome("lost_race", revision["id"])
            self.prune()
        return Outcome(result, revision["id"])

    def prune(self) -> int:
        """Forget removable revisions, and the vectors that only they refer to."""
        plan = lifecycle.prune_plan(self.read("revisions"))
        kept = plan.where(~F.col("removable")).drop("removable")
        removed = plan.where("removable").count()
        if removed:
            keys = ["collection", "extractor_profile_id", "chunk_profile_id", "embedding_profile_id"]
            if self._table("vectors").exists():
                self.write("vectors", self.read("vectors").join(kept.select(*keys), keys, "left_semi"))
            self.write("revisions", kept)
        return removed

    def remove(self, collection: str) -> bool:
        """Forget a collection and all that was made of it."""
        docs = self.read("documents")
        mine = docs.where(F.col("collection") == collection).select(F.col("id").alias("document_id"))
        revisions = self.read("revisions")
        if mine.isEmpty() and revisions.where(F.col("collection") == collection).isEmpty():
            return False
        ext = self.read("extracted")
        gone = ext.join(mine, "document_id", "left_semi").select(F.col("id").alias("extracted_document_id"))
        for name, rows in (
            ("vectors", self.read("vectors").where(F.col("collection") != collection)),
            ("chunks", self.read("chunks").join(mine, "document_id", "left_anti")),
            ("chunked", self.read("chunked").join(gone, "extracted_document_id", "left_anti")),
            ("extracted", ext.join(mine, "document_id", "left_anti")),
            ("documents", docs.where(F.col("collection") != collection)),
            ("revisions", revisions.where(F.col("collection") != collection)),
        ):
            if self._table(name).exists():
                self.write(name, rows)
        self._purge()
        return True

    def collections(self) -> DataFrame:
        """``collection, documents, active, in_flight`` of every collection."""
        docs = lifecycle.live(self.read("documents")).groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
        slots = lifecycle.newest_by_slot(self.read("revisions"))
        active = slots.where("status = 'active'").select("collection", F.col("id").alias("active"))
        building = slots.where("status != 'active'").groupBy("collection").agg(F.max("id").alias("in_flight"))
        names = docs.select("collection").union(self.read("revisions").select("collection")).distinct()
        return names.join(docs, "collection", "left").join(active, "collection", "left").join(building, "collection", "left").fillna(0, ["documents"])

    def status(self) -> list[dict]:
        """Counts and percentages of the revision that each collection works towards."""
        rows = [self.counts(r.asDict()) for r in lifecycle.targets(self.read("revisions")).collect()]
        if not rows:
            return []
        kinds = {"collection": "string", "complete": "boolean"}
        frame = self.spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kinds.get(k, 'long')}" for k in rows[0]))
        return doctor.status_report(frame)

    def health(self, tries: int = 3) -> dict:
        """Whether the provider answers, and with vectors of the dimension it claims."""
        own, error = self.provider(), "no answer"
        for _ in range(tries):
            try:
                dimension = len(own.embed(["dimension probe"])[0])
                return {"ok": dimension == own.dimension, "dimension": dimension, "provider": self.provider_name}
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return {"ok": False, "error": error, "provider": self.provider_name}

    def check(self) -> list[dict]:
        """All integrity checks."""
        stored = {r["kind"]: json.loads(r["config_json"]) for r in self.read("profiles").orderBy("id").collect()}
        found = [
            doctor.stranded(self.read("chunked").where("total_chunks > 0"), self.read("chunks")),
            doctor.vectors_of_chunks(self.read("chunks"), self.read("vectors")),
            self._text_index_state(),
            doctor.chunk_budget(self.config.chunk.size, self.config.n_ctx),
            *self._canary_state(),
        ]
        return found + [doctor.profile_drift(stored[kind], payload, kind) for kind, payload in self.payloads().items() if kind in stored]

    def _text_index_state(self) -> dict:
        index = self.text_index()
        return doctor.text_index(len(index.damaged()), index.unindexed(self.read("chunks")).count())

    # -- search --------------------------------------------------------------------------

    def searcher(self, collections: list[str] | None = None) -> Searcher:
        """A searcher over one revision of each collection."""
        revisions = searchable_revisions(self.read("revisions"))
        if collections is not None:
            revisions = revisions.where(F.col("collection").isin(collections))
        check_one_model(revisions)
        keys = ["collection", "extractor_profile_id", "chunk_profile_id", "embedding_profile_id"]
        vectors = self.read("vectors").join(F.broadcast(revisions.select(*keys)), keys, "left_semi")
        live = lifecycle.live(self.read("documents"))
        chunks = self.read("chunks").select("chunk_id", "document_id", "content").join(live.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        seen = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        index = self.text_index()
        if not index.segments() or index.damaged():
            index = None  # texts are read until a build has repaired it
        else:
            named = revisions.select(*ROUTE).limit(MOST_NAMED + 1).collect()
            if 0 < len(named) <= MOST_NAMED:
                index.only = functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, [F.col(c) == r[c] for c in ROUTE]) for r in named])
        return Searcher(Corpus(live, chunks, seen, analyzer="english", index=index, by=("collection",)), self.config.search.hybrid)

    def search(self, query: str, top_k: int | None = None, collections: list[str] | None = None) -> DataFrame:
        """The ranked documents for a query."""
        k = self.config.search.top_k if top_k is None else top_k
        own = self.provider()
        validation.check_query(query, k, own.count_tokens(query), own.n_ctx)
        return self.searcher(collections).search(query, own.embed([query])[0], k, collections)

    def index(self, method: str | None = None, **options) -> knn.ExactIndex:
        """An index over the vectors, by the configured method; those that are stored have a folder."""
        method = method or self.config.index.method
        if method in ("ivf", "graph"):
            options.setdefault("path", f"{self.root}/vector_index_{method}")
        return knn.build_index(method, self.read("vectors"), **options)
