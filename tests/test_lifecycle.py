import pytest
from pyspark.sql import functions as F

from sparkfathom.operators import lifecycle as L


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_claims_see_missing_stale_and_unfinished(spark):
    docs = spark.createDataFrame(
        [(1, "active", "h1"), (2, "active", "h2"), (3, "active", "h3"), (4, "active", "h4"), (5, "deleted", "h5"), (6, "active", None)],
        "id long, status string, file_hash string",
    )
    ext = spark.createDataFrame(
        [(20, 2, "done", "h2", "c2"), (30, 3, "done", "old", "c3"), (40, 4, "processing", "h4", "c4"), (60, 6, "done", None, "c6")],
        "id long, document_id long, status string, source_file_hash string, content_hash string",
    )
    assert ids(L.extract_claims(docs, ext)) == [1, 3, 4]
    chunked = spark.createDataFrame([(20, "done", "c2"), (30, "done", "older")], "extracted_document_id long, status string, source_content_hash string")
    assert ids(L.chunk_claims(ext, docs, chunked)) == [30, 60]


def test_embeddings_pending_and_stranded(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "chunk_id long, chunked_document_id long")
    emb = spark.createDataFrame([(1, "done"), (2, "pending")], "chunk_id long, status string")
    assert ids(L.pending_embeddings(chunks, emb), "chunk_id") == [3]
    assert ids(L.embed_claims(chunks, emb), "chunk_id") == [2]
    chunkings = spark.createDataFrame([(10, "done"), (12, "done"), (13, "pending")], "chunked_document_id long, status string")
    assert ids(L.stranded(chunkings, chunks), "chunked_document_id") == [12]


def test_requeue_gives_up_after_three_attempts(spark):
    rows = spark.createDataFrame(
        [(1, "processing", 2), (2, "processing", 3), (3, "done", 9), (4, "failed", 0), (5, "failed", 3), (6, "pending", None)], "id long, status string, attempts int"
    )
    want = {1: "pending", 2: "failed", 3: "done", 4: "pending", 5: "failed", 6: "pending"}
    assert {r.id: r.status for r in L.requeued(rows).collect()} == want
    bare = rows.drop("attempts").withColumn("error_message", F.lit("why"))
    assert {r.id: (r.status, r.error_message) for r in L.requeued(bare).collect()}[5] == ("pending", None)
    tries = spark.createDataFrame([(2, True), (2, False), (None, True)], "n int, same boolean").select(L.claimed_attempts(F.col("n"), F.col("same")).alias("x"))
    assert [r.x for r in tries.collect()] == [3, 1, 1]


def test_moves_grow_with_rows_and_not_their_square(spark):
    rows = spark.range(200).selectExpr("'c' AS collection", "'same' AS file_hash", "id", "concat('/d/', id) AS source_path")
    assert L.moved(rows).count() == 199


def test_upsert_and_outcomes(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k long, v int, x string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "k long, v int, x string")
    assert sorted(map(tuple, L.upserted(old, new, "k", "v").collect())) == [(1, 0, "a"), (2, 2, "d"), (3, 1, "e")]
    rows = spark.createDataFrame([(1, "processing", None), (2, "processing", "was")], "k long, status string, error_message string")
    out = spark.createDataFrame([(2, "failed", "why")], "k long, status string, error_message string")
    assert {r.k: (r.status, r.error_message) for r in L.with_outcomes(rows, out, "k").collect()} == {1: ("processing", None), 2: ("failed", "why")}


@pytest.mark.parametrize("done,total,want", [(0, 0, 0.0), (5, -1, 0.0), (1, 3, 33.3), (9996, 10000, 99.9), (99999, 100000, 99.9), (7, 7, 100.0)])
def test_percent_never_rounds_up_to_done(spark, done, total, want):
    assert spark.range(1).select(L.percent(F.lit(done), F.lit(total)).alias("p")).first().p == want


def test_no_documents_is_never_complete(spark):
    names = "documents extracted_done extracted_failed chunked_done chunked_failed chunks embeddings_done embeddings_failed"
    schema = ", ".join(f"{n} long" for n in names.split())
    rows = spark.createDataFrame([(0,) * 8, (2, 2, 0, 2, 0, 5, 5, 0), (2, 1, 1, 1, 0, 3, 2, 1), (2, 1, 0, 1, 0, 3, 3, 0)], schema)
    got = [(r.complete, r.failures) for r in L.completeness(rows).collect()]
    assert got == [(False, 0), (True, 0), (True, 2), (False, 0)]


def test_file_progress_puts_failures_first_and_ignores_stale_work(spark):
    docs = spark.createDataFrame(
        [(1, "/b", "active", "h"), (2, "/a", "active", "h"), (3, "/c", "active", "h"), (4, "/d", "active", "new"), (5, "/e", "deleted", "h")],
        "id long, source_path string, status string, file_hash string",
    )
    ext = spark.createDataFrame(
        [(10, 1, "done", "h", "c"), (20, 2, "failed", "h", None), (40, 4, "done", "h", "c")],
        "id long, document_id long, status string, source_file_hash string, content_hash string",
    )
    chk = spark.createDataFrame([(10, "done", "c", 3)], "extracted_document_id long, status string, source_content_hash string, total_chunks int")
    rows = L.file_progress(docs, ext, chk).collect()
    assert [(r.source_path, r.progress, r.e_status) for r in rows] == [("/a", 0, "failed"), ("/c", 1, None), ("/d", 1, None), ("/b", 2, "done")]
    assert L.file_progress(docs, ext, chk, 1).count() == 1


REVISIONS = [
    (1, "a", "retired", 1), (2, "a", "retired", 2), (3, "a", "superseded", 3), (4, "a", "active", 1), (5, "a", "ready", 4), (6, "b", "building", 5),
]


def revisions(spark):
    return spark.createDataFrame(REVISIONS, "id long, collection string, status string, embedding_profile_id long")


def test_prune_keeps_the_newest_retired(spark):
    plan = L.prune_plan(revisions(spark))
    assert ids(plan.where("removable")) == [1, 3]
    assert ids(L.droppable_profiles(plan), "embedding_profile_id") == [3]
    assert {(r.collection, r.status): r.id for r in L.newest_by_slot(revisions(spark)).collect()} == {("a", "active"): 4, ("a", "ready"): 5, ("b", "building"): 6}
    assert {r.collection: r.id for r in L.targets(revisions(spark)).collect()} == {"a": 5, "b": 6}


def test_promotion(spark):
    after = {r.id: r.status for r in L.promoted(revisions(spark), 5).collect()}
    assert after == {1: "retired", 2: "retired", 3: "superseded", 4: "retired", 5: "active", 6: "building"}
    outcome = L.promotion_outcome
    assert outcome(None, 3, True, 0) == "no_ready" and outcome("ready", 0, False, 0, force=True) == "empty"
    assert outcome("ready", 3, False, 0) == "incomplete" and outcome("ready", 3, True, 1) == "blocked_by_failures"
    assert outcome("ready", 3, False, 1, force=True) == outcome("ready", 3, True, 0) == "promote"


def test_targeting_reuses_resurrects_or_creates(spark):
    state = lambda df: {r.id: r.status for r in df.collect()}
    assert state(L.targeted(revisions(spark), "a", {"embedding_profile_id": 4}, 9))[5] == "ready"
    again = state(L.targeted(revisions(spark), "a", {"embedding_profile_id": 2}, 9))
    assert again[2] == "building" and again[5] == "superseded" and again[6] == "building"
    fresh = state(L.targeted(revisions(spark), "a", {"embedding_profile_id": 8}, 9))
    assert fresh[9] == "building" and fresh[5] == "superseded" and fresh[4] == "active"


def test_directories_are_not_prefixes_of_names(spark):
    rows = spark.createDataFrame([("/data/x.txt",), ("/data-archive/x.txt",), ("/data",)], "p string")
    assert rows.where(L.under_directory(F.col("p"), "/data/")).count() == 1


def test_choice_of_row_and_moves(spark):
    paths = spark.createDataFrame([("/a", "h1"), ("/b", "h2"), ("/c", "h3")], "source_path string, file_hash string")
    at = spark.createDataFrame([("/a", 7), ("/a", 5)], "source_path string, row_id long")
    by = spark.createDataFrame([("h1", 1), ("h2", 2)], "file_hash string, row_id long")
    got = {r.source_path: r.row_id for r in L.chosen_row(paths, (at, ["source_path"]), (by, ["file_hash"])).collect()}
    assert got == {"/a": 5, "/b": 2, "/c": None}
    docs = spark.createDataFrame([(1, "c", "/old/x", "h"), (2, "c", "/new/x", "h"), (3, "d", "/new/x", "h")], "id long, collection string, source_path string, file_hash string")
    assert [(r.old_id, r.new_id) for r in L.moved(docs).collect()] == [(1, 2)]
