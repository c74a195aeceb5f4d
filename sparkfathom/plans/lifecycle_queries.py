"""Queries over claims, progress, revisions, upserts and events, with oracle SQL.

The lifecycle tables are views of the driver tables: orders are source documents
and their extractions, the lines of an order are its chunks, customers are
revisions, and events are file events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.operators import lifecycle as L
from sparkfathom.sources.tables import table
from sparkfathom.streaming import ingest

STATUSES = ["done", "failed", "pending", "processing"]


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("collection"),
        F.concat(F.lit("/data/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("source_path"),
        F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("file_hash"),
        F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("active").alias("status"),
    )


def extracted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = F.col("o_orderdate") < "1994-01-01"
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(
        (F.col("o_orderkey") * 10).alias("id"),
        F.col("o_orderkey").alias("document_id"),
        F.when(price > 400000, "failed").when(price > 150000, "done").otherwise("processing").alias("status"),
        F.when(stale, "old").otherwise(F.concat(F.lit("h"), F.col("o_custkey").cast("string"))).alias("source_file_hash"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("content_hash"),
    )


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line"), F.count(F.lit(1)).alias("total_chunks")
    )
    return lines.select(
        (F.col("l_orderkey") * 100).alias("id"),
        (F.col("l_orderkey") * 10).alias("extracted_document_id"),
        F.when(F.col("flag") == "R", "done").when(F.col("flag") == "N", "failed").otherwise("pending").alias("status"),
        F.when(F.col("line") == "F", F.concat(F.lit("c"), F.col("l_orderkey").cast("string"))).otherwise("old").alias("source_content_hash"),
        "total_chunks",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        F.col("l_orderkey").alias("document_id"),
        (F.col("l_orderkey") * 100).alias("chunked_document_id"),
    )


def chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        F.when(flag == "R", "pending").when(flag == "A", "done").otherwise("failed").alias("status"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    status = (
        F.when(nation < 5, "active").when(nation < 10, "ready").when(nation < 15, "building").when(nation < 20, "retired").otherwise("superseded")
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("collection"), status.alias("status"),
        F.col("c_nationkey").alias("embedding_profile_id"), F.round("c_acctbal").cast("long").alias("chunk_profile_id"),
    )


_SD = """sd AS (SELECT o_orderkey AS id, o_orderpriority AS collection, '/data/' || o_custkey || '/' || o_orderkey || '.txt' AS source_path,
'h' || o_custkey AS file_hash, CASE WHEN o_orderstatus = 'P' THEN 'deleted' ELSE 'active' END AS status FROM orders)"""
_ED = """ed AS (SELECT o_orderkey * 10 AS id, o_orderkey AS document_id,
CASE WHEN o_totalprice > 400000 THEN 'failed' WHEN o_totalprice > 150000 THEN 'done' ELSE 'processing' END AS status,
CASE WHEN o_orderdate < '1994-01-01' THEN 'old' ELSE 'h' || o_custkey END AS source_file_hash, 'c' || o_orderkey AS content_hash
FROM orders WHERE o_totalprice > 100000)"""
_CD = """cd AS (SELECT l_orderkey * 100 AS id, l_orderkey * 10 AS extracted_document_id,
CASE max(l_returnflag) WHEN 'R' THEN 'done' WHEN 'N' THEN 'failed' ELSE 'pending' END AS status,
CASE WHEN min(l_linestatus) = 'F' THEN 'c' || l_orderkey ELSE 'old' END AS source_content_hash, count(*) AS total_chunks
FROM lineitem GROUP BY l_orderkey)"""
_CE = """ce AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id,
CASE l_returnflag WHEN 'R' THEN 'pending' WHEN 'A' THEN 'done' ELSE 'failed' END AS status FROM lineitem WHERE l_linestatus = 'F')"""
_CH = "ch AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS document_id, l_orderkey * 100 AS chunked_document_id FROM lineitem)"
_RV = """rv AS (SELECT c_custkey AS id, c_mktsegment AS collection, CASE WHEN c_nationkey < 5 THEN 'active' WHEN c_nationkey < 10 THEN 'ready'
WHEN c_nationkey < 15 THEN 'building' WHEN c_nationkey < 20 THEN 'retired' ELSE 'superseded' END AS status,
c_nationkey AS embedding_profile_id, round(c_acctbal)::BIGINT AS chunk_profile_id FROM customer)"""


def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to extract: missing, stale or unfinished."""
    return L.extract_claims(source_documents(spark, sf_dir), extracted_documents(spark, sf_dir)).select("id", "file_hash")


_EXTRACT_CLAIMS = f"""WITH {_SD}, {_ED} SELECT sd.id, sd.file_hash FROM sd LEFT JOIN ed ON ed.document_id = sd.id
WHERE sd.status <> 'deleted' AND (ed.id IS NULL OR ed.source_file_hash IS DISTINCT FROM sd.file_hash OR ed.status NOT IN ('done', 'failed'))"""


def chunk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished extractions to chunk."""
    found = L.chunk_claims(extracted_documents(spark, sf_dir), source_documents(spark, sf_dir), chunked_documents(spark, sf_dir))
    return found.select("id", "document_id", "content_hash")


_CHUNK_CLAIMS = f"""WITH {_SD}, {_ED}, {_CD} SELECT ed.id, ed.document_id, ed.content_hash FROM ed JOIN sd ON sd.id = ed.document_id
LEFT JOIN cd ON cd.extracted_document_id = ed.id WHERE sd.status <> 'deleted' AND ed.status = 'done'
AND (cd.id IS NULL OR cd.source_content_hash IS DISTINCT FROM ed.content_hash OR cd.status NOT IN ('done', 'failed'))"""


def embed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose embedding waits, by document."""
    found = L.embed_claims(chunks(spark, sf_dir), chunk_embeddings(spark, sf_dir))
    return found.groupBy("document_id").agg(F.count(F.lit(1)).alias("waiting"))


_EMBED_CLAIMS = f"""WITH {_CH}, {_CE} SELECT document_id, count(*) AS waiting FROM ch JOIN ce USING (chunk_id)
WHERE ce.status = 'pending' GROUP BY document_id"""


def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without an embedding row."""
    return L.pending_embeddings(chunks(spark, sf_dir), chunk_embeddings(spark, sf_dir)).select("chunk_id", "document_id")


_PENDING = f"WITH {_CH}, {_CE} SELECT chunk_id, document_id FROM ch WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.chunk_id = ch.chunk_id)"


def stranded_chunkings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished chunkings without an embedded chunk: the shape of the stranded check."""
    done = chunked_documents(spark, sf_dir).withColumnRenamed("id", "chunked_document_id")
    with_vector = L.embed_claims(chunks(spark, sf_dir), chunk_embeddings(spark, sf_dir))
    return L.stranded(done, with_vector).select("chunked_document_id", "total_chunks")


_STRANDED = f"""WITH {_CD}, {_CH}, {_CE}, w AS (SELECT chunked_document_id FROM ch JOIN ce USING (chunk_id) WHERE ce.status = 'pending')
SELECT id AS chunked_document_id, total_chunks FROM cd WHERE status = 'done' AND id NOT IN (SELECT chunked_document_id FROM w)"""


def file_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 files that most want a reader."""
    found = L.file_progress(source_documents(spark, sf_dir), extracted_documents(spark, sf_dir), chunked_documents(spark, sf_dir), 20)
    return found.select("id", "source_path", "e_status", "c_status", "total_chunks", "progress")


_PROGRESS_ROWS = """p AS (SELECT sd.id, sd.collection, source_path, ed.status AS e_status, cd.status AS c_status, total_chunks,
CASE WHEN ed.status = 'failed' THEN 0 WHEN cd.status = 'failed' THEN 0 WHEN ed.id IS NULL THEN 1 WHEN ed.status <> 'done' THEN 1
WHEN cd.id IS NULL THEN 1 WHEN cd.status <> 'done' THEN 1 ELSE 2 END AS progress
FROM sd LEFT JOIN ed ON ed.document_id = sd.id AND ed.source_file_hash = sd.file_hash
LEFT JOIN cd ON cd.extracted_document_id = ed.id AND cd.source_content_hash = ed.content_hash WHERE sd.status <> 'deleted')"""
_FILE_PROGRESS = f"""WITH {_SD}, {_ED}, {_CD}, {_PROGRESS_ROWS}
SELECT id, source_path, e_status, c_status, total_chunks, progress FROM p ORDER BY progress, source_path LIMIT 20"""


def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each progress rank and their share."""
    rows = L.file_progress(source_documents(spark, sf_dir), extracted_documents(spark, sf_dir), chunked_documents(spark, sf_dir))
    counts = rows.groupBy("progress").agg(F.count(F.lit(1)).alias("files"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    joined = counts.join(F.broadcast(total))
    return joined.select("progress", "files", L.percent(F.col("files"), F.col("total")).alias("percent"))


_PROGRESS_COUNTS = f"""WITH {_SD}, {_ED}, {_CD}, {_PROGRESS_ROWS}, c AS (SELECT progress, count(*) AS files FROM p GROUP BY progress),
t AS (SELECT sum(files) AS total FROM c)
SELECT progress, files, CASE WHEN total <= 0 THEN 0.0 WHEN round(files / total * 100, 1) >= 100 AND files < total THEN 99.9
ELSE round(files / total * 100, 1) END AS percent FROM c, t"""


def revision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every stage by collection, and whether the revision is complete."""
    docs = L.live(source_documents(spark, sf_dir)).select(F.col("id").alias("document_id"), "collection", "file_hash")
    by = lambda rows, name: rows.groupBy("collection").agg(
        F.count_if(F.col("status") == "done").alias(f"{name}_done"), F.count_if(F.col("status") == "failed").alias(f"{name}_failed")
    )
    current = extracted_documents(spark, sf_dir).join(docs, "document_id").where("source_file_hash = file_hash")
    ids = current.where("status = 'done'").select(F.col("id").alias("extracted_document_id"), "content_hash", "collection")
    chunked = chunked_documents(spark, sf_dir).join(ids, "extracted_document_id").where("source_content_hash = content_hash")
    own = chunks(spark, sf_dir).join(docs.select("document_id", "collection"), "document_id")
    embedded = chunk_embeddings(spark, sf_dir).join(own.dropDuplicates(["chunk_id"]), "chunk_id")
    counts = docs.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
    for part in (
        by(current, "extracted"), by(chunked, "chunked"), own.groupBy("collection").agg(F.count(F.lit(1)).alias("chunks")), by(embedded, "embeddings"),
    ):
        counts = counts.join(part, "collection", "left")
    filled = counts.fillna(0)
    return L.completeness(filled)


_REVISION_COUNTS = f"""WITH {_SD}, {_ED}, {_CD}, {_CH}, {_CE}, d AS (SELECT * FROM sd WHERE status <> 'deleted'),
e AS (SELECT ed.*, d.collection FROM ed JOIN d ON d.id = ed.document_id AND d.file_hash = ed.source_file_hash),
c AS (SELECT cd.*, e.collection FROM cd JOIN e ON e.id = cd.extracted_document_id AND e.status = 'done' AND e.content_hash = cd.source_content_hash),
o AS (SELECT ch.*, d.collection FROM ch JOIN d ON d.id = ch.document_id), u AS (SELECT DISTINCT chunk_id, collection FROM o),
m AS (SELECT ce.status, u.collection FROM ce JOIN u USING (chunk_id)),
a AS (SELECT collection, (SELECT count(*) FROM d x WHERE x.collection = s.collection) AS documents,
(SELECT count(*) FROM e x WHERE x.collection = s.collection AND x.status = 'done') AS extracted_done,
(SELECT count(*) FROM e x WHERE x.collection = s.collection AND x.status = 'failed') AS extracted_failed,
(SELECT count(*) FROM c x WHERE x.collection = s.collection AND x.status = 'done') AS chunked_done,
(SELECT count(*) FROM c x WHERE x.collection = s.collection AND x.status = 'failed') AS chunked_failed,
(SELECT count(*) FROM o x WHERE x.collection = s.collection) AS chunks,
(SELECT count(*) FROM m x WHERE x.collection = s.collection AND x.status = 'done') AS embeddings_done,
(SELECT count(*) FROM m x WHERE x.collection = s.collection AND x.status = 'failed') AS embeddings_failed
FROM (SELECT DISTINCT collection FROM d) s)
SELECT *, extracted_failed + chunked_failed + embeddings_failed AS failures, documents > 0 AND extracted_done + extracted_failed >= documents
AND chunked_done + chunked_failed >= extracted_done AND embeddings_done + embeddings_failed >= chunks AS complete FROM a"""


def bulk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction states of every collection in one pass."""
    docs = source_documents(spark, sf_dir).select(F.col("id").alias("document_id"), "collection")
    return L.status_counts(extracted_documents(spark, sf_dir).join(docs, "document_id"), "collection", STATUSES)


_BULK_STATUS = f"""WITH {_SD}, {_ED} SELECT sd.collection, count(*) AS total, count(*) FILTER (ed.status = 'done') AS n_done,
count(*) FILTER (ed.status = 'failed') AS n_failed, count(*) FILTER (ed.status = 'pending') AS n_pending,
count(*) FILTER (ed.status = 'processing') AS n_processing FROM ed JOIN sd ON sd.id = ed.document_id GROUP BY sd.collection"""


def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct collections of documents and of revisions."""
    a = source_documents(spark, sf_dir).select("collection").distinct()
    return a.union(revisions(spark, sf_dir).select("collection").distinct()).distinct()


_COLLECTIONS = f"WITH {_SD}, {_RV} SELECT collection FROM sd UNION SELECT collection FROM rv"


def newest_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest_by_slot(revisions(spark, sf_dir)).select("collection", "status", "id")


_SLOTS = f"WITH {_RV} SELECT collection, status, max(id) AS id FROM rv WHERE status IN ('active', 'ready', 'building') GROUP BY ALL"


def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which revisions may go."""
    return L.prune_plan(revisions(spark, sf_dir)).select("id", "collection", "removable")


_PRUNE = f"""WITH {_RV} SELECT id, collection, status = 'superseded' OR (status = 'retired' AND id <> max(id) FILTER (status = 'retired')
OVER (PARTITION BY collection)) AS removable FROM rv"""


def droppable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that only removable revisions refer to."""
    return L.droppable_profiles(L.prune_plan(revisions(spark, sf_dir)))


_DROPPABLE = f"""WITH {_RV}, p AS ({_PRUNE.split("WITH " + _RV)[1]})
SELECT embedding_profile_id, 0::BIGINT AS kept_references FROM rv JOIN p USING (id) GROUP BY 1 HAVING count(*) FILTER (NOT removable) = 0"""


def progress_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.targets(revisions(spark, sf_dir)).select("collection", "id", "status")


_TARGETS = f"""WITH {_RV}, r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY CASE WHEN status = 'active' THEN 1 ELSE 0 END, id DESC) AS n
FROM rv WHERE status IN ('active', 'ready', 'building')) SELECT collection, id, status FROM r WHERE n = 1"""
_REVISION_CHOICE = f"""WITH {_RV}, r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY CASE status WHEN 'active' THEN 3 WHEN 'ready' THEN 2
ELSE 1 END DESC, id DESC) AS n FROM rv WHERE status IN ('active', 'ready', 'building')) SELECT collection, id, status FROM r WHERE n = 1"""


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, set and null-safe predicates over orders, and a semi-join with targets."""
    docs = source_documents(spark, sf_dir)
    wanted = revisions(spark, sf_dir).where("status = 'active'").select(F.concat(F.lit("/data/"), F.col("id").cast("string")).alias("directory"))
    rows = docs.withColumn("directory", F.substring_index("source_path", "/", 3))
    hits = L.in_targets(rows, wanted, ["directory"])
    return hits.where(F.col("collection").isin("1-URGENT", "2-HIGH")).select(
        "id",
        L.under_directory(F.col("source_path"), "/data/1").alias("under_one"),
        L.differs(F.col("file_hash"), F.nullif(F.col("status"), F.lit("deleted"))).alias("differs"),
    )


_PREDICATES = f"""WITH {_SD}, {_RV} SELECT sd.id, starts_with(source_path, '/data/1/') AS under_one,
file_hash IS DISTINCT FROM nullif(status, 'deleted') AS differs FROM sd
WHERE collection IN ('1-URGENT', '2-HIGH') AND EXISTS (SELECT 1 FROM rv WHERE rv.status = 'active' AND '/data/' || rv.id = '/data/' || split_part(source_path, '/', 3))"""


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested less searchable, pool intersection and sampled union of customer numbers."""
    r = revisions(spark, sf_dir)
    requested = r.select("id")
    searchable = r.where(F.col("status").isin("active", "ready", "building")).select("id")
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    tagged = lambda rows, name: rows.select(F.lit(name).alias("set"), "id")
    return (
        tagged(requested.join(searchable, "id", "left_anti"), "unsearchable")
        .unionByName(tagged(searchable.intersect(buyers), "pool"))
        .unionByName(tagged(searchable.union(buyers).distinct(), "union"))
    )


_SETS = f"""WITH {_RV}, s AS (SELECT id FROM rv WHERE status IN ('active', 'ready', 'building')), b AS (SELECT o_custkey AS id FROM orders)
SELECT 'unsearchable' AS set, id FROM (SELECT id FROM rv EXCEPT SELECT id FROM s) UNION ALL
SELECT 'pool', id FROM (SELECT id FROM s INTERSECT SELECT id FROM b) UNION ALL SELECT 'union', id FROM (SELECT id FROM s UNION SELECT id FROM b)"""


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written over their customers' earlier rows: the last by number counts."""
    existing = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("version"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"))
    return L.upserted(existing, new, "key", "version")


_UPSERT = """WITH n AS (SELECT o_custkey AS key, o_orderkey AS version, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT key, version, value FROM n WHERE r = 1 UNION ALL SELECT c_custkey, -1, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction states after the outcome of a batch is written back."""
    rows = extracted_documents(spark, sf_dir).select("document_id", "status", F.lit(None).cast("string").alias("error_message"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("document_id")).agg(
        F.lit("failed").alias("status"), F.concat(F.lit("lines "), F.count(F.lit(1)).cast("string")).alias("error_message")
    )
    return L.with_outcomes(rows, done, "document_id")


_OUTCOMES = f"""WITH {_ED}, o AS (SELECT l_orderkey AS document_id, 'lines ' || count(*) AS e FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT document_id, CASE WHEN e IS NULL THEN status ELSE 'failed' END AS status, e AS error_message FROM ed LEFT JOIN o USING (document_id)"""


def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and interrupted rows wait again or are given up; attempts are the lines of an order."""
    lines = chunked_documents(spark, sf_dir).select((F.col("extracted_document_id") / 10).cast("long").alias("document_id"), F.col("total_chunks").alias("attempts"))
    rows = extracted_documents(spark, sf_dir).join(lines, "document_id")
    return L.requeued(rows).select("document_id", "attempts", "status")


_REQUEUE = f"""WITH {_ED}, {_CD} SELECT document_id, total_chunks AS attempts, CASE WHEN ed.status = 'processing' AND total_chunks >= 3 THEN 'failed'
WHEN ed.status IN ('failed', 'processing') AND total_chunks < 3 THEN 'pending' ELSE ed.status END AS status FROM ed JOIN cd ON cd.extracted_document_id = ed.id"""


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", "event_id", "event_type")
    return ingest.debounced(events).select("path", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")


_DEBOUNCE = """SELECT user_id AS path, epoch_us(ts) AS at, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
ORDER BY ts DESC, event_id DESC, event_type DESC) AS r FROM events) WHERE r = 1"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing of live orders changes in the table of extracted ones."""
    listing = L.live(source_documents(spark, sf_dir)).select(F.col("id").alias("path"), "file_hash")
    known = extracted_documents(spark, sf_dir).select(F.col("document_id").alias("path"), F.col("source_file_hash").alias("file_hash"))
    return ingest.snapshot_diff(listing, known)


_DIFF = f"""WITH {_SD}, {_ED}, l AS (SELECT * FROM sd WHERE status <> 'deleted')
SELECT coalesce(l.id, ed.document_id) AS path, CASE WHEN ed.document_id IS NULL THEN 'created' WHEN l.id IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM l FULL JOIN ed ON ed.document_id = l.id WHERE ed.document_id IS NULL OR l.id IS NULL OR l.file_hash IS DISTINCT FROM ed.source_file_hash"""


def choose_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document row that each order's file takes: by path, else by hash, else none."""
    paths = source_documents(spark, sf_dir).select(F.col("id").alias("file"), "source_path", "file_hash")
    at_path = source_documents(spark, sf_dir).where("status = 'active'").select("source_path", F.col("id").alias("row_id"))
    by_hash = source_documents(spark, sf_dir).where("collection = '1-URGENT'").select("file_hash", F.col("id").alias("row_id"))
    found = L.chosen_row(paths, (at_path, ["source_path"]), (by_hash, ["file_hash"]))
    return found.select("file", "row_id")


_CHOOSE = f"""WITH {_SD}, h AS (SELECT file_hash, min(id) AS row_id FROM sd WHERE collection = '1-URGENT' GROUP BY 1)
SELECT sd.id AS file, CASE WHEN status = 'active' THEN sd.id ELSE h.row_id END AS row_id FROM sd LEFT JOIN h USING (file_hash)"""


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a listing of extracted orders under one root lacks, marked deleted."""
    docs = source_documents(spark, sf_dir).withColumnRenamed("source_path", "path")
    listed = docs.join(extracted_documents(spark, sf_dir).select(F.col("document_id").alias("id")), "id").select("path")
    gone = ingest.missing(docs, listed, ["/data"])
    return ingest.tombstoned(docs, gone).select("id", "status", "file_hash")


_TOMBSTONES = f"""WITH {_SD}, {_ED} SELECT sd.id, CASE WHEN ed.id IS NULL THEN 'deleted' ELSE sd.status END AS status,
CASE WHEN ed.id IS NOT NULL THEN file_hash END AS file_hash FROM sd LEFT JOIN ed ON ed.document_id = sd.id"""


def skip_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 last error events."""
    skips = table(spark, sf_dir, "events").where("event_type = 'error'").select("ts", F.col("event_id").alias("path"), F.col("props").alias("reason"))
    return ingest.skip_ledger(skips)[1].select("path", "reason")


_SKIPS = "SELECT event_id AS path, props AS reason FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50"


def lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's event came within ten seconds after the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w)).where("before is not null")
    return rows.select("event_id", ingest.is_fresh(F.col("before"), F.col("ts"), 10).alias("fresh"))


_LEASE = """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, epoch_us(ts) - epoch_us(b) <= 10000000 AS fresh FROM e WHERE b IS NOT NULL"""


def reuse_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that unchanged size and time let a restart keep."""
    from sparkfathom.functions.identity import reused_hash

    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("mtime"))
    old = table(spark, sf_dir, "orders").where("o_orderstatus != 'O'").select(
        F.col("o_orderkey").alias("file"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("old_size"),
        F.col("o_orderdate").alias("old_mtime"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("old_hash"),
    )
    kept = reused_hash(*[F.col(c) for c in ("size", "mtime", "old_size", "old_mtime", "old_hash")])
    return now.join(old, "file", "left").select("file", kept.alias("hash"))


_REUSE = "SELECT o_orderkey AS file, CASE WHEN o_orderstatus = 'F' THEN 'h' || o_orderkey END AS hash FROM orders"

_NAMES = (
    "extract_claims chunk_claims embed_claims pending_embeddings stranded_chunkings file_progress progress_counts revision_counts bulk_status "
    "collection_names newest_by_slot prune_plan droppable_profiles progress_targets predicates set_operations upsert outcomes requeue debounce "
    "snapshot_diff choose_row tombstones skip_ledger lease reuse_hash"
).split()

QUERIES = {name: globals()[name] for name in _NAMES}

ORACLES = dict(
    zip(
        _NAMES,
        (
            _EXTRACT_CLAIMS, _CHUNK_CLAIMS, _EMBED_CLAIMS, _PENDING, _STRANDED, _FILE_PROGRESS, _PROGRESS_COUNTS, _REVISION_COUNTS, _BULK_STATUS,
            _COLLECTIONS, _SLOTS, _PRUNE, _DROPPABLE, _TARGETS, _PREDICATES, _SETS, _UPSERT, _OUTCOMES, _REQUEUE, _DEBOUNCE,
            _DIFF, _CHOOSE, _TOMBSTONES, _SKIPS, _LEASE, _REUSE,
        ),
        strict=True,
    )
) | {"revision_choice": _REVISION_CHOICE}
