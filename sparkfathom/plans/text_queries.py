"""Queries over text preparation, chunking and identity, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.operators import canary, fuzzy, spans
from sparkfathom.functions import chunking, identity, validation
from sparkfathom.functions import text as T
from sparkfathom.sources.tables import table

_WS = "'\\s+'"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), {_WS}), lambda w: w <> '')"


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 320 words with an overlap of 80, of every document."""
    chunks = chunking.chunk_words(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return chunks.select("doc_id", "chunk_index", "n_tokens", identity.content_hash(F.col("content")).alias("content_sha256"))


_CHUNKS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents),
n AS (SELECT *, 1 + greatest(ceil((len(t) - 320) / 240.0), 0)::INT AS n FROM w WHERE len(t) > 0),
i AS (SELECT doc_id, t, unnest(range(n))::INT AS chunk_index FROM n)
SELECT doc_id, chunk_index, len(t[chunk_index * 240 + 1 : chunk_index * 240 + 320])::INT AS n_tokens,
       sha256(array_to_string(t[chunk_index * 240 + 1 : chunk_index * 240 + 320], ' ')) AS content_sha256 FROM i"""


def text_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run, blank and identifier tests, punctuation share and prefixed form of each text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    prefixed = T.with_task_prefix(t, "document", "/models/nomic-embed-text-v1.5.gguf")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.longest_run(t).alias("longest_run"),
        T.is_blank(t).alias("is_blank"),
        T.is_identifier(t).alias("is_identifier"),
        F.round(T.punctuation_share(t), 6).alias("punctuation_share"),
        F.sha2(T.preview(t), 256).alias("preview_sha256"),
        F.sha2(prefixed, 256).alias("prefixed_sha256"),
        F.char_length(T.without_nul(t)).alias("n_without_nul"),
    )


_TEXT = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents)
SELECT doc_id, coalesce(list_max(list_transform(ws, lambda w: length(w))), 0)::INT AS longest_run,
       len(ws) = 0 AS is_blank, len(ws) = 1 AS is_identifier,
       round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) / len(ws)::DOUBLE ELSE 1 END, 6) AS punctuation_share,
       sha256(trim(regexp_replace(t, {_WS}, ' ', 'g'))) AS preview_sha256,
       sha256(CASE WHEN starts_with(t, 'search_document: ') THEN t ELSE 'search_document: ' || t END) AS prefixed_sha256,
       length(replace(t, chr(0), ''))::INT AS n_without_nul FROM w"""


def capitalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct capitalised words of each document, counted over all."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.capitalised_tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


_CAPITALISED = """WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(
regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z]{2,}')))) AS token FROM documents)
SELECT token, count(*) AS documents FROM t WHERE token NOT IN ('The','This','That','These','Those','There','Then','They','Their','We','Our',
'It','Its','In','For','And','But','Not','All','One','Two','Table','Figure','Section','Appendix','However','Since','Thus','Here','When','While',
'With','From','Given','Let','Note','See') GROUP BY token"""


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, profile fingerprint and revision label of every document."""
    chunk = identity.fingerprint(identity.chunk_profile(chunking.SIZE, chunking.OVERLAP, "words"))
    own = identity.content_hash(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", own.alias("content_hash"), identity.revision_label(own, F.lit(chunk)).alias("label")
    )


_HASHES = """SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, substr(sha256(coalesce(text, '')), 1, 8) || '-' ||
substr(sha256('{"chunk_overlap":80,"chunk_size":320,"tokenizer":"words","version":"v3"}'), 1, 8) AS label FROM documents"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and titles of every page's address."""
    return table(spark, sf_dir, "pages").select(
        "page_id", T.file_name(F.col("url")).alias("file_name"), T.title_from_path(F.concat("url", F.lit("-a_b.pdf"))).alias("title")
    )


_TITLES = """SELECT page_id, list_last(string_split(url, '/')) AS file_name,
trim(translate(regexp_replace(regexp_replace(list_last(string_split(url || '-a_b.pdf', '/')), '\\.pdf$', ''), '^[0-9]{4}-', ''), '-_', '  ')) AS title FROM pages"""


def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources would do as collection names."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(
        table(spark, sf_dir, "nation").select("n_name")
    )
    return rows.select("name", validation.is_collection_name(F.col("name")).alias("valid"))


_NAMES = """WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT n_name FROM nation)
SELECT name, regexp_matches(trim(name), '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AND length(trim(name)) <= 100 AS valid FROM n"""


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of one document, blank ones dropped and the rest renumbered."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("contents")
    )
    kept = turns.select("conv_id", F.posexplode(chunking.renumbered(F.col("contents"))).alias("chunk_index", "content"))
    return kept.select("conv_id", "chunk_index", identity.content_hash(F.col("content")).alias("content_sha256"))


_TURNS = """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index, sha256(text) AS content_sha256
FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"""


def phrase_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many phrase candidates each benchmark text offers, and the first one."""
    found = table(spark, sf_dir, "benchmark").withColumn("p", T.phrase_candidates(F.col("text")))
    return found.select("item_id", F.size("p").alias("candidates"), F.get("p", F.lit(0)).alias("first"))


def span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window of 1500 characters the window of 1000 that it shares most with."""
    docs = table(spark, sf_dir, "documents")
    return spans.aligned(spans.char_windows(docs, 1500, 1200), spans.char_windows(docs, 1000, 700))


def _windows_sql(size: int, step: int) -> str:
    last = f"greatest(ceil((length(text) - {size}) / {step}), 0)::INTEGER"
    return f"""SELECT doc_id, chunk::INTEGER AS chunk, chunk * {step} AS s, least(chunk * {step} + {size}, n) AS e
FROM (SELECT doc_id, length(text) AS n, unnest(range({last} + 1)) AS chunk FROM documents WHERE length(text) > 0)"""


_SPAN_ALIGNMENT = f"""WITH a AS ({_windows_sql(1500, 1200)}), b AS ({_windows_sql(1000, 700)}),
m AS (SELECT a.doc_id, a.chunk AS chunk_a, b.chunk AS chunk_b, (least(a.e, b.e) - greatest(a.s, b.s))::INTEGER AS shared FROM a JOIN b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_a ORDER BY shared DESC, chunk_b) AS n FROM m)
SELECT doc_id, chunk_a, chunk_b, shared FROM r WHERE n = 1"""


def fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages whose trigrams have a similarity of 0.25 or more."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    pairs = fuzzy.similar_pairs(rows, rows, 0.25).where("left_id < right_id")
    return pairs.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


_FUZZY = """WITH p AS (SELECT item_id AS id, '  ' || lower(coalesce(text, '')) || ' ' AS t FROM benchmark),
g AS (SELECT id, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gs FROM p),
u AS (SELECT id, len(gs) AS n, unnest(gs) AS gram FROM g),
c AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS m, b.n AS n, count(*) AS c FROM u a JOIN u b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
SELECT left_id, right_id, round(c / (m + n - c), 6) AS similarity FROM c WHERE c / (m + n - c) >= 0.25 - 1e-12"""


def canary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label stored as JSON, decoded again and compared with the table.

    A payload holds a block of 256 identifiers of a label, so that it has a bound.
    """
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").withColumn("block", F.floor(F.col("vec_id") / 256))
    kept = F.collect_list(F.struct(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector")))
    stored = rows.groupBy("label", "block").agg(F.to_json(F.sort_array(kept)).alias("payload"))
    decoded = canary.decoded(stored, "label", "payload")
    fresh = rows.select("label", F.col("vec_id").cast("string").alias("text"), "embedding")
    both = decoded.join(fresh, ["label", "text"], "full")
    equal = F.coalesce(F.col("vector") == F.col("embedding"), F.lit(False))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.bool_and(equal).alias("identical"), F.max(F.size("vector")).alias("dimension"))


_CANARY_PAYLOADS = """WITH j AS (SELECT label, to_json(list({'text': vec_id::VARCHAR, 'vector': embedding} ORDER BY vec_id)) AS payload FROM embeddings WHERE embedding IS NOT NULL GROUP BY label),
d AS (SELECT label, unnest(from_json(payload, '[{"text": "VARCHAR", "vector": ["FLOAT"]}]')) AS x FROM j)
SELECT d.label, count(*) AS texts, bool_and(x.vector = e.embedding) AS identical, max(len(x.vector))::INTEGER AS dimension
FROM d JOIN embeddings e ON e.vec_id::VARCHAR = x.text GROUP BY d.label"""


QUERIES = {
    "span_alignment": span_alignment,
    "fuzzy_passages": fuzzy_passages,
    "canary_payloads": canary_payloads,
    "chunk_documents": chunk_documents,
    "text_preparation": text_preparation,
    "capitalised": capitalised,
    "content_hashes": content_hashes,
    "titles": titles,
    "valid_names": valid_names,
    "conversation_chunks": conversation_chunks,
    "phrase_sets": phrase_sets,
}

ORACLES = {
    "span_alignment": _SPAN_ALIGNMENT,
    "fuzzy_passages": _FUZZY,
    "canary_payloads": _CANARY_PAYLOADS,
    "chunk_documents": _CHUNKS,
    "text_preparation": _TEXT,
    "capitalised": _CAPITALISED,
    "content_hashes": _HASHES,
    "titles": _TITLES,
    "valid_names": _NAMES,
    "conversation_chunks": _TURNS,
}
