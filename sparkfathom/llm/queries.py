"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.llm import (
    exact_dedup,
    filter_audit,
    mixing,
    near_dedup,
    nearest,
    pii,
    quality,
    secrets,
    sentencepiece_codec,
    sharding,
    shared,
    site_text,
    spans,
    spelling,
    token_counts,
)

#: The vocabulary of the token queries, by the name its package knows.
VOCABULARY = "piece_bpe_32k.model"

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 4096

#: A to Z lower-cased and nothing else, as DuckDB writes it.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of each stays."""
    groups = exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")
    return groups.select(
        F.col("ident").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("ident").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


_OP6_SQL = f"""
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
"""

def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards whose row counts differ by one at most (law ``rows``).

    Whole documents go to the shards; size and checksum are those of the text
    that a shard has received.
    """
    docs = documents(spark, sf_dir)
    placed = sharding.shuffle_into_shards(docs, 16)
    # Held as one value, so that no column is pruned on its way to the shard.
    got = shared.held(placed, got=F.struct(*shared.named(*docs.columns)))
    text = F.col("got.text")
    return got.select(
        "got.doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: counts and a digest of the base spans, all spans."""
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[spans.count(F.col("pii_base"), k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(spans.listing(F.col("pii_base")), 256).alias("base_sha256"),
        spans.listing(F.col("pii_all")).alias("spans"),
        F.array_join(F.transform("pii_scores", lambda x: F.format_number(x, 2)), ",").alias("scores"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and a digest of the base spans, all spans."""
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        *[spans.count(F.col("secret_base"), k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(spans.listing(F.col("secret_base")), 256).alias("base_sha256"),
        spans.listing(F.col("secret_all")).alias("spans"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingles have a similarity of 0.8 or more."""
    groups = near_dedup.near_groups(documents(spark, sf_dir), width=4, percent=80)
    return groups.select(
        F.col("ident").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("ident") == F.col("component"), F.lit(False)).alias("kept"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each, towards weighted targets."""
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("ident"),
        "source",
        mixing.word_count(F.col("text")).alias("size"),
        F.lit(0).cast("long").alias("tie"),
    )
    return mixing.taken_by_document(docs).withColumnRenamed("ident", "doc_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked against the library and decoded again."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sentencepiece_codec.encode(docs, VOCABULARY).drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it is over the limit."""
    counted = token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each query by inner product."""
    found = nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)
    return found.select("query_id", "rank", F.col("ident").alias("vec_id"), "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a machine that learns outside the held-out fold."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, machine).drop("text")
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every step of every order of five filters, with Shapley values."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return filter_audit.audit_filters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus with the commoner words that they are variants of."""
    return spelling.variants_of(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, without what its site repeats."""
    return site_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Every pair that shares a shingle, its similarity, and what each document reaches.
_OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
      ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i : i + 3], ' '))) END AS gs FROM w),
s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS shingle FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS c
      FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (m + n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT g.doc_id, len(gs)::BIGINT AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g JOIN c USING (doc_id)
"""

_WORDS = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"

#: The outcome of each document under each prefix of each order, counted by part.
_OP11_SQL = f"""
WITH l AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(ws) < 50, 100 * list_unique(ws) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(least < w.doc_id, false)] AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM x a, x b, x c, x d, x e
      WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
s AS (SELECT part, o, i, n, good, toxic, fails[o[i]] AS here, list_bool_or(list_transform(range(1, i), lambda k: fails[o[k]])) AS gone,
        len(list_filter(fails, lambda z: z)) = 1 AND fails[o[i]] AS alone
      FROM c, o, (SELECT f AS i FROM x)),
r AS (SELECT part, o, i, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, i AS step,
        coalesce(sum(n) FILTER (NOT here AND NOT coalesce(gone, false)), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT coalesce(gone, false)), 0) AS removed,
        coalesce(sum(n) FILTER (here AND coalesce(gone, false)), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
        coalesce(sum(good) FILTER (here AND NOT coalesce(gone, false)), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT coalesce(gone, false)), 0) AS toxic_lost
      FROM s GROUP BY part, o, i)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, o[i]))::BIGINT AS shapley FROM r
"""

#: CRC-32 by its table, then the words; pairs by what is left without one code point.
_OP12_SQL = f"""
WITH RECURSIVE t0 AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS crc FROM t0 WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192::BIGINT + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))),
        lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]))) AS h FROM u, t),
v AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
q AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)),
e AS (SELECT word, n, unnest(list_distinct(list_transform(range(1, length(word) + 1), lambda i: left(word, i::INTEGER - 1) || substr(word, i::INTEGER + 1)))) AS less FROM w),
p AS (SELECT a.word, b.word AS near, b.n FROM q a JOIN q b ON a.mask = b.mask AND a.word <> b.word
      UNION ALL SELECT e.word, w.word, w.n FROM e JOIN w ON e.less = w.word
      UNION ALL SELECT w.word, e.word, e.n FROM e JOIN w ON e.less = w.word),
a AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word),
b AS (SELECT p.word, top, n_near, min(near) FILTER (p.n = top) AS best FROM p JOIN a USING (word) GROUP BY ALL),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN best END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
      FROM w LEFT JOIN b USING (word)),
z AS (SELECT word, coalesce(form, word) AS tip, 0 AS hops FROM f UNION ALL SELECT z.word, f.form, hops + 1 FROM z JOIN f ON f.word = z.tip WHERE f.form IS NOT NULL),
y AS (SELECT word, max_by(tip, hops) AS root FROM z GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN y USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_near_dedup": op2_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secrets": op7_secrets,
    "op8_token_counts": op8_token_counts,
    "op9_nearest": op9_nearest,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling": op12_spelling,
    "op13_site_text": op13_site_text,
}

ORACLES: dict[str, str] = {
    "op2_near_dedup": _OP2_SQL,
    "op6_exact_dedup": _OP6_SQL,
    "op11_filter_audit": _OP11_SQL,
    "op12_spelling": _OP12_SQL,
}
