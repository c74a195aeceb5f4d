"""Queries over vectors, texts and their fusion, with oracle SQL."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.functions import vectors as V
from sparkfathom.operators import fusion, knn, lexical
from sparkfathom.operators.search import Corpus, Searcher, searchable_revisions
from sparkfathom.operators.graph_index import GraphIndex
from sparkfathom.operators.lexical_index import LexicalIndex
from sparkfathom.sources.tables import kept, shared_folder, table

#: The query of the lexical and hybrid queries, and one word.
QUERY, WORD = "the of and", "the"


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents as one chunk each; a vector belongs to the document of its number."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    routed = vectors.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("collection")), "chunk_id")
    return Corpus(
        documents=docs.select(
            F.col("doc_id").alias("id"),
            F.col("lang").alias("collection"),
            F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("source_path"),
        ),
        chunks=docs.select(
            F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content")
        ),
        vectors=routed,
    )


def document_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The index of the documents, made once for an application and its files."""
    chunks = corpus(spark, sf_dir).chunks
    files = "|".join([sf_dir, spark.sparkContext.applicationId, *sorted(chunks.inputFiles())])
    index = LexicalIndex(spark, f"{shared_folder(spark)}/index-{hashlib.sha256(files.encode()).hexdigest()[:24]}")
    if not index.segments():
        index.add(chunks)
    return index


def vector_index(spark: SparkSession, sf_dir: str) -> GraphIndex:
    """The graph index of the vectors, made once for an application and its files."""
    vectors = corpus(spark, sf_dir).vectors
    files = "|".join([sf_dir, spark.sparkContext.applicationId, *sorted(vectors.inputFiles())])
    path = f"{shared_folder(spark)}/graph-{hashlib.sha256(files.encode()).hexdigest()[:24]}"
    if path not in _GRAPHS:
        GraphIndex(vectors, path)
        _GRAPHS.add(path)
    return GraphIndex.open(spark, path)


#: Graph indexes that this application has stored.
_GRAPHS: set[str] = set()


def indexed_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return replace(corpus(spark, sf_dir), index=document_index(spark, sf_dir))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding of the smallest number: one row."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").orderBy("vec_id").limit(1).collect()
    return [float(x) for x in rows[0]["embedding"]] if rows else []


def _knn(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scoped = knn.scope(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), label=3)
        hits = knn.nearest(scoped, first_vector(spark, sf_dir), 10, metric)
        return hits.select("chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "score_kind")

    return query


_D = {
    "cosine": "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.v)",
    "l2": "list_distance(e.embedding::DOUBLE[], q.v)",
    "ip": "-list_inner_product(e.embedding::DOUBLE[], q.v)",
}
_S = {"cosine": ("1 - d", "cosine_similarity"), "l2": ("-d", "negative_l2_distance"), "ip": ("-d", "inner_product")}
_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)"


def _knn_sql(metric: str) -> str:
    score, kind = _S[metric]
    return f"""WITH {_Q}, t AS (SELECT vec_id AS chunk_id, {_D[metric]} AS d FROM embeddings e, q WHERE label = 3)
SELECT chunk_id, round(d, 6) AS distance, round({score}, 6) AS score, '{kind}' AS score_kind
FROM t ORDER BY d, chunk_id LIMIT 10"""


def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of each label to the label's first vector."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.groupBy("label").agg(
        F.min("chunk_id").alias("query_id"), F.min_by("embedding", "chunk_id").alias("query")
    )
    return knn.nearest_by_group(rows, queries, "label", 5).select("label", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


_BATCH_KNN = f"""WITH f AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label),
q AS (SELECT f.label, e.embedding::DOUBLE[] AS v FROM f JOIN embeddings e ON e.vec_id = f.query_id),
t AS (SELECT e.label, vec_id AS chunk_id, {_D["cosine"]} AS d FROM embeddings e JOIN q ON q.label = e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, chunk_id) AS rank FROM t)
SELECT label, chunk_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5"""


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm, distances to the first vector and largest normalised component of each vector."""
    q = F.array(*[F.lit(x) for x in first_vector(spark, sf_dir)])
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(V.checked_dimension(e)).alias("dimension"),
        F.round(V.norm(e), 6).alias("norm"),
        F.round(V.cosine_similarity(e, q), 6).alias("cosine"),
        F.round(V.l2_distance(e, q), 6).alias("l2"),
        F.round(V.inner_product(e, q), 6).alias("ip"),
        F.round(F.array_max(V.normalised(e)), 6).alias("largest"),
    )


_VECTOR_FUNCTIONS = f"""WITH {_Q}
SELECT vec_id, len(embedding) AS dimension,
       round(sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm,
       round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS cosine,
       round(list_distance(e.embedding::DOUBLE[], q.v), 6) AS l2,
       round(list_inner_product(e.embedding::DOUBLE[], q.v), 6) AS ip,
       round(list_max(e.embedding::DOUBLE[]) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS largest
FROM embeddings e, q"""


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised mean vector of each label, a row for each position."""
    pooled = V.mean_pooled(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select("label", "pos", F.round("value", 6).alias("value"))


_MEAN_POOL = """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS mean FROM p GROUP BY ALL),
s AS (SELECT label, sqrt(sum(mean * mean)) AS size FROM m GROUP BY label)
SELECT label, pos::INT AS pos, round(mean / size, 6) AS value FROM m JOIN s USING (label)"""


def canary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst cosine and largest component difference of neighbouring vectors."""
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(
        e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id"
    )
    row = V.worst_agreement(pairs, "a", "b")
    return row.select(F.round("worst_cosine", 6).alias("worst_cosine"), F.round("max_difference", 6).alias("max_difference"))


_CANARY = """WITH p AS (SELECT a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT round(min(list_cosine_similarity(x, y)), 6) AS worst_cosine,
       round(max(list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))), 6) AS max_difference FROM p"""

_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _ranked_sql(terms: list[str], need: int) -> str:
    """CTEs up to ``ranked(doc_id, matched, rank)`` over documents."""
    tfs = ", ".join(f"len(list_filter(terms, lambda x: x = '{t}'))" for t in terms)
    dfs = ", ".join(f"count(*) FILTER (tfs[{i}] > 0)" for i in range(1, len(terms) + 1))
    part = (
        "ln(1 + (n - dfs[{i}] + 0.5) / (dfs[{i}] + 0.5)) * tfs[{i}] * 2.2 / (tfs[{i}] + 1.2 * (0.25 + 0.75 * length / m))"
    )
    rank = " + ".join(part.format(i=i) for i in range(1, len(terms) + 1))
    matched = " + ".join(f"(tfs[{i}] > 0)::INT" for i in range(1, len(terms) + 1))
    return f"""t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
c AS (SELECT doc_id, len(terms) AS length, [{tfs}] AS tfs FROM t),
f AS (SELECT count(*) AS n, avg(length) AS m, [{dfs}] AS dfs FROM c),
ranked AS (SELECT doc_id, {matched} AS matched, {rank} AS rank FROM c, f WHERE {matched} >= {need})"""


def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold every word of the query, with their rank."""
    terms = lexical.query_lexemes(spark, QUERY)
    hits = lexical.ranked_matches(corpus(spark, sf_dir).chunks, terms, len(terms))
    return hits.select("chunk_id", "matched", F.round("rank", 6).alias("rank"))


_LEXICAL_MATCH = f"""WITH {_ranked_sql(QUERY.split(), 3)}
SELECT doc_id AS chunk_id, matched, round(rank, 6) AS rank FROM ranked"""


def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best exact matches among documents with a vector."""
    c = corpus(spark, sf_dir)
    return lexical.lexical_top(c.chunks, c.vectors, QUERY, 10).select("chunk_id", F.round("rank", 6).alias("rank"))


def _lexical_top_sql(terms: list[str], need: int) -> str:
    return f"""WITH {_ranked_sql(terms, need)},
pool AS (SELECT * FROM ranked ORDER BY doc_id LIMIT 2000),
seen AS (SELECT * FROM pool WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)))
SELECT doc_id AS chunk_id, round(rank, 6) AS rank FROM seen ORDER BY seen.rank DESC, doc_id LIMIT 10"""


def indexed_lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best exact matches, from the index."""
    hits = document_index(spark, sf_dir).lexical_top(QUERY, 10, corpus(spark, sf_dir).vectors)
    return hits.select("chunk_id", F.round("rank", 6).alias("rank"))


def indexed_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of all documents that hold three of five words, from the index."""
    hits = document_index(spark, sf_dir).lexical_top(RELAXED, 20, relaxed=True, pool=None)
    return hits.select("chunk_id", F.round("rank", 6).alias("rank"))


def indexed_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarity of a word, from the index."""
    return document_index(spark, sf_dir).probe(WORD, corpus(spark, sf_dir).vectors)


def proximity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents in which the words of the query stand nearest."""
    hits = document_index(spark, sf_dir).lexical_top(QUERY, 20, pool=None, near=True)
    return hits.select("chunk_id", F.round("rank", 6).alias("rank"))


#: Chances of all pairs of positions of two words, combined.
_PROXIMITY = f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
p AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM t)
      WHERE term IN ({", ".join(f"'{w}'" for w in QUERY.split())})),
h AS (SELECT doc_id FROM p GROUP BY doc_id HAVING count(DISTINCT term) = {len(QUERY.split())}),
w AS (SELECT a.doc_id, sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2))))) AS s
      FROM p a JOIN p b ON b.doc_id = a.doc_id AND a.term < b.term AND abs(a.pos - b.pos) <= 100 GROUP BY a.doc_id)
SELECT doc_id AS chunk_id, round(1 - exp(coalesce(s, 0)), 6) AS rank FROM h LEFT JOIN w USING (doc_id) ORDER BY round(1 - exp(coalesce(s, 0)), 9) DESC, doc_id LIMIT 20"""

#: Two words that follow each other.
PHRASE = "of the"


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase, and how often."""
    return document_index(spark, sf_dir).phrase(PHRASE)


_PHRASE = f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents)
SELECT doc_id AS chunk_id, len(list_filter(range(1, len(terms)), lambda i: terms[i] = 'of' AND terms[i + 1] = 'the'))::INTEGER AS times FROM t
WHERE len(list_filter(range(1, len(terms)), lambda i: terms[i] = 'of' AND terms[i + 1] = 'the')) > 0"""

RELAXED = "the of qzxv and de"


def lexical_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents that hold 60% of the words of a mistyped query."""
    c = corpus(spark, sf_dir)
    hits = lexical.lexical_top(c.chunks, c.vectors, RELAXED, 10, relaxed=True)
    return hits.select("chunk_id", F.round("rank", 6).alias("rank"))


def rarity_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a capped sample shows a word to match."""
    c = corpus(spark, sf_dir)
    return lexical.probe(c.chunks, c.vectors, WORD)


_PROBE = f"""WITH m AS (SELECT doc_id FROM documents WHERE list_contains({_TERMS}, '{WORD}') ORDER BY doc_id LIMIT 400),
j AS (SELECT m.doc_id, v.vec_id IS NOT NULL AS seen FROM m LEFT JOIN embeddings v ON v.vec_id = m.doc_id)
SELECT count(*) AS sampled,
       CASE WHEN count(*) < 400 THEN count(DISTINCT doc_id) FILTER (seen) ELSE count(DISTINCT doc_id) END AS documents FROM j"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of every term."""
    rows = lexical.postings(corpus(spark, sf_dir).chunks)
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("length").alias("longest"))


_POSTINGS = f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
u AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM t)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, max(length) AS longest FROM u GROUP BY term"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: both arms, fused by document, the vector arm owning rank 1."""
    found = Searcher(indexed_corpus(spark, sf_dir), pool=lexical.POOL).search(QUERY, first_vector(spark, sf_dir), 10)
    return found.select(
        "rank", "document_id", "collection", "source_path", F.round("score", 6).alias("score"),
        F.round("distance", 6).alias("distance"), "score_kind", F.sha2("content", 256).alias("content_sha256"),
    )


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query through the text index and the graph index, which is approximate."""
    c = replace(indexed_corpus(spark, sf_dir), vector_index=vector_index(spark, sf_dir))
    found = Searcher(c).search(QUERY, first_vector(spark, sf_dir), 10)
    return found.select("rank", "document_id", "collection", F.round("score", 6).alias("score"), "score_kind")


def hybrid_search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within two collections."""
    found = Searcher(indexed_corpus(spark, sf_dir), pool=lexical.POOL).search(QUERY, first_vector(spark, sf_dir), 10, ["en", "fr"])
    return found.select("rank", "document_id", "collection", F.round("score", 6).alias("score"), "score_kind")


def _best_sql(terms: list[str], need: int, k: int) -> str:
    return f"WITH {_ranked_sql(terms, need)} SELECT doc_id AS chunk_id, round(rank, 6) AS rank FROM ranked ORDER BY ranked.rank DESC, doc_id LIMIT {k}"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark passage: its first four words, with the vector of its number."""
    words = F.slice(F.split("text", " "), 1, 4)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))
    return items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def batch_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages as queries at once; each language is a revision with arms of its own."""
    own = replace(indexed_corpus(spark, sf_dir), by=("collection",))
    found = Searcher(own).search_many(passages(spark, sf_dir), 10, keep=kept)
    return found.select(
        "query_id", "rank", "document_id", "collection", "source_path", F.round("score", 6).alias("score"),
        F.round("distance", 6).alias("distance"), "score_kind", F.sha2("content", 256).alias("content_sha256"),
    )


_BATCH_HYBRID = f"""WITH q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS query, embedding::DOUBLE[] AS v
  FROM benchmark JOIN embeddings ON vec_id = item_id),
scoped AS (SELECT e.vec_id AS id, d.lang AS collection, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
vd AS (SELECT query_id, collection, id, {_D["cosine"]} AS d FROM scoped e, q),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY d, id) AS place FROM vd) WHERE place <= 50),
qt AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS terms FROM q),
a AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM qt),
t AS (SELECT doc_id AS id, {_TERMS} AS terms FROM documents),
f AS (SELECT count(*) AS n, avg(len(terms)) AS m FROM t),
p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(terms) AS length, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT query_id, id, any_value(n_terms) AS n_terms, count(*) AS matched,
        round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 9) AS rank
      FROM p JOIN a USING (term) JOIN df USING (term), f GROUP BY query_id, id),
xp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pool FROM m WHERE matched = n_terms),
x AS (SELECT xp.*, collection FROM xp JOIN scoped USING (id) WHERE pool <= 2000),
yp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pool FROM m
       WHERE n_terms <= 8 AND matched >= greatest(1, ceil(0.6 * n_terms - 1e-9)) AND query_id NOT IN (SELECT query_id FROM x)),
y AS (SELECT yp.*, collection FROM yp JOIN scoped USING (id) WHERE pool <= 2000),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY rank DESC, id) AS place
      FROM (SELECT * FROM x UNION ALL SELECT * FROM y)) WHERE place <= 50),
vr AS (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY 1 - d DESC, collection, place) AS v_rank FROM v),
lr AS (SELECT query_id, id, rank AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, collection, place) AS l_rank FROM l),
u AS (SELECT coalesce(vr.query_id, lr.query_id) AS query_id, coalesce(vr.id, lr.id) AS id, v_rank, l_rank, d, lr.score,
      coalesce(1.0 / (60 + v_rank), 0)::DOUBLE + coalesce(1.0 / (60 + l_rank), 0)::DOUBLE AS rrf FROM vr FULL JOIN lr ON vr.query_id = lr.query_id AND vr.id = lr.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(v_rank = 1, false) DESC, rrf DESC, coalesce(v_rank, 1000000000 + l_rank), id) AS rank FROM u)
SELECT r.query_id, {{shown}} FROM r JOIN documents x ON x.doc_id = r.id WHERE r.rank <= 10"""


def _hybrid_sql(where: str, columns: str) -> str:
    return f"""WITH {_Q},
scoped AS (SELECT e.vec_id, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id {where}),
va AS (SELECT vec_id AS id, {_D["cosine"]} AS d FROM scoped e, q ORDER BY 2, 1 LIMIT 50),
v AS (SELECT *, row_number() OVER (ORDER BY d, id) AS v_rank FROM va),
{_ranked_sql(QUERY.split(), 3)},
pool AS (SELECT * FROM ranked ORDER BY doc_id LIMIT 2000),
la AS (SELECT doc_id AS id, rank FROM pool WHERE doc_id IN (SELECT vec_id FROM scoped) ORDER BY rank DESC, doc_id LIMIT 50),
l AS (SELECT id, rank AS score, row_number() OVER (ORDER BY rank DESC, id) AS l_rank FROM la),
u AS (SELECT coalesce(v.id, l.id) AS id, v_rank, l_rank, d, l.score,
      coalesce(1.0 / (60 + v_rank), 0)::DOUBLE + coalesce(1.0 / (60 + l_rank), 0)::DOUBLE AS rrf FROM v FULL JOIN l ON v.id = l.id),
r AS (SELECT *, row_number() OVER (ORDER BY coalesce(v_rank = 1, false) DESC, rrf DESC, coalesce(v_rank, 1000000000 + l_rank), id) AS rank FROM u)
SELECT {columns} FROM r JOIN documents x ON x.doc_id = r.id WHERE r.rank <= 10"""


_SHOWN = (
    "r.rank, x.doc_id AS document_id, x.lang AS collection, round(CASE WHEN v_rank IS NOT NULL THEN 1 - d ELSE r.score END, 6) AS score, "
    "CASE WHEN v_rank IS NOT NULL THEN 'cosine_similarity' ELSE 'lexical_rank' END AS score_kind"
)
_ALL_SHOWN = _SHOWN + ", x.source || '/' || x.doc_id || '.txt' AS source_path, round(d, 6) AS distance, sha256(x.text) AS content_sha256"
_HYBRID = _hybrid_sql("", _ALL_SHOWN)
_HYBRID_SCOPED = _hybrid_sql("AND d.lang IN ('en', 'fr')", _SHOWN)


def fusion_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest vectors and the 50 longest documents, fused; the latter lead."""
    c = corpus(spark, sf_dir)
    near = knn.nearest(c.vectors, first_vector(spark, sf_dir), 50)
    long = c.chunks.select("chunk_id", F.char_length("content").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(50)
    one = near.select(F.col("chunk_id").alias("document_id"), F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("rank"))
    two = long.select(F.col("chunk_id").alias("document_id"), F.row_number().over(Window.orderBy(F.desc("n"), "chunk_id")).alias("rank"))
    fused = fusion.combined(fusion.rrf(one, two), "lexical")
    return fused.select("document_id", "v_rank", "l_rank", F.round("rrf", 9).alias("rrf"), "rank")


_FUSION = f"""WITH {_Q}, s AS (SELECT vec_id, {_D["cosine"]} AS d FROM embeddings e, q WHERE vec_id IN (SELECT doc_id FROM documents)
ORDER BY d, vec_id LIMIT 50), t AS (SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC NULLS LAST, doc_id LIMIT 50),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS v_rank FROM s),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n DESC, doc_id) AS l_rank FROM t),
u AS (SELECT coalesce(v.id, l.id) AS id, v_rank, l_rank,
      coalesce(1.0 / (60 + v_rank), 0)::DOUBLE + coalesce(1.0 / (60 + l_rank), 0)::DOUBLE AS rrf FROM v FULL JOIN l ON v.id = l.id)
SELECT id AS document_id, v_rank, l_rank, round(rrf, 9) AS rrf,
       row_number() OVER (ORDER BY coalesce(l_rank = 1, false) DESC, rrf DESC, coalesce(v_rank, 1000000000 + l_rank), id) AS rank FROM u"""


def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest turn of each conversation, the first of several: one row a document."""
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.char_length("text"))
    best = fusion.first_per_key(turns, "conv_id", F.desc("n"), "turn")
    return best.select("conv_id", "turn", "role", "n")


_BEST_CHUNK = """SELECT conv_id, turn, role, n FROM (SELECT *, length(text) AS n,
row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1"""


def scores_explain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns never grow."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    return fusion.explains_order(turns, "conv_id", "turn", "n")


_EXPLAIN = """WITH s AS (SELECT conv_id, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, bool_and(coalesce(b >= n, true)) AS explained FROM s GROUP BY conv_id"""


def arms_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms of each collection, cut to five rows an arm and merged by score."""
    c = corpus(spark, sf_dir)
    q = F.array(*[F.lit(x) for x in first_vector(spark, sf_dir)])
    near = c.vectors.select("collection", "chunk_id", (1 - V.cosine_distance(F.col("embedding"), q)).alias("score"))
    long = c.chunks.join(c.vectors.select("chunk_id", "collection"), "chunk_id").select(
        "collection", "chunk_id", (F.char_length("content") / 1e6).alias("score")
    )
    both = fusion.both_arms(near, long)
    w = Window.partitionBy("collection", "arm").orderBy(F.desc("score"), "chunk_id")
    return (
        both.withColumn("pos", F.row_number().over(w))
        .where("pos <= 5")
        .select("collection", "arm", "pos", "chunk_id", F.round("score", 6).alias("score"))
    )


_ARMS = f"""WITH {_Q}, v AS (SELECT d.lang AS collection, e.vec_id AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS score, length(d.text) / 1e6 AS s2
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, q),
b AS (SELECT collection, 0 AS arm, chunk_id, score FROM v UNION ALL SELECT collection, 1, chunk_id, s2 FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY collection, arm ORDER BY score DESC, chunk_id) AS pos FROM b)
SELECT collection, arm, pos, chunk_id, round(score, 6) AS score FROM r WHERE pos <= 5"""


def revision_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfathom.plans.lifecycle_queries import revisions

    return searchable_revisions(revisions(spark, sf_dir)).select("collection", "id", "status")


QUERIES = {
    "knn_cosine": _knn("cosine"),
    "knn_l2": _knn("l2"),
    "knn_ip": _knn("ip"),
    "batch_knn": batch_knn,
    "vector_functions": vector_functions,
    "mean_pool": mean_pool,
    "canary_agreement": canary_agreement,
    "lexical_match": lexical_match,
    "lexical_top": lexical_top,
    "lexical_relaxed": lexical_relaxed,
    "rarity_probe": rarity_probe,
    "indexed_lexical_top": indexed_lexical_top,
    "indexed_best": indexed_best,
    "indexed_probe": indexed_probe,
    "proximity_top": proximity_top,
    "phrase_match": phrase_match,
    "postings": postings,
    "hybrid_search": hybrid_search,
    "hybrid_search_scoped": hybrid_search_scoped,
    "graph_search": graph_search,
    "batch_hybrid_search": batch_hybrid_search,
    "fusion_ranks": fusion_ranks,
    "best_chunk": best_chunk,
    "scores_explain_order": scores_explain_order,
    "arms_by_collection": arms_by_collection,
    "revision_choice": revision_choice,
}

ORACLES = {
    "knn_cosine": _knn_sql("cosine"),
    "knn_l2": _knn_sql("l2"),
    "knn_ip": _knn_sql("ip"),
    "batch_knn": _BATCH_KNN,
    "vector_functions": _VECTOR_FUNCTIONS,
    "mean_pool": _MEAN_POOL,
    "canary_agreement": _CANARY,
    "lexical_match": _LEXICAL_MATCH,
    "lexical_top": _lexical_top_sql(QUERY.split(), 3),
    "lexical_relaxed": _lexical_top_sql(RELAXED.split(), 3),
    "rarity_probe": _PROBE,
    "indexed_lexical_top": _lexical_top_sql(QUERY.split(), 3),
    "indexed_best": _best_sql(RELAXED.split(), 3, 20),
    "indexed_probe": _PROBE,
    "proximity_top": _PROXIMITY,
    "phrase_match": _PHRASE,
    "postings": _POSTINGS,
    "hybrid_search": _HYBRID,
    "hybrid_search_scoped": _HYBRID_SCOPED,
    "batch_hybrid_search": _BATCH_HYBRID.format(shown=_ALL_SHOWN),
    "fusion_ranks": _FUSION,
    "best_chunk": _BEST_CHUNK,
    "scores_explain_order": _EXPLAIN,
    "arms_by_collection": _ARMS,
}
