"""Hybrid search: vector and lexical arms, typo fallback, routing and fusion."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.functions import validation
from sparkfathom.operators import batch_search, fusion, knn, lexical
from sparkfathom.operators.graph_index import GraphIndex
from sparkfathom.operators.lexical_index import LexicalIndex

#: Ranks of the revision states that may be searched.
SEARCHABLE = {"active": 3, "ready": 2, "building": 1}


@dataclass
class Corpus:
    """Tables of a search.

    ``documents`` has ``id, collection, source_path``; ``chunks`` ``chunk_id,
    document_id, content``; ``vectors`` ``chunk_id, embedding`` and the routing
    columns, ``collection`` among them. With an ``index`` the lexical arm reads that
    and no text.
    """

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    metric: str = "cosine"
    analyzer: str = "simple"
    index: LexicalIndex | None = None
    #: Searched in place of all vectors, where there is one revision only.
    vector_index: GraphIndex | None = None
    #: Columns of the vectors that tell revisions apart, each with arms of its own.
    by: tuple[str, ...] = ()


def searchable_revisions(revisions: DataFrame) -> DataFrame:
    """One revision a collection: active before ready before building, then the newest."""
    rank = F.lit(0)
    for status, value in SEARCHABLE.items():
        rank = F.when(F.col("status") == status, value).otherwise(rank)
    best = Window.partitionBy("collection").orderBy(F.desc("__rank"), F.desc("id"))
    return (
        revisions.withColumn("__rank", rank)
        .where("__rank > 0")
        .withColumn("__n", F.row_number().over(best))
        .where("__n = 1")
        .drop("__n", "__rank")
    )


def check_one_model(revisions: DataFrame) -> None:
    """Refuse a search over vectors of several embedding profiles."""
    groups = revisions.groupBy("embedding_profile_id").agg(F.array_sort(F.collect_set("collection")).alias("c")).collect()
    if len(groups) > 1:
        listed = "; ".join(f"profile {g['embedding_profile_id']}: {', '.join(g['c'])}" for g in groups)
        raise ValueError(f"collections are embedded with different models and cannot be searched together ({listed})")


def bounded(hits: DataFrame) -> DataFrame:
    """A top-k list as a local table: computed once, however often it is used.

    It has ``knn.MOST`` rows at most, and numbers only. Its size is known to the
    optimizer, which broadcasts it in the joins that follow.
    """
    return hits.sparkSession.createDataFrame(hits.limit(knn.MOST).toArrow(), hits.schema)


class Searcher:
    """Searches a corpus. The arms read one scope, so they agree on what exists.

    A corpus without ``by`` columns is one revision; over several, a query is a
    table of one for ``batch_search``. All matches of a query compete, or with a
    ``pool`` those of its smallest identifiers, where there is one revision only.
    """

    def __init__(self, corpus: Corpus, hybrid: bool = True, pool: int | None = None):
        self.corpus, self.hybrid, self.pool = corpus, hybrid, pool

    def scoped(self, collections: list[str] | None) -> DataFrame:
        vectors = self.corpus.vectors
        return vectors if collections is None else vectors.where(F.col("collection").isin(collections))

    def vector_arm(self, query: list[float], k: int, collections: list[str] | None) -> DataFrame:
        graph = self.corpus.vector_index
        if graph is not None:
            where = None if collections is None else lambda r: r["collection"].isin(collections)
            hits = graph.search(query, k, self.corpus.metric, where)
        else:
            hits = knn.nearest(self.scoped(collections), query, k, self.corpus.metric)
        placed = hits.withColumn("pos", F.row_number().over(Window.orderBy("distance", "chunk_id")))
        return bounded(placed.select("chunk_id", "pos", "score", "distance", "score_kind"))

    def lexical_arm(self, query: str, k: int, collections: list[str] | None, relaxed: bool = False) -> DataFrame:
        scoped, index = self.scoped(collections), self.corpus.index
        if index is not None:
            hits = index.lexical_top(query, k, scoped, relaxed, self.pool)
        else:
            hits = lexical.lexical_top(self.corpus.chunks, scoped, query, k, self.corpus.analyzer, relaxed, self.pool)
        placed = hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rank"), "chunk_id")))
        return bounded(
            placed.select(
                "chunk_id", "pos", F.col("rank").alias("score"), F.lit(None).cast("double").alias("distance"),
                F.lit("lexical_rank").alias("score_kind"),
            )
        )

    def _shown(self, hits: DataFrame) -> DataFrame:
        """Texts and paths of the few hits, which go to the scans as numbers to look for."""
        chunks = self.corpus.chunks.select("chunk_id", "document_id", "content")
        own = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in hits.select("chunk_id").collect()]))
        of = [r["document_id"] for r in own.select("document_id").distinct().collect()]
        documents = self.corpus.documents.select(F.col("id").alias("document_id"), "collection", "source_path").where(F.col("id").isin(of))
        return documents.join(F.broadcast(own.join(F.broadcast(hits), "chunk_id")), "document_id")

    def candidates(self, query: str, vector: list[float], top_k: int = 10, collections: list[str] | None = None):
        """Both arms before fusion; the lexical one relaxed if it finds nothing exactly."""
        arm, other = self._arms(query, vector, top_k, collections)
        return self._shown(arm), self._shown(other)

    def _arms(self, query: str, vector: list[float], top_k: int, collections: list[str] | None) -> tuple[DataFrame, DataFrame]:
        validation.check_query(query, top_k)
        k = knn.arm_limit(top_k)
        arm = self.vector_arm(vector, k, collections)
        if not self.hybrid:
            return arm, self.lexical_arm("", k, collections)
        exact = self.lexical_arm(query, k, collections)
        return arm, exact if not exact.isEmpty() else self.lexical_arm(query, k, collections, relaxed=True)

    def lexical_should_lead(self, query: str, collections: list[str] | None = None, most: int = lexical.RARE_DOCUMENTS) -> bool:
        """Whether the query is one word that few documents in scope hold."""
        if len(query.split()) != 1:
            return False
        scoped, index = self.scoped(collections), self.corpus.index
        rows = index.probe(query, scoped, 20 * most) if index else lexical.probe(self.corpus.chunks, scoped, query, 20 * most, self.corpus.analyzer)
        found = rows.first()
        return 0 < found["documents"] <= most

    def search(self, query: str, vector: list[float], top_k: int = 10, collections: list[str] | None = None) -> DataFrame:
        """``document_id, collection, source_path, content, score, distance, score_kind, rank``."""
        if self.corpus.by:
            validation.check_query(query, top_k)
            spark = self.corpus.vectors.sparkSession
            one = spark.createDataFrame([(0, query, [float(x) for x in vector])], "query_id long, query string, vector array<double>")
            # One query's arms are some rows a revision.
            local = lambda df: spark.createDataFrame(df.toArrow(), df.schema)
            return self.search_many(one, top_k, collections, local).drop("query_id")
        arm, other = self._arms(query, vector, top_k, collections)
        leads = not other.isEmpty() and not arm.isEmpty() and self.lexical_should_lead(query, collections)
        both = self._shown(arm.unionByName(other))
        found = fusion.merged(*fusion.split_arms(both), "lexical" if leads else "vector", top_k)
        return found.select(
            "document_id", "collection", "source_path", "content", "score", "distance", "score_kind", "rank"
        )

    def search_many(self, queries: DataFrame, top_k: int = 10, collections: list[str] | None = None, keep=None) -> DataFrame:
        """The ranked documents of every query of a table of ``query_id, query, vector``.

        ``keep`` stores intermediate tables; without it they may be made again.
        """
        corpus = replace(self.corpus, vectors=self.scoped(collections))
        return batch_search.search_many(corpus, queries, top_k, self.hybrid, keep=keep)
