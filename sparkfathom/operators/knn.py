"""Filtered nearest-neighbour search over a vector table.

The vector table carries its routing columns, so filters stand on the vector row
itself and reach the scan; texts and paths are joined to the k rows that remain.
``exact`` ranks everything that passes the filter. ``ivf`` probes a partitioned
table of k-means cells, nearest first, until enough rows pass; ``lsh`` hashes by
random projections; ``graph`` walks stored proximity graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.functions import vectors as V

#: An arm fetches so many times the wanted rows, up to the most.
OVERFETCH, MOST = 5, 50


def arm_limit(top_k: int) -> int:
    """Rows each arm fetches so that fusion can return ``top_k`` documents."""
    return min(top_k * OVERFETCH, MOST)


def scope(vectors: DataFrame, **routing) -> DataFrame:
    """Vectors of one revision: equality on the routing columns of the vector row."""
    for name, value in routing.items():
        vectors = vectors.where(F.col(name) == F.lit(value))
    return vectors


def with_distance(vectors: DataFrame, query: list[float], metric: str, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with ``distance``; the query is one constant array."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", V.distance(metric, F.col(vec_col), q))


def nearest(
    vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "chunk_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows with ``distance``, ``score`` and ``score_kind``.

    Ties go to the smaller identifier. Each task keeps its own k best, so only
    those reach the driver side of ``TakeOrderedAndProject``.
    """
    score, kind = V.score_of(metric, F.col("distance"))
    ranked = with_distance(vectors, query, metric, vec_col).drop(vec_col)
    top = ranked.orderBy("distance", id_col).limit(k)
    return top.withColumns({"score": score, "score_kind": F.lit(kind)})


def nearest_with_text(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The hits with their chunk's content and their document's path."""
    return (
        hits.join(chunks.select("chunk_id", "document_id", "content"), "chunk_id")
        .join(documents.select(F.col("id").alias("document_id"), "source_path"), "document_id")
    )


def nearest_by_group(
    vectors: DataFrame, queries: DataFrame, by: str, k: int, metric: str = "cosine", id_col: str = "chunk_id",
    vec_col: str = "embedding", query_col: str = "query",
) -> DataFrame:
    """The ``k`` nearest rows of each group to the queries of that group.

    ``queries`` has ``by``, ``query_id`` and the vector; a group's queries meet
    its rows by an equi-join, and the limit is applied before rows are gathered.
    """
    met = vectors.join(queries, by)
    ranked = met.withColumn("distance", V.distance(metric, F.col(vec_col), F.col(query_col)))
    best = Window.partitionBy(by, "query_id").orderBy("distance", id_col)
    return (
        ranked.drop(vec_col, query_col)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
    )


def tuned_probes(method: str, configured: int, k: int) -> int:
    """How much of an index to look at: never less than the rows wanted."""
    return 0 if method == "exact" else max(configured, k)


class ExactIndex:
    """No index: every row in scope is ranked."""

    method = "exact"

    def __init__(self, vectors: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding"):
        self.vectors, self.id_col, self.vec_col = vectors, id_col, vec_col

    def search(self, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
        rows = self.vectors if where is None else self.vectors.where(where)
        return nearest(rows, query, k, metric, self.id_col, self.vec_col)


class IvfIndex(ExactIndex):
    """K-means cells stored as partitions, probed nearest first.

    ``path`` holds the table; a search reads the partitions it probes and widens
    until ``k`` rows pass its filter, so a narrow filter still fills a page.
    """

    method = "ivf"

    def __init__(self, vectors: DataFrame, path: str, cells: int = 16, seed: int = 1, sample: int = 100_000,
                 id_col: str = "chunk_id", vec_col: str = "embedding"):
        spark = vectors.sparkSession
        featured = vectors.withColumn("__v", array_to_vector(V.doubles(F.col(vec_col))))
        chosen = featured.orderBy(F.xxhash64(id_col)).limit(sample)
        model = KMeans(k=cells, seed=seed, featuresCol="__v", predictionCol="cell").fit(chosen)
        self.centers = [c.tolist() for c in model.clusterCenters()]
        model.transform(featured).drop("__v").write.mode("overwrite").partitionBy("cell").parquet(path)
        super().__init__(spark.read.parquet(path), id_col, vec_col)

    def search(self, query, k, metric="cosine", where=None, probes: int = 4) -> DataFrame:
        order = sorted(range(len(self.centers)), key=lambda c: sum((a - b) ** 2 for a, b in zip(self.centers[c], query, strict=True)))
        while True:
            rows = self.vectors.where(F.col("cell").isin(order[:probes])).drop("cell")
            rows = rows if where is None else rows.where(where)
            if probes >= len(order) or rows.limit(k).count() >= k:
                return nearest(rows, query, k, metric, self.id_col, self.vec_col)
            probes *= 2


class LshIndex(ExactIndex):
    """Random projections of Euclidean space; candidates are ranked exactly."""

    method = "lsh"

    def __init__(self, vectors: DataFrame, width: float = 2.0, tables: int = 8, seed: int = 1,
                 id_col: str = "chunk_id", vec_col: str = "embedding"):
        super().__init__(vectors, id_col, vec_col)
        lsh = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=width, numHashTables=tables, seed=seed)
        self.hashed = vectors.withColumn("__v", array_to_vector(V.doubles(F.col(vec_col))))
        self.model = lsh.fit(self.hashed)

    def search(self, query, k, metric="cosine", where=None, candidates: int = 20) -> DataFrame:
        from pyspark.ml.linalg import Vectors

        rows = self.hashed if where is None else self.hashed.where(where)
        near = self.model.approxNearestNeighbors(rows, Vectors.dense(query), k * candidates)
        return nearest(near.drop("__v", "__h", "distCol"), query, k, metric, self.id_col, self.vec_col)


#: Index strategies by method.
STRATEGIES: dict[str, Callable[..., ExactIndex]] = {"exact": ExactIndex, "ivf": IvfIndex, "lsh": LshIndex}


def build_index(method: str, vectors: DataFrame, **options) -> ExactIndex:
    from sparkfathom.operators import graph_index  # builds on this module

    STRATEGIES["graph"] = graph_index.GraphIndex
    if method not in STRATEGIES:
        raise ValueError(f"index method must be one of {sorted(STRATEGIES)}, not {method!r}")
    return STRATEGIES[method](vectors, **options)
