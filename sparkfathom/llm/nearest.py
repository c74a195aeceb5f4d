"""Approximate nearest neighbours by inner product with adaptive dimension scans.

Vectors get one more component that makes all norms equal, which turns the
largest inner product into the smallest distance; then they are rotated at
random and split over the lists of a k-means partition. Equal vectors are one
class with its smallest identifiers, of which a result can need ``k + 1`` only.

A query probes lists in order of the neighbours that a model expects in them
(their rows around the centroid as a normal cloud), until at most ``MISSED`` of
its ``k`` are expected elsewhere. In each probed list, distances grow by blocks
of rotated dimensions; after each block a candidate is dropped once a hypothesis
test on its partial distance says that it is beyond the current k-th. What is
left is scored exactly, in double precision, on the original vectors.

Lists are cut into tiles of bounded size, and so are the queries of a list, so
one crowded list never meets one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.llm import shared

#: Bounds of the index: lists, and sampled vectors for each that k-means sees.
MAX_LISTS, SAMPLES_PER_LIST, ROUNDS, SEED = 4096, 64, 10, 5

#: Share of the k neighbours that may be expected in lists that are not probed.
MISSED = 0.02

#: Rotated dimensions in a block, and the test's tolerance.
STEP, EPSILON = 16, 2.1

#: Vectors of a list and queries of a list that meet in one task.
TILE, QUERIES = 8192, 2048

#: Queries that are compared with a tile at a time, to bound memory.
AT_A_TIME = 128


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of a standard normal, by a polynomial with error below 1e-7."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-0.5 * a * a) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, upper, 1 - upper)


@dataclass
class Index:
    """Rotation, centroids and, for each list, its rows and spread."""

    norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    rows: np.ndarray
    spread: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors of equal norm, rotated."""
        last = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.hstack([x, last[:, None]]) @ self.rotation

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation

    def nearest_list(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and its squared distance from the centroid."""
        far = (lifted * lifted).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * lifted @ self.centroids.T
        best = far.argmin(1)
        return best, np.maximum(far[np.arange(len(best)), best], 0)

    def probes(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """The lists that each query must see."""
        out = []
        for one in self.lift_query(q):
            length = max(np.linalg.norm(one), 1e-12)
            middle, scale = self.centroids @ one, np.maximum(self.spread * length, 1e-9 * self.norm * length)
            low, high = float((middle - 12 * scale).min()), float((middle + 12 * scale).max())
            for _ in range(40):
                cut = (low + high) / 2
                if (self.rows * normal_tail((cut - middle) / scale)).sum() > k:
                    low = cut
                else:
                    high = cut
            hits = self.rows * normal_tail((low - middle) / scale)
            order = np.argsort(-hits, kind="stable")
            order = order[self.rows[order] > 0]
            after = hits.sum() - np.cumsum(hits[order])
            enough = int(np.searchsorted(-after, -MISSED * k)) + 1
            held = int(np.searchsorted(np.cumsum(self.rows[order]), 2 * k)) + 1
            out.append(order[: max(enough, held)])
        return out


def fit(sample: np.ndarray, norm: float, n_lists: int) -> Index:
    """Random rotation and k-means centroids of a sample; reproducible."""
    rng = np.random.default_rng(SEED)
    size = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.normal(size=(size, size)))
    index = Index(norm, rotation, np.empty((0, size)), np.zeros(n_lists), np.zeros(n_lists))
    lifted = index.lift(sample)
    index.centroids = lifted[rng.choice(len(lifted), n_lists, replace=len(lifted) < n_lists)]
    for _ in range(ROUNDS):
        owner, _ = index.nearest_list(lifted)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, owner, lifted)
        counts = np.bincount(owner, minlength=n_lists)
        index.centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], index.centroids)
    return index


def scan(queries: np.ndarray, lifted_queries: np.ndarray, vectors: np.ndarray, lifted: np.ndarray, ids: np.ndarray, k: int):
    """For each query the ``k`` best of a tile: positions and exact inner products.

    Partial distances grow block by block; ``alive`` pairs pass every test.
    """
    n, size = len(vectors), lifted.shape[1]
    for at in range(0, len(queries), AT_A_TIME):
        q, lq = queries[at : at + AT_A_TIME], lifted_queries[at : at + AT_A_TIME]
        part, alive, limit = np.zeros((len(q), n)), np.ones((len(q), n), bool), np.full(len(q), np.inf)
        for start in range(0, size, STEP):
            end = min(start + STEP, size)
            a, b = lq[:, start:end], lifted[:, start:end]
            if alive.mean() > 0.2:
                part += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
            else:
                i, j = np.nonzero(alive)
                part[i, j] += ((a[i] - b[j]) ** 2).sum(1)
            if start == 0 and n > k:
                # Exact distances of the k that look best so far bound the k-th.
                first = np.argpartition(part, k - 1, axis=1)[:, :k]
                limit = ((lq[:, None, :] - lifted[first]) ** 2).sum(2).max(1)
            if end < size and n > k:
                alive &= part <= (limit * (1 + EPSILON / np.sqrt(end)) ** 2 * end / size)[:, None]
        for i in range(len(q)):
            found = np.nonzero(alive[i] & (part[i] <= limit[i] + 1e-9 * (1 + abs(limit[i]))))[0] if n > k else np.arange(n)
            score = (vectors[found] * q[i]).sum(1)
            best = np.lexsort((ids[found], -score))[:k]
            yield at + i, found[best], score[best]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(ident, v)`` of the rows that take part; ``v`` is in double precision.

    Null identifiers, null, zero and non-finite vectors, and those whose length
    is not the most common one, take no part.
    """
    v = vectors[vec_col].cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(vectors[id_col].cast("long").alias("ident"), v.alias("v")).where(
        F.col("ident").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def unpack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, ident, score)``: the k nearest of each query.

    Queries are the rows whose identifier is divisible by ``every``; candidates
    are all rows but those of the query's own identifier. Nearest is the largest
    inner product, ties to the smaller identifier; fewer candidates give fewer
    rows. Repeated rows are candidates once for each. An empty table, or one
    without a vector that takes part, gives an empty result.
    """
    spark = vectors.sparkSession
    shared.modest_batches(spark)
    rows = valid(vectors, id_col, vec_col)
    first = Window.partitionBy("v").orderBy("ident")
    classes = shared.materialise(
        rows.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= k + 1)
        .groupBy("v")
        .agg(F.min("ident").alias("class"), F.sort_array(F.collect_list("ident")).alias("ids")),
        "ann-classes",
    )
    stats = classes.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    total = stats["n"]
    empty = "query_id long, rank int, ident long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    n_lists = min(MAX_LISTS, max(1, round(total**0.5 / 4)))
    sample = (
        classes.orderBy(F.xxhash64("class"), "class").limit(min(total, max(1024, SAMPLES_PER_LIST * n_lists))).select("v")
    )
    index = fit(unpack(sample.toPandas()["v"]), float(stats["square"]) ** 0.5, n_lists)
    bare = spark.sparkContext.broadcast(index)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                owner, far = bare.value.nearest_list(bare.value.lift(unpack(frame["v"])))
                yield frame.assign(list=owner.astype("int32"), far=far)

    assigned = shared.materialise(
        classes.mapInPandas(assign, "v array<double>, class long, ids array<long>, list int, far double"), "ann-lists"
    )
    for line in assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("far").alias("far")).collect():
        index.rows[line["list"]] = line["n"]
        index.spread[line["list"]] = (line["far"] / index.centroids.shape[1]) ** 0.5
    full = spark.sparkContext.broadcast(index)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                lists = full.value.probes(unpack(frame["v"]), k + 1)
                yield frame.assign(lists=[x.astype("int32") for x in lists])

    asked = rows.where(F.col("ident") % every == 0).join(classes.select("v", "class"), "v")
    queries = shared.materialise(asked.select(F.col("ident").alias("query_id"), "class").distinct(), "ann-queries")
    probed = shared.materialise(
        classes.join(queries.select("class").distinct(), "class", "left_semi")
        .select("class", "v")
        .mapInPandas(probe, "class long, v array<double>, lists array<int>"),
        "ann-probes",
    )
    # Tiles of each list: n_lists lines at most.
    asks = {r["list"]: r["n"] for r in probed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles = spark.createDataFrame(
        [(i, -(-int(n) // TILE), -(-asks.get(i, 0) // QUERIES)) for i, n in enumerate(index.rows)], "list int, subs int, q_subs int"
    ).where("subs > 0 and q_subs > 0")
    base = (
        assigned.join(F.broadcast(tiles), "list")
        .withColumn("sub", F.pmod(F.xxhash64("class"), "subs").cast("int"))
        .withColumn("q_sub", F.explode(F.sequence(F.lit(0), F.col("q_subs") - 1)))
        .select("list", "sub", "q_sub", "class", "v")
    )
    asking = (
        probed.select("class", "v", F.explode("lists").alias("list"))
        .join(F.broadcast(tiles), "list")
        .withColumn("q_sub", F.pmod(F.xxhash64("class"), "q_subs").cast("int"))
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .select("list", "sub", "q_sub", "class", "v")
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "class": [], "score": []}
        if len(left) and len(right):
            x, q, ids = unpack(left["v"]), unpack(right["v"]), left["class"].to_numpy()
            asked_by = right["class"].to_numpy()
            for i, found, score in scan(q, full.value.lift_query(q), x, full.value.lift(x), ids, k + 1):
                out["query"].append(np.full(len(found), asked_by[i]))
                out["class"].append(ids[found])
                out["score"].append(score)
        kinds = {"query": np.int64, "class": np.int64, "score": np.float64}
        return pd.DataFrame({c: np.concatenate([*v, np.empty(0, kinds[c])]).astype(kinds[c]) for c, v in out.items()})

    keys = ["list", "sub", "q_sub"]
    scored = base.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(compare, "query long, class long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    top = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    # From classes to rows: each class stands for its smallest identifiers.
    named = top.join(assigned.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("ident"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "ident")
    per_class = (
        named.withColumn("n", F.row_number().over(nearest))
        .where(F.col("n") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("n", "ident", "score"))).alias("found"))
    )
    own = lambda s: s["ident"] != F.col("query_id")
    return (
        queries.join(per_class, queries["class"] == per_class["query"])
        .select("query_id", F.slice(F.filter("found", own), 1, k).alias("found"))
        .select("query_id", F.posexplode("found").alias("at", "s"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "s.ident", "s.score")
    )
