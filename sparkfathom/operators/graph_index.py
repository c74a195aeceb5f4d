"""Approximate nearest neighbours: a proximity graph in each shard of a vector table.

Vectors near each other share a shard (cells of k-means, large ones split by hash). A
shard is one row with its vectors and a graph of bounded degree, so a search reads
the shards whose centres are nearest, walks each graph best-first from its middle, and
moves its best rows only. With a filter the walk passes through rows that the filter
refuses and goes on until enough others are found; more shards are read until the page
is full.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.functions import vectors as V
from sparkfathom.operators import knn

#: Rows that a shard has on average at most, vectors that k-means is fitted on, cells, and bytes of a shard's vectors.
SHARD_ROWS, SAMPLE, MOST_CELLS, SHARD_BYTES = 4096, 50_000, 4096, 16 << 20

_SHARD = "shard long, ids binary, vectors binary, edges binary, starts binary, entry int, dimension int"


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows so that inner products and Euclidean distances rank as the metric does."""
    if metric != "cosine":
        return x
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _far(rows: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of prepared rows to a prepared vector, in the metric's own terms."""
    if metric == "l2":
        return np.sqrt(((rows - q) ** 2).sum(axis=1))
    products = rows @ q
    return -products if metric == "ip" else 1 - products


def build_graph(x: np.ndarray, metric: str, degree: int, candidates: int) -> tuple[list[np.ndarray], int]:
    """Neighbours of each row, and the row where walks begin.

    Of its ``candidates`` nearest rows a row keeps up to ``degree`` that are nearer to
    it than to those kept before; kept edges lead back too, up to twice the degree.
    Rows that no walk would reach get an edge from the nearest one that is reached.
    """
    n = len(x)
    middle = x.mean(axis=0)
    entry = int(np.argmin(((x - middle) ** 2).sum(axis=1)))
    squares = (x * x).sum(axis=1)
    edges: list[list[int]] = [[] for _ in range(n)]
    take = min(candidates, n - 1)
    for start in range(0, n, 512):
        block = x[start : start + 512]
        gaps = squares[None, :] - 2 * (block @ x.T) if metric != "ip" else -(block @ x.T)
        gaps[np.arange(len(block)), np.arange(start, start + len(block))] = np.inf
        if not take:
            continue
        near = np.argpartition(gaps, take - 1, axis=1)[:, :take]
        for r in range(len(block)):
            found = near[r][np.argsort(gaps[r][near[r]], kind="stable")]
            own = x[found]
            between = squares[found][:, None] + squares[found][None, :] - 2 * (own @ own.T)
            to_row = squares[start + r] + squares[found] - 2 * (own @ block[r])
            shadowed, kept = np.zeros(take, bool), []
            for c in range(take):
                if not shadowed[c]:
                    kept.append(int(found[c]))
                    if len(kept) == degree:
                        break
                    shadowed |= between[c] < to_row
            edges[start + r] = kept
    back: list[list[int]] = [list(e) for e in edges]
    for i, kept in enumerate(edges):
        for j in kept:
            if i not in back[j] and len(back[j]) < 2 * degree:
                back[j].append(i)
    seen = np.zeros(n, bool)

    def reach(first: int) -> None:
        open_, seen[first] = [first], True
        while open_:
            for j in back[open_.pop()]:
                if not seen[j]:
                    seen[j] = True
                    open_.append(j)

    reach(entry)
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        inside = np.flatnonzero(seen)
        back[int(inside[np.argmin(((x[inside] - x[lost]) ** 2).sum(axis=1))])].append(lost)
        reach(lost)
    return [np.array(e, np.int32) for e in back], entry


def walk(x: np.ndarray, edges: Callable[[int], np.ndarray], entry: int, q: np.ndarray, metric: str, width: int, k: int, allowed: np.ndarray | None):
    """``(distance, row)`` of rows found best-first with a beam of ``width``, nearest first.

    Only ``allowed`` rows are found. The walk ends once the nearest open row is farther
    than the beam's last; while fewer than ``k`` allowed rows are found it goes on.
    """
    seen = np.zeros(len(x), bool)
    seen[entry] = True
    first = float(_far(x[[entry]], q, metric)[0])
    open_, beam, found = [(first, entry)], [-first], []
    if allowed is None or allowed[entry]:
        found.append((first, entry))
    while open_:
        d, i = heapq.heappop(open_)
        if len(beam) >= width and d > -beam[0] and len(found) >= k:
            break
        fresh = edges(i)
        fresh = fresh[~seen[fresh]]
        if not len(fresh):
            continue
        seen[fresh] = True
        for gap, j in zip(_far(x[fresh], q, metric).tolist(), fresh.tolist(), strict=True):
            if len(beam) < width or gap < -beam[0] or len(found) < k:
                heapq.heappush(open_, (gap, j))
                ok = allowed is None or allowed[j]
                if ok:
                    found.append((gap, j))
                    heapq.heappush(beam, -gap)
                    if len(beam) > width:
                        heapq.heappop(beam)
    return sorted(found)[:width]


class GraphIndex(knn.ExactIndex):
    """A stored index; ``path`` holds its shards, their centres and a manifest.

    ``vectors`` has ``id_col`` (a long), ``vec_col`` and routing columns. Rows whose
    vector is null or holds a null take no part; vectors of several lengths are an
    error. The sample, the cells and a shard's rows have bounds of their own.
    """

    method = "graph"

    def __init__(
        self, vectors: DataFrame, path: str, metric: str = "cosine", degree: int = 24, candidates: int = 96, shard_rows: int = SHARD_ROWS,
        seed: int = 1, id_col: str = "chunk_id", vec_col: str = "embedding",
    ):
        if metric not in V.DISTANCES:
            raise ValueError(f"metric must be one of {sorted(V.DISTANCES)}, not {metric!r}")
        routes = [c for c in vectors.columns if c not in (id_col, vec_col)]
        usable = vectors.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda v: v.isNull()))
        sizes = usable.groupBy(F.size(vec_col).alias("d")).count().collect()
        if sum(1 for r in sizes if r["count"]) > 1:
            raise ValueError(f"vectors have several dimensions: {sorted(r['d'] for r in sizes)}")
        n, dimension = (sizes[0]["count"], sizes[0]["d"]) if sizes else (0, 1)
        rows = max(1, min(shard_rows, SHARD_BYTES // (8 * dimension)))
        cells = max(1, min(MOST_CELLS, math.ceil(n / rows)))
        named = usable.select(F.col(id_col).cast("long").alias("id"), V.doubles(F.col(vec_col)).alias("v"), F.struct(F.lit(0).alias("_"), *routes).alias("route"))
        featured = named.withColumn("__v", array_to_vector(F.col("v")))
        placed, centres = named.withColumn("cell", F.lit(0)), [[0.0] * dimension]
        if cells > 1:
            model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="__v", predictionCol="cell").fit(featured.orderBy(F.xxhash64("id")).limit(SAMPLE))
            placed, centres = model.transform(featured).drop("__v"), [c.tolist() for c in model.clusterCenters()]
        counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # MOST_CELLS rows at most
        parts = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, math.ceil(m / rows))]) if counts else F.lit(None)
        shard = F.col("cell").cast("long") * (1 << 32) + (F.pmod(F.xxhash64("id"), parts[F.col("cell")]) if counts else F.lit(0))
        kind = named.schema["route"].dataType.simpleString()

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            x = _prepared(np.stack(rows["v"].to_numpy()).astype(np.float64), metric)
            edges, entry = build_graph(x, metric, degree, candidates)
            starts = np.concatenate(([0], np.cumsum([len(e) for e in edges]))).astype(np.int32)
            return pd.DataFrame({
                "shard": [rows["shard"].iloc[0]], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(rows["v"].to_numpy()).astype(np.float64).tobytes()],
                "edges": [np.concatenate(edges).astype(np.int32).tobytes()], "starts": [starts.tobytes()], "entry": [entry], "dimension": [x.shape[1]], "routes": [rows["route"].tolist()],
            })

        made = placed.withColumn("shard", shard).select("id", "v", "route", "shard").groupBy("shard").applyInPandas(build, f"{_SHARD}, routes array<{kind}>")
        made.write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/shards")
        spark = vectors.sparkSession
        spark.createDataFrame([(c, centre, counts.get(c, 0)) for c, centre in enumerate(centres)], "cell int, centre array<double>, n long").write.mode("overwrite").parquet(f"{path}/cells")
        facts = {"method": "graph", "metric": metric, "degree": degree, "candidates": candidates, "shard_rows": rows, "cells": len(centres), "rows": n, "id_col": id_col}
        spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "manifest string").write.mode("overwrite").parquet(f"{path}/manifest")
        self._open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphIndex:
        """An index that was stored before."""
        made = cls.__new__(cls)
        made._open(spark, path)
        return made

    def _open(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
        self.id_col, self.metric = self.manifest["id_col"], self.manifest["metric"]
        self.shards = spark.read.parquet(f"{path}/shards")
        self.cells = [(r["cell"], np.array(r["centre"])) for r in spark.read.parquet(f"{path}/cells").where("n > 0").collect()]

    def search(
        self, query: list[float], k: int, metric: str | None = None, where: Callable[[Column], Column] | None = None, width: int = 64, probes: int = 8
    ) -> DataFrame:
        """``id_col, distance, score, score_kind`` of the ``k`` nearest rows found.

        ``where`` is given a row's routing columns as a struct. The beam is ``k`` rows
        wide at least. Cells are probed nearest first, and twice as many each time,
        until ``k`` rows pass or none is left. What is found is ``k`` rows.
        """
        if metric not in (None, self.metric):
            raise ValueError(f"the index ranks by {self.metric}, not by {metric}")
        width, q, found = knn.tuned_probes(self.method, width, k), np.array(query, np.float64), []
        own = _prepared(q[None, :], self.metric)[0]
        gap = (lambda c: -float(c @ q)) if self.metric == "ip" else lambda c: float(((c - (own if self.metric == "cosine" else q)) ** 2).sum())
        if self.metric == "cosine":
            order = [c for c, _ in sorted(((c, _prepared(m[None, :], "cosine")[0]) for c, m in self.cells), key=lambda x: gap(x[1]))]
        else:
            order = [c for c, _ in sorted(self.cells, key=lambda x: gap(x[1]))]
        looked = 0
        while looked < len(order) and (not looked or len(found) < k):
            found += self._probe(order[looked : looked + probes], own, k, where, width)
            looked, probes = looked + probes, probes * 2
        top = sorted(found)[:k]
        rows = self.spark.createDataFrame([(i, d) for d, i in top], f"{self.id_col} long, distance double")
        score, kind = V.score_of(self.metric, F.col("distance"))
        return rows.withColumns({"score": score, "score_kind": F.lit(kind)}).orderBy("distance", self.id_col)

    def _probe(self, cells: list[int], q: np.ndarray, k: int, where: Callable[[Column], Column] | None, width: int) -> list[tuple[float, int]]:
        """The ``k`` best of some cells, which come to the driver."""
        in_cell = F.lit(False)
        for c in cells:
            in_cell = in_cell | F.col("shard").between(c << 32, (c << 32) + (1 << 32) - 1)
        passes = F.lit(None).cast("array<boolean>") if where is None else F.transform("routes", lambda r: F.coalesce(where(r), F.lit(False)))
        metric = self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids = np.frombuffer(r["ids"], np.int64)
                    x = _prepared(np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dimension"]), metric)
                    flat, starts = np.frombuffer(r["edges"], np.int32), np.frombuffer(r["starts"], np.int32)
                    allowed = None if r["passes"] is None else np.array(r["passes"], bool)
                    if len(q) != r["dimension"]:
                        continue
                    hits = walk(x, lambda i: flat[starts[i] : starts[i + 1]], r["entry"], q, metric, width, k, allowed)
                    hits = sorted((d, int(ids[i])) for d, i in hits)[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([i for _, i in hits], pa.int64()), pa.array([d for d, _ in hits], pa.float64())], ["id", "distance"])

        columns = ["ids", "vectors", "edges", "starts", "entry", "dimension"]
        found = self.shards.where(in_cell).select(*columns, passes.alias("passes")).mapInArrow(run, "id long, distance double")
        return [(r["distance"], r["id"]) for r in found.orderBy("distance", "id").limit(k).collect()]
