"""Hybrid search for a table of queries: both arms, fallback, routing and fusion in one go.

``queries`` has ``query_id``, ``query`` and ``vector``. An arm is cut for each query
and revision, a revision being one value of the corpus's ``by`` columns; the lists
of all revisions are merged by score before they are fused, so no revision can push
another out of an arm. The arms are one table, made once for all that is judged on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.functions import analysis
from sparkfathom.functions import vectors as V
from sparkfathom.operators import fusion, knn, lexical
from sparkfathom.operators.lexical_index import contribution

#: Bytes of query vectors that one pass over the vectors compares with.
PASS_BYTES = 32 << 20

#: Terms of queries up to which their table goes to the postings; more are met by an exchange.
BROADCAST_TERMS = 200_000


def _distances(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of rows (first axis) to queries, as the column functions define them."""
    if metric == "l2":
        return np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in queries], axis=1)
    products = rows @ queries.T
    if metric == "ip":
        return -products
    sizes = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return 1 - np.divide(products, sizes, out=np.zeros_like(products), where=sizes > 0)


def _best(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest distances, ties to smaller identifiers."""
    if len(distance) > 4 * k:
        near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        return near[np.lexsort((ids[near], distance[near]))[:k]]
    return np.lexsort((ids, distance))[:k]


def vector_arms(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, by, chunk_id, distance``: the ``k`` nearest rows for each query and revision.

    The stated queries go to the tasks in blocks of ``PASS_BYTES``; each task keeps
    its own best, so ``k`` rows a query, revision and task are moved. Rows whose
    vector is null, holds a null, or has another length than a query take no part.
    """
    if metric not in V.DISTANCES:
        raise ValueError(f"metric must be one of {sorted(V.DISTANCES)}, not {metric!r}")
    asked = queries.where("vector is not null").select("query_id", V.doubles(F.col("vector")).alias("vector"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    passes = max(1, -(-(size["n"] * (size["d"] or 0) * 8) // PASS_BYTES))
    given = vectors.where("embedding is not null and not exists(embedding, x -> x is null)").select(*by, "chunk_id", V.doubles(F.col("embedding")).alias("embedding"))
    kinds = ", ".join(["query_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*by).schema), "chunk_id long, distance double"])

    def one_pass(i: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).collect()
        named = [(r["query_id"], np.array(r["vector"])) for r in rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                lists = batch.column(len(by) + 1)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(lengths)))
                routes = list(zip(*(c.to_pylist() for c in batch.columns[: len(by)]), strict=True)) if by else [()] * batch.num_rows
                ids = batch.column(len(by)).to_numpy()
                places: dict[tuple, list[int]] = {}
                for p, route in enumerate(routes):
                    places.setdefault((route, int(lengths[p])), []).append(p)
                for (route, d), at in places.items():
                    own = [j for j, (_, v) in enumerate(named) if len(v) == d]
                    if not own:
                        continue
                    at = np.array(at)
                    x = flat[starts[at][:, None] + np.arange(d)]
                    # Rounded, so that equal vectors tie wherever they stand in a block.
                    dist = np.round(_distances(metric, x, np.stack([named[j][1] for j in own])), 12)
                    for c, j in enumerate(own):
                        before = held.setdefault((route, j), (np.empty(0), np.empty(0, np.int64)))
                        both, who = np.concatenate((before[0], dist[:, c])), np.concatenate((before[1], ids[at]))
                        top = _best(both, who, k)
                        held[route, j] = both[top], who[top]
            for (route, j), (dist, who) in held.items():
                n = len(dist)
                columns = [pa.array([named[j][0]] * n, pa.int64()), *(pa.array([r] * n) for r in route), pa.array(who), pa.array(dist)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", *by, "chunk_id", "distance"])

        return given.mapInArrow(run, kinds)

    found = one_pass(0)
    for i in range(1, passes):
        found = found.unionByName(one_pass(i))
    w = Window.partitionBy("query_id", *by).orderBy("distance", "chunk_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def query_terms(queries: DataFrame, analyzer: str) -> DataFrame:
    """``query_id, term, n_terms, relaxed``: distinct terms, and how many a relaxed match needs."""
    found = queries.select("query_id", F.array_distinct(analysis.lexemes(F.coalesce("query", F.lit("")), analyzer)).alias("terms"))
    n = F.size("terms")
    some = F.greatest(F.lit(1), F.ceil(F.lit(lexical.RELAXED_SHARE) * n - 1e-9)).cast("int")
    relaxed = F.when(n <= lexical.RELAXED_TERMS, some)
    return found.select("query_id", n.alias("n_terms"), relaxed.alias("relaxed"), F.explode("terms").alias("term"))


def _postings(corpus, terms: DataFrame) -> tuple[DataFrame, DataFrame, int, float]:
    """``term, id, doc, length, tf`` of the terms, from the index or the texts; ``term, df``; chunks and mean length."""
    index = corpus.index
    if index is not None and index.segments():
        rows = index.segments()
        n, tokens = sum(r["chunks"] for r in rows), sum(r["tokens"] for r in rows)
        blocks = index.searched().join(terms, "term", "left_semi")
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        return blocks.select("term", F.inline(F.arrays_zip("id", "doc", "length", "tf"))), df, n, tokens / max(n, 1)
    text = F.coalesce("content", F.lit(""))
    words = corpus.chunks.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("doc"), F.explode(F.array(analysis.lexemes(text, corpus.analyzer))).alias("words"))
    facts = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("m")).first()
    each = words.select("id", "doc", F.size("words").alias("length"), F.explode("words").alias("term"))
    counted = each.join(terms, "term", "left_semi").groupBy("term", "id").agg(F.first("doc").alias("doc"), F.first("length").alias("length"), F.count(F.lit(1)).cast("int").alias("tf"))
    return counted, counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), facts["n"], facts["m"] or 0.0


def lexical_matches(corpus, queries: DataFrame, relaxed: bool = False) -> DataFrame:
    """``query_id, id, doc, rank``: for each query all of its matches."""
    asked = query_terms(queries, corpus.analyzer)
    n_asked = asked.count()
    if not n_asked:  # nothing is read for no words
        return queries.sparkSession.createDataFrame([], "query_id long, id long, doc long, matched long, need int, rank double")
    hint = F.broadcast if n_asked <= BROADCAST_TERMS else (lambda rows: rows)
    rows, df, n, mean = _postings(corpus, hint(asked.select("term").distinct()))
    weighted = asked.join(df, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    met = rows.join(hint(weighted), "term").groupBy("query_id", "id").agg(
        F.first("doc").alias("doc"), F.count(F.lit(1)).alias("matched"), F.first("relaxed" if relaxed else "n_terms").alias("need"),
        F.round(F.sum(contribution(F.col("tf"), F.col("length"), F.col("idf"), mean)), 9).alias("rank"),
    )
    return met.where("matched >= need")


def _cut(matches: DataFrame, scoped: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """The ``k`` best matches in scope for each query and revision."""
    seen = matches.select("query_id", F.col("id").alias("chunk_id"), "rank").join(scoped.select("chunk_id", *by), "chunk_id")
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("rank"), "chunk_id")
    return seen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def leading(corpus, queries: DataFrame, scoped: DataFrame, most: int = lexical.RARE_DOCUMENTS) -> DataFrame:
    """``query_id`` of queries of one word that few documents in scope hold.

    As the probe of a single query has it: below the cap of the sample documents
    in scope count, at the cap every sampled one.
    """
    cap = 20 * most
    single = queries.where(F.size(F.split(F.trim(F.regexp_replace("query", r"\s+", " ")), " ")) == 1)
    w = Window.partitionBy("query_id").orderBy("id")
    sample = lexical_matches(corpus, single).withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    marked = sample.join(scoped.select(F.col("chunk_id").alias("id"), F.lit(True).alias("inside")).distinct(), "id", "left")
    seen = marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_distinct(F.when(F.col("inside"), F.col("doc"))).alias("inside"), F.count_distinct("doc").alias("all")
    )
    documents = F.when(F.col("sampled") < cap, F.col("inside")).otherwise(F.col("all"))
    return seen.where(documents.between(1, most)).select("query_id")


def arms(corpus, queries: DataFrame, top_k: int = 10, hybrid: bool = True, keep=None) -> DataFrame:
    """``query_id, by, arm, chunk_id, score, distance, score_kind, pos, leads``: all candidates.

    Arm 0 is the vector arm, 1 the lexical one, relaxed for queries that match
    nothing exactly. ``pos`` numbers an arm over all revisions by score. ``keep``
    writes a table and reads it back: candidates are few, ``top_k`` times five a
    query, revision and arm. Matches are not kept, as they grow with the chunks.
    """
    keep = keep or (lambda df: df)
    by, k, scoped = tuple(corpus.by), knn.arm_limit(top_k), corpus.vectors
    score, kind = V.score_of(corpus.metric, F.col("distance"))
    near = vector_arms(scoped, queries, k, corpus.metric, by).withColumns({"arm": F.lit(0), "score": score, "score_kind": F.lit(kind), "leads": F.lit(False)})
    columns = ["query_id", *by, "arm", "chunk_id", "score", "distance", "score_kind", "place", "leads"]
    found = near.select(*columns)
    if hybrid:
        exact = keep(_cut(lexical_matches(corpus, queries), scoped, k, by))
        left = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
        relaxed = _cut(lexical_matches(corpus, left, relaxed=True), scoped, k, by)
        ahead = leading(corpus, queries, scoped).withColumn("leads", F.lit(True))
        words = exact.unionByName(relaxed).join(ahead, "query_id", "left").withColumns(
            {"arm": F.lit(1), "score": F.col("rank"), "distance": F.lit(None).cast("double"), "score_kind": F.lit("lexical_rank"), "leads": F.coalesce("leads", F.lit(False))}
        )
        found = found.unionByName(words.select(*columns))
    w = Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), *by, "place")
    return keep(found.withColumn("pos", F.row_number().over(w)).drop("place"))


def search_many(corpus, queries: DataFrame, top_k: int = 10, hybrid: bool = True, candidates: DataFrame | None = None, keep=None) -> DataFrame:
    """``query_id, document_id, collection, source_path, content, score, distance, score_kind, rank``.

    ``candidates`` may be a table that ``arms`` made before. A query without
    candidates has no rows; queries are told apart by ``query_id`` alone.
    """
    found = arms(corpus, queries, top_k, hybrid, keep) if candidates is None else candidates
    placed = found.join(corpus.chunks.select("chunk_id", "document_id"), "chunk_id")
    top = fusion.merged_many(placed, "query_id", top_k)
    shown = top.select("query_id", "document_id", "chunk_id", "score", "distance", "score_kind", "rank")
    texts = corpus.chunks.select("chunk_id", "content").join(shown, "chunk_id")
    documents = corpus.documents.select(F.col("id").alias("document_id"), "collection", "source_path")
    return documents.join(texts, "document_id").select("query_id", "document_id", "collection", "source_path", "content", "score", "distance", "score_kind", "rank")
