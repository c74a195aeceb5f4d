"""Fusion of a vector and a lexical ranking, document by document.

Reciprocal rank fusion over each document's best chunk; one arm, chosen by
routing, owns the first place. Order keys reproduce a stable sort: documents of
the vector ranking come first among equals, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the constant of reciprocal rank fusion.
K = 60

LEADS = ("vector", "lexical")


def first_per_key(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def document_ranks(arm: DataFrame, pos_col: str = "pos", key: str = "document_id") -> DataFrame:
    """``key, rank``: documents by their best position, renumbered from 1.

    An arm is a top-k list, so one window over it is bounded by what was fetched.
    """
    best = arm.groupBy(key).agg(F.min(pos_col).alias("__pos"))
    return best.select(key, F.row_number().over(Window.orderBy("__pos")).alias("rank"))


def rrf(vector: DataFrame, lexical: DataFrame, key: str = "document_id", k: int = K) -> DataFrame:
    """``key, v_rank, l_rank, rrf`` of ranked arms; the vector addend comes first."""
    v = vector.select(key, F.col("rank").alias("v_rank"))
    l = lexical.select(key, F.col("rank").alias("l_rank"))  # noqa: E741
    share = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return v.join(l, key, "full").withColumn("rrf", share("v_rank") + share("l_rank"))


def combined(fused: DataFrame, lead: str = "vector", key: str = "document_id") -> DataFrame:
    """``fused`` with ``rank``: the leading arm's first document, then by fusion.

    An empty leading arm leaves the fused order as it is.
    """
    if lead not in LEADS:
        raise ValueError(f"lead must be 'vector' or 'lexical', not {lead!r}")
    own = F.col("v_rank" if lead == "vector" else "l_rank")
    order = Window.orderBy(
        F.coalesce(own == 1, F.lit(False)).desc(), F.desc("rrf"), F.coalesce("v_rank", F.lit(10**9) + F.col("l_rank")), key
    )
    return fused.withColumn("rank", F.row_number().over(order))


def both_arms(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """One list of candidates, each row with the arm that found it."""
    tagged = vector.withColumn("arm", F.lit(0))
    return tagged.unionByName(lexical.withColumn("arm", F.lit(1)), allowMissingColumns=True)


def split_arms(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vector rows and lexical rows, told apart by their kind of score."""
    is_lexical = F.col("score_kind") == "lexical_rank"
    return candidates.where(~is_lexical), candidates.where(is_lexical)


def merged(vector: DataFrame, lexical: DataFrame, lead: str, top_k: int) -> DataFrame:
    """One row a document: its best chunk, the vector row if both arms found it.

    Arms have ``document_id`` and ``pos`` besides what is shown; the result is
    cut to ``top_k`` documents and numbered.
    """
    fused = combined(rrf(document_ranks(vector), document_ranks(lexical)), lead)
    shown = first_per_key(both_arms(vector, lexical), "document_id", "arm", "pos").drop("pos", "arm")
    top = fused.select("document_id", "rank").where(F.col("rank") <= top_k)
    return shown.join(F.broadcast(top), "document_id")


def merged_many(candidates: DataFrame, by: str, top_k: int, k: int = K) -> DataFrame:
    """``merged`` for many lists at once: one row for each value of ``by`` and document.

    ``candidates`` has ``document_id, arm, pos`` and ``leads``: whether the lexical
    arm owns the first place, if it found anything and the vector arm did too.
    """
    best = candidates.groupBy(by, "arm", "document_id").agg(F.min("pos").alias("pos"), F.bool_or("leads").alias("leads"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(by, "arm").orderBy("pos")))
    place = lambda arm: F.min(F.when(F.col("arm") == arm, F.col("rank")))
    fused = ranked.groupBy(by, "document_id").agg(place(0).alias("v_rank"), place(1).alias("l_rank"), F.bool_or("leads").alias("leads"))
    share = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    every = Window.partitionBy(by)
    both = F.max(F.col("v_rank").isNotNull()).over(every) & F.max("leads").over(every)
    fused = fused.withColumn("first", F.when(both, F.col("l_rank")).otherwise(F.col("v_rank")) == 1).withColumn("rrf", share("v_rank") + share("l_rank"))
    order = Window.partitionBy(by).orderBy(
        F.coalesce("first", F.lit(False)).desc(), F.desc("rrf"), F.coalesce("v_rank", F.lit(10**9) + F.col("l_rank")), "document_id"
    )
    top = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(by, "document_id", "rank")
    shown = candidates.drop("rank").withColumn("__n", F.row_number().over(Window.partitionBy(by, "document_id").orderBy("arm", "pos")))
    return shown.where("__n = 1").drop("__n").join(top, [by, "document_id"])


def explains_order(rows: DataFrame, by: str, order: str, score: str) -> DataFrame:
    """``by, explained``: whether scores never rise along each list."""
    w = Window.partitionBy(by).orderBy(order)
    steps = rows.withColumn("__before", F.lag(score).over(w))
    return steps.groupBy(by).agg(
        F.bool_and(F.coalesce(F.col("__before") >= F.col(score), F.lit(True))).alias("explained")
    )
