"""Pairs of texts that share most of their trigrams, without comparing all pairs.

Two sets of m and n trigrams with similarity t or more share t (m + n) / (1 + t) of
them at least. With the trigrams of each text in one order, the rarest first, such a
pair shares one among the first few of either, so only these prefixes are indexed and
probed; sizes and then full sets decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfathom.functions import text as T


def trigram_sets(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, grams, n``: distinct trigrams of each text; texts without any are left out."""
    made = rows.select(F.col(id_col).alias("id"), F.explode(F.array(F.array_distinct(T.trigrams(F.coalesce(F.col(text_col), F.lit("")))))).alias("grams"))
    return made.select("id", "grams", F.size("grams").alias("n")).where("n > 0")


def prefixes(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """``id, gram, place, n``: the rarest trigrams of each set that a similar set must touch."""
    each = sets.select("id", "n", F.explode("grams").alias("gram")).join(frequency, "gram", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")))
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    ordered = each.groupBy("id", "n").agg(order.alias("o"))
    return ordered.select("id", "n", F.posexplode(F.slice("o", 1, kept)).alias("place", "g")).select("id", "n", "place", F.col("g.gram").alias("gram"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``left_id, right_id, similarity``: all pairs of similarity ``threshold`` or more.

    Identifiers are unique on each side. Texts without trigrams match nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    a, b = trigram_sets(left, id_col, text_col), trigram_sets(right, id_col, text_col)
    frequency = a.select(F.explode("grams").alias("gram")).unionAll(b.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    x = prefixes(a, frequency, threshold).select(F.col("id").alias("left_id"), F.col("n").alias("m"), F.col("place").alias("p"), "gram")
    y = prefixes(b, frequency, threshold).select(F.col("id").alias("right_id"), "n", F.col("place").alias("q"), "gram")
    needed = F.ceil(threshold / (1 + threshold) * (F.col("m") + F.col("n")) - 1e-9)
    # Shared at most: what stands before the places where they meet, and what follows.
    bound = F.least("p", "q") + F.least(F.col("m") - F.col("p"), F.col("n") - F.col("q"))
    sizes = (F.col("m") >= threshold * F.col("n") - 1e-9) & (F.col("n") >= threshold * F.col("m") - 1e-9)
    met = x.join(y, "gram").where(sizes).groupBy("left_id", "right_id").agg(
        F.min(bound).alias("most"), F.first(needed).alias("needed")
    )
    candidates = met.where("most >= needed").select("left_id", "right_id")
    full = candidates.join(a.select(F.col("id").alias("left_id"), F.col("grams").alias("g")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("grams").alias("h")), "right_id")
    similarity = F.size(F.array_intersect("g", "h")) / F.size(F.array_union("g", "h"))
    return full.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
