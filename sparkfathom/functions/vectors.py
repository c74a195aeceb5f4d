"""Vector arithmetic as columns: everything is computed in doubles, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest dimension that may be stored, and that a graph index may hold.
MAX_DIMENSION, MAX_GRAPH_DIMENSION = 8192, 2000


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def inner_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(v), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, inner_product(a, b) / size).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def normalised(v: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(doubles(v), lambda x: x / size)).otherwise(doubles(v))


def literal(v: Column) -> Column:
    """``[1.0,2.0]``: the text form of a vector."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def checked_dimension(v: Column, graph_index: bool = False) -> Column:
    """The vector, or an error if it is empty or larger than what may be stored."""
    most = MAX_GRAPH_DIMENSION if graph_index else MAX_DIMENSION
    wrong = F.raise_error(F.concat(F.lit("vector dimension not in 1.."), F.lit(str(most))))
    return F.when(F.size(v).between(1, most), v).otherwise(wrong.cast("array<float>"))


#: Distances by metric; smaller is nearer.
DISTANCES = {"cosine": cosine_distance, "l2": l2_distance, "ip": negative_inner_product}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {sorted(DISTANCES)}, not {metric!r}")
    return DISTANCES[metric](a, b)


def score_of(metric: str, dist: Column) -> tuple[Column, str]:
    """A score that grows with nearness, and what kind of score it is."""
    if metric == "cosine":
        return 1 - dist, "cosine_similarity"
    if metric == "l2":
        return -dist, "negative_l2_distance"
    if metric == "ip":
        return -dist, "inner_product"
    raise ValueError(f"metric must be one of {sorted(DISTANCES)}, not {metric!r}")


def mean_pooled(vectors: DataFrame, by: list[str], vec_col: str) -> DataFrame:
    """``by`` and ``pos, value``: the normalised mean vector of each group.

    One row for each group and position is folded before the shuffle, so a large
    group costs no more than a small one.
    """
    means = (
        vectors.select(*by, F.posexplode(doubles(F.col(vec_col))).alias("pos", "x"))
        .groupBy(*by, "pos")
        .agg(F.avg("x").alias("mean"))
    )
    sizes = means.groupBy(*by).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("size"))
    value = F.when(F.col("size") > 0, F.col("mean") / F.col("size")).otherwise(F.col("mean"))
    return means.join(sizes, by).select(*by, "pos", value.alias("value"))


def worst_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the least cosine and the greatest component difference over pairs."""
    gap = F.array_max(F.zip_with(doubles(F.col(a)), doubles(F.col(b)), lambda x, y: F.abs(x - y)))
    return pairs.agg(
        F.min(cosine_similarity(F.col(a), F.col(b))).alias("worst_cosine"), F.max(gap).alias("max_difference")
    )
