"""Chunkings side by side: which chunks of two chunkings share characters.

Spans are half-open ranges of characters of a document. They meet by the bins they
touch, so a long document is many small keys and no span is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def char_windows(docs: DataFrame, size: int, step: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, chunk, start, end``: windows of ``size`` characters every ``step``.

    The last window is the first that reaches the end. An empty or null text has none.
    """
    n = F.char_length(F.col(text_col))
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    made = docs.where(n > 0).select(id_col, n.alias("__n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * step
    return made.select(id_col, "chunk", start.alias("start"), F.least(start + size, F.col("__n")).alias("end"))


def overlaps(left: DataFrame, right: DataFrame, bin_size: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``id_col, chunk_a, chunk_b, shared``: pairs of spans of a document that share characters.

    A pair that meets in several bins counts in the first of them. Spans that are
    empty, or null at an end, share nothing.
    """

    def binned(spans: DataFrame, tag: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / bin_size) for c in ("start", "__last"))
        usable = spans.where("start < end").withColumn("__last", F.col("end") - 1)
        return usable.select(
            id_col, F.explode(F.sequence(first, last)).alias("bin"), F.col("chunk").alias(f"chunk_{tag}"), F.col("start").alias(f"start_{tag}"), F.col("end").alias(f"end_{tag}")
        )

    met = binned(left, "a").join(binned(right, "b"), [id_col, "bin"])
    start, end = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    return met.where((start < end) & (F.floor(start / bin_size) == F.col("bin"))).select(id_col, "chunk_a", "chunk_b", (end - start).alias("shared"))


def aligned(left: DataFrame, right: DataFrame, bin_size: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``id_col, chunk_a, chunk_b, shared``: for each left span the right one it shares most with.

    Ties go to the earlier chunk. Spans that share nothing are left out.
    """
    best = Window.partitionBy(id_col, "chunk_a").orderBy(F.desc("shared"), "chunk_b")
    ranked = overlaps(left, right, bin_size, id_col).withColumn("__n", F.row_number().over(best))
    return ranked.where("__n = 1").drop("__n")


def carried(relevant: DataFrame, left: DataFrame, right: DataFrame, share: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """``id_col, chunk``: right spans that hold ``share`` of a relevant left span, or lie in one by as much.

    So labels made on one chunking judge another on one pool of characters.
    """
    sized = lambda spans, tag: spans.select(id_col, F.col("chunk").alias(f"chunk_{tag}"), (F.col("end") - F.col("start")).alias(f"n_{tag}"))
    marked = left.join(relevant, [id_col, "chunk"], "left_semi")
    met = overlaps(marked, right, id_col=id_col).join(sized(left, "a"), [id_col, "chunk_a"]).join(sized(right, "b"), [id_col, "chunk_b"])
    return met.where(F.col("shared") >= share * F.least("n_a", "n_b")).select(id_col, F.col("chunk_b").alias("chunk")).distinct()
