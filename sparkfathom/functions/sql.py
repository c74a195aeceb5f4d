"""The engine's functions for Spark SQL: ``register(spark)`` adds them to a session.

Vector and text functions are SQL functions, which the optimizer inlines and runs
in the JVM. ``chunk_words`` is a table function.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkfathom.functions import chunking

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate(transform(v, x -> x * x), 0D, (s, x) -> s + x))"

#: Signature, result type and body of each SQL function.
FUNCTIONS = {
    "vector_norm(v ARRAY<DOUBLE>)": ("DOUBLE", _NORM),
    "inner_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", _DOT),
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE", f"1D - coalesce({_DOT} / nullif(vector_norm(a) * vector_norm(b), 0D), 0D)",
    ),
    "l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    ),
    "vector_normalise(v ARRAY<DOUBLE>)": ("ARRAY<DOUBLE>", "transform(v, x -> coalesce(x / nullif(vector_norm(v), 0D), x))"),
    "lexemes(t STRING)": ("ARRAY<STRING>", "regexp_extract_all(lower(t), '[a-z0-9]+', 0)"),
    "longest_run(t STRING)": ("INT", r"coalesce(array_max(transform(split(t, '\\s+'), w -> char_length(w))), 0)"),
    "text_preview(t STRING)": ("STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
}


@udtf(returnType="chunk_index int, content string")
class ChunkWords:
    """Windows of words of one text; a blank or null one has none."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        chunking.check_window(size, overlap)
        words = (text or "").split()
        for i in range(0 if not words else 1 + max(0, -(-(len(words) - size) // (size - overlap)))):
            at = i * (size - overlap)
            yield i, " ".join(words[at : at + size])


def register(spark: SparkSession) -> None:
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udtf.register("chunk_words", ChunkWords)
