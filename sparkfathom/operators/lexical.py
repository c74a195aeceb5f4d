"""Lexical matching and ranking over lexeme arrays or a postings table.

A chunk matches a query exactly if it holds every distinct lexeme, relaxed if it
holds most of them. Ranks follow BM25 (Robertson and Zaragoza, 2009) over the
chunks given; fusion uses rank positions only.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfathom.functions import analysis

#: Share of terms a relaxed match holds, and the most terms it takes.
RELAXED_SHARE, RELAXED_TERMS = 0.6, 8

#: Candidates an arm takes before scope, and documents of a rare word.
POOL, RARE_DOCUMENTS = 2000, 20

#: Parameters of the rank.
K1, B = 1.2, 0.75


def postings(chunks: DataFrame, analyzer: str = "simple", id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``term, id_col, tf, length``: one row for each distinct term of a chunk."""
    terms = chunks.select(id_col, analysis.lexemes(F.coalesce(F.col(text_col), F.lit("")), analyzer).alias("terms"))
    return (
        terms.select(id_col, F.size("terms").alias("length"), F.explode("terms").alias("term"))
        .groupBy("term", id_col)
        .agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    )


def term_sets(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``term, id_col, length``: one row for each distinct term of a chunk, made inside its row."""
    terms = chunks.select(id_col, F.explode(F.array(analysis.lexemes(F.coalesce(F.col(text_col), F.lit("")), "simple"))).alias("terms"))
    return terms.select(id_col, F.size("terms").alias("length"), F.explode(F.array_distinct("terms")).alias("term"))


def query_lexemes(spark, query: str, analyzer: str = "simple") -> list[str]:
    """Distinct lexemes of a query, in order of first occurrence."""
    found = spark.range(1).select(analysis.lexemes(F.lit(query), analyzer).alias("t")).first()["t"]
    return list(dict.fromkeys(found))


def needed_terms(n: int, share: float = RELAXED_SHARE, most: int = RELAXED_TERMS) -> int | None:
    """Distinct terms that a relaxed match must hold; None for no or too many terms."""
    if n == 0 or n > most:
        return None
    return max(1, math.ceil(share * n - 1e-9))


def term_counts(chunks: DataFrame, terms: list[str], analyzer: str, id_col: str, text_col: str) -> DataFrame:
    """``id_col, length, tfs``: lexemes of each chunk, and how often each term is one.

    Plain lexemes are counted without making them: with each between two spaces of
    its own, an occurrence is what a text loses when the spaced term is taken out.
    """
    # A generator of one row: a later filter is not pushed below it, where it would
    # work on each text once for every mention.
    text = F.coalesce(F.col(text_col), F.lit(""))
    if analyzer != "simple":
        held = chunks.select(id_col, F.explode(F.array(analysis.lexemes(text, analyzer))).alias("terms"))
        tf = [F.size("terms") - F.size(F.array_remove("terms", t)) for t in terms]
        return held.select(id_col, F.size("terms").alias("length"), F.array(*tf).alias("tfs"))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "  ")), F.lit(" "))
    held = chunks.select(id_col, F.explode(F.array(spaced)).alias("spaced"))
    lost = lambda x: (F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(x), F.lit("")))) / len(x)
    length = F.when(F.col("spaced") == "  ", 0).otherwise(lost("  ") + 1).cast("int")
    return held.select(id_col, length.alias("length"), F.array(*[lost(f" {t} ").cast("int") for t in terms]).alias("tfs"))


def ranked_matches(chunks: DataFrame, terms: list[str], need: int, analyzer: str = "simple",
                   id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``id_col, matched, rank``: chunks that hold ``need`` of the terms or more.

    Texts are read once: lengths and term counts, some numbers a chunk, pass an
    exchange that both the facts and the ranks use. The facts are one row.
    """
    counted = term_counts(chunks, terms, analyzer, id_col, text_col).repartition(id_col)
    facts = counted.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg("length").alias("mean_length"),
        F.array(*[F.count_if(F.col("tfs")[i] > 0) for i in range(len(terms))]).alias("dfs"),
    )
    matched = F.size(F.filter("tfs", lambda x: x > 0))
    idf = lambda df: F.log(1 + (F.col("n_chunks") - df + 0.5) / (df + 0.5))
    size = K1 * (1 - B + B * F.col("length") / F.greatest("mean_length", F.lit(1e-9)))
    weights = F.zip_with("tfs", "dfs", lambda x, df: idf(df) * x * (K1 + 1) / (x + size))
    return (
        counted.withColumn("matched", matched)
        .where(F.col("matched") >= need)
        .join(F.broadcast(facts))
        .select(id_col, "matched", F.aggregate(weights, F.lit(0.0), lambda a, x: a + x).alias("rank"))
    )


class PostingsIndex:
    """Postings stored sorted by term, so that a query reads its own terms' row groups.

    ``build`` writes the table and the corpus facts of the rank; ``matches`` gives
    what ``ranked_matches`` gives, without looking at any text.
    """

    def __init__(self, spark, path: str):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.facts = spark.read.parquet(f"{path}/facts").first()

    @classmethod
    def build(cls, chunks: DataFrame, path: str, analyzer: str = "simple", id_col: str = "chunk_id", text_col: str = "content"):
        rows = postings(chunks, analyzer, id_col, text_col).withColumnRenamed(id_col, "chunk_id")
        rows.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
        size = F.size(analysis.lexemes(F.coalesce(F.col(text_col), F.lit("")), analyzer))
        facts = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(size).alias("mean_length"))
        facts.write.mode("overwrite").parquet(f"{path}/facts")
        return cls(chunks.sparkSession, path)

    def matches(self, terms: list[str], need: int) -> DataFrame:
        """``chunk_id, matched, rank``; only the terms' postings are read and moved."""
        own = self.postings.where(F.col("term").isin(terms))
        dfs = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        n, mean = self.facts["n_chunks"], max(self.facts["mean_length"] or 0.0, 1e-9)
        weight = F.lit(0.0)
        for term in terms:
            df = dfs.get(term, 0)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            tf = F.coalesce(F.max(F.when(F.col("term") == term, F.col("tf"))), F.lit(0))
            size = K1 * (1 - B + B * F.max("length") / mean)
            weight = weight + F.lit(idf) * tf * (K1 + 1) / (tf + size)
        return own.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("matched"), weight.alias("rank")).where(F.col("matched") >= need)


def lexical_top(chunks: DataFrame, scoped: DataFrame, query: str, k: int, analyzer: str = "simple", relaxed: bool = False,
                pool: int | None = POOL, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``id_col, rank``: the ``k`` best matches among the rows of ``scoped``.

    The pool of matches is taken before the scope, by identifier, as the scope
    is a property of the vector row: a chunk without one is invisible. Without
    ``pool`` all matches compete.
    """
    terms = query_lexemes(chunks.sparkSession, query, analyzer)
    need = needed_terms(len(terms)) if relaxed else len(terms)
    if not need:
        return chunks.select(id_col, F.lit(0.0).alias("rank")).limit(0)
    matches = ranked_matches(chunks, terms, need, analyzer, id_col, text_col)
    candidates = matches if pool is None else matches.orderBy(id_col).limit(pool)
    seen = candidates.join(scoped.select(id_col), id_col, "left_semi")
    return seen.select(id_col, "rank").orderBy(F.desc("rank"), id_col).limit(k)


def probe(chunks: DataFrame, scoped: DataFrame, word: str, cap: int = 20 * RARE_DOCUMENTS, analyzer: str = "simple",
          id_col: str = "chunk_id", doc_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """One row, ``sampled, documents``: documents that a capped sample of matches shows.

    Below the cap the sample is every match and documents in scope are exact; at
    the cap it may hide some, so then every sampled document counts.
    """
    terms = query_lexemes(chunks.sparkSession, word, analyzer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if analyzer == "simple":  # a search stops at the first occurrence
        held = [F.lower(text).rlike(f"(?<![a-z0-9]){t}(?![a-z0-9])") for t in terms]
        every = functools.reduce(lambda a, b: a & b, held, F.lit(True))
    else:
        every = F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), analysis.lexemes(text, analyzer))) == 0
    sample = chunks.where(every if terms else F.lit(False)).select(id_col, doc_col).orderBy(id_col).limit(cap)
    marked = sample.join(scoped.select(id_col, F.lit(True).alias("in_scope")), id_col, "left")
    seen = F.count_distinct(F.when(F.col("in_scope"), F.col(doc_col)))
    return marked.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.when(F.count(F.lit(1)) < cap, seen).otherwise(F.count_distinct(doc_col)).alias("documents"),
    )
