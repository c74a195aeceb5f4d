"""Queries over retrieval quality, with oracle SQL.

Benchmark items are queries; a document that holds an item's text is gold. The
lexical arm ranks by distinct words shared, the other arm by text length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.functions import analysis
from sparkfathom.operators import evaluation as E
from sparkfathom.sources.tables import kept, table

#: Places of a ranking that count.
DEPTH = 50


def shared_words(spark: SparkSession, sf_dir: str, depth: int | None = None) -> DataFrame:
    """``query, document, shared, length, words``: distinct words of a query that a document holds.

    With ``depth`` those that may be among a query's first, or hold all its words.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), analysis.simple_lexemes(F.coalesce("text", F.lit(""))).alias("terms"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), analysis.simple_lexemes(F.col("text")).alias("terms"))
    return E.shared_words(docs, items, depth)


_T = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_SHARED = f"""dt AS (SELECT doc_id AS document, {_T} AS terms FROM documents),
du AS (SELECT document, len(terms) AS length, unnest(list_distinct(terms)) AS term FROM dt),
qu AS (SELECT item_id AS query, unnest(list_distinct({_T})) AS term FROM benchmark),
s AS (SELECT query, document, count(*) AS shared, max(length) AS length FROM du JOIN qu USING (term) GROUP BY ALL)"""


def known_items(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Items with the first document that holds all their words; ``rows`` is what ``shared_words`` gave."""
    whole = (shared_words(spark, sf_dir, 0) if rows is None else rows).where("shared = words")
    return whole.groupBy("query").agg(F.min("document").alias("gold"), F.count(F.lit(1)).alias("holders"))


_KNOWN = f"""{_SHARED}, w AS (SELECT query, count(*) AS words FROM qu GROUP BY 1),
g AS (SELECT query, min(document) AS gold, count(*) AS holders FROM s JOIN w USING (query) WHERE shared = words GROUP BY 1)"""


def known_item_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that at most five documents hold, their gold among them."""
    by = Window.partitionBy("query").orderBy("document")
    whole = shared_words(spark, sf_dir, 0).where("shared = words").select("query", "document")
    # One more than may hold an item tells whether too many do; each task drops the rest.
    first = whole.withColumn("n", F.row_number().over(by)).where(F.col("n") <= E.KNOWN_ITEM_DOCUMENTS + 1)
    matches = first.withColumn("gold", F.min("document").over(Window.partitionBy("query")))
    return E.known_items(matches.select("query", "gold", "document")).select("query", "gold", "documents")


_GATE = f"WITH {_KNOWN} SELECT query, gold, holders AS documents FROM g WHERE holders BETWEEN 1 AND 5"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms of every item with its gold document and the lead it would be given."""
    rows = kept(shared_words(spark, sf_dir, DEPTH))  # few, and read for both arms and for the gold documents
    pair = ["query", "document"]
    v = Window.partitionBy("query").orderBy(F.desc("shared"), "document")
    l = Window.partitionBy("query").orderBy("length", "document")  # noqa: E741
    ranked = lambda name, w: rows.select(*pair, F.row_number().over(w).alias(name)).where(F.col(name) <= DEPTH)
    cut = ranked("v_rank", v).join(ranked("l_rank", l), pair, "full")
    lead = F.when(F.col("query") < 20, "vector").otherwise("lexical")
    return cut.join(known_items(spark, sf_dir, rows).select("query", "gold"), "query").select(
        "query", F.lit("passage").alias("kind"), "document", "gold", "v_rank", "l_rank", lead.alias("shipped_lead")
    )


def policy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.policy_ranks(candidates(spark, sf_dir), 10)


_POLICY = f"""{_KNOWN}, r AS (SELECT query, document, row_number() OVER (PARTITION BY query ORDER BY shared DESC, document) AS v0,
row_number() OVER (PARTITION BY query ORDER BY length, document) AS l0 FROM s),
c AS (SELECT r.query, document, gold, CASE WHEN v0 <= 50 THEN v0 END AS v, CASE WHEN l0 <= 50 THEN l0 END AS l,
CASE WHEN r.query < 20 THEN 'vector' ELSE 'lexical' END AS lead FROM r JOIN g USING (query) WHERE v0 <= 50 OR l0 <= 50),
f AS (SELECT *, coalesce(1.0 / (60 + v), 0)::DOUBLE + coalesce(1.0 / (60 + l), 0)::DOUBLE AS rrf, coalesce(v, 1000000000 + l) AS stable,
coalesce(v = 1, false) AS v1, coalesce(l = 1, false) AS l1 FROM c),
k AS (SELECT query, document, gold, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN lead = 'vector' THEN v1 ELSE l1 END DESC, rrf DESC, stable, document) AS shipped,
row_number() OVER (PARTITION BY query ORDER BY rrf DESC, stable, document) AS "none",
row_number() OVER (PARTITION BY query ORDER BY v1 DESC, rrf DESC, stable, document) AS vector,
row_number() OVER (PARTITION BY query ORDER BY l1 DESC, rrf DESC, stable, document) AS lexical FROM f),
m AS (SELECT query, min(shipped) FILTER (document = gold AND shipped <= 10) AS shipped, min("none") FILTER (document = gold AND "none" <= 10) AS "none",
min(vector) FILTER (document = gold AND vector <= 10) AS vector, min(lexical) FILTER (document = gold AND lexical <= 10) AS lexical FROM k GROUP BY query),
p AS (SELECT query, 'passage' AS kind, 'shipped' AS policy, shipped AS rank, shipped AS base FROM m UNION ALL SELECT query, 'passage', 'none', "none", shipped FROM m
UNION ALL SELECT query, 'passage', 'vector', vector, shipped FROM m UNION ALL SELECT query, 'passage', 'lexical', lexical, shipped FROM m
UNION ALL SELECT query, 'passage', 'oracle', least(vector, lexical), shipped FROM m)"""
_POLICY_RANKS = f"WITH {_POLICY} SELECT query, kind, policy, rank FROM p"


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each policy and its paired comparison with the shipped one."""
    rows = E.ablation(policy_ranks(spark, sf_dir))
    return rows.select("kind", "policy", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_10", "mrr")], "n", "better", "worse")


_ABLATION = f"""WITH {_POLICY} SELECT kind, policy, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1,
round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS n,
count(*) FILTER (coalesce(rank, 1e9) < coalesce(base, 1e9)) AS better, count(*) FILTER (coalesce(rank, 1e9) > coalesce(base, 1e9)) AS worse FROM p GROUP BY ALL"""


def gold_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and margin of the gold document of each item, by share of words."""
    similarity = F.col("shared") / F.col("length")
    whole = shared_words(spark, sf_dir, 0).where("shared = words")
    gold = kept(whole.groupBy("query").agg(F.min("document").alias("document"), F.min_by(similarity, "document").alias("best")))
    best = shared_words(spark, sf_dir).select("query", "document", similarity.alias("best"))  # each document once
    found = E.gold_rank_and_margin(best, gold)
    return found.select("query", "rank", F.round("margin", 6).alias("margin"))


_MARGINS = f"""WITH {_KNOWN}, b AS (SELECT query, document, shared / length::DOUBLE AS best FROM s),
m AS (SELECT g.query, gold, b.best AS mine FROM g JOIN b ON b.query = g.query AND b.document = g.gold)
SELECT m.query, 1 + count(*) FILTER (b.document <> gold AND b.best > mine) AS rank,
round(coalesce(mine - max(b.best) FILTER (b.document <> gold), 0), 6) AS margin FROM m JOIN b ON b.query = m.query GROUP BY m.query, mine"""


def duplicate_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are gold to several items."""
    return E.duplicate_keys(known_items(spark, sf_dir), "gold")


_DUPLICATES = f"WITH {_KNOWN} SELECT gold, count(*) AS n FROM g GROUP BY gold HAVING count(*) > 1"


def rider_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often broken words, blank lines and digits occur in all texts."""
    return E.census(table(spark, sf_dir, "documents"), "text", {"hyphens": "[a-z]-\n[a-z]", "breaks": "\n", "numbers": "[0-9]+"})


_CENSUS = r"""SELECT sum(len(regexp_extract_all(text, '[a-z]-\n[a-z]')))::BIGINT AS hyphens, sum(len(regexp_extract_all(text, '\n')))::BIGINT AS breaks,
sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers FROM documents"""


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank metrics by quality label of the gold documents of turns ranked by length."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(w))
    joined = ranked.join(table(spark, sf_dir, "labels"), "doc_id")
    rows = E.rank_metrics(joined, ["quality"])
    return rows.select("quality", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_10", "mrr")], "n")


_LABELS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT quality, round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg((rank <= 10)::INT), 6) AS recall_10, round(avg(1.0 / rank), 6) AS mrr, count(*) AS n
FROM r JOIN labels USING (doc_id) GROUP BY quality"""

QUERIES = {
    "known_item_gate": known_item_gate,
    "policy_ranks": policy_ranks,
    "ablation": ablation,
    "gold_margins": gold_margins,
    "duplicate_gold": duplicate_gold,
    "rider_census": rider_census,
    "label_metrics": label_metrics,
}

ORACLES = {
    "known_item_gate": _GATE,
    "policy_ranks": _POLICY_RANKS,
    "ablation": _ABLATION,
    "gold_margins": _MARGINS,
    "duplicate_gold": _DUPLICATES,
    "rider_census": _CENSUS,
    "label_metrics": _LABELS,
}
