"""Gated query sets against a loop over all documents."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkfathom.functions import text as T
from sparkfathom.operators import query_sets as Q

WORDS = "alpha beta gamma delta rho sigma tau phi chi psi omega kappa".split()


def collection(seed=3, documents=40):
    """Chunks of drawn words; some documents are copies, and one word is in many chunks of few documents."""
    draw = random.Random(seed)
    rows = []
    for doc in range(documents):
        for i in range(draw.randrange(1, 7)):
            text = " ".join(draw.choice([*WORDS, f"Name{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}", "Common"]) for _ in range(12))
            rows.append((doc, i, text + ". " + " ".join(draw.choice(WORDS) for _ in range(8))))
    rows += [(documents + 1, i, t) for d, i, t in rows if d == 0]
    rows += [(documents + 2, i, f"Frequent {'abcdefghij'[i % 10]}") for i in range(120)]
    rows += [(documents + 3 + j, 0, "Frequent") for j in range(9)]
    return [*rows, (documents + 20, 0, None), (documents + 21, 0, "")]


def terms(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def known(chunks, query, gold):
    """The gate, by a look at every chunk in order."""
    need, seen = set(terms(query)), []
    for doc, _, text in sorted(chunks, key=lambda r: r[:2]):
        if need <= set(terms(text)):
            seen.append(doc)
    held = set(seen[:100])
    return 0 < len(held) <= 5 and gold in held


def expected(chunks, candidates):
    out = {}
    for doc in sorted({c[0] for c in chunks}):
        for place, query in enumerate(candidates(doc)):
            if known(chunks, query, doc):
                out[doc] = (place, query)
                break
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, i int, body string")


def test_rare_tokens(spark):
    rows = collection()

    def candidates(doc):
        found = {w for d, i, t in rows if d == doc and i < 8 for w in re.findall(r"\b[A-Z][A-Za-z]{2,}\b", t or "")} - set(T.CAPITAL_STOPWORDS)
        return sorted(found, key=lambda w: (-len(w), w))[:10]

    got = {r["gold"]: (r["place"], r["query"]) for r in Q.rare_token_set(frame(spark, rows).withColumn("query", F.lit("clash")), "doc", "i", "body").collect()}
    assert got == expected(rows, candidates)
    assert got[42] == (0, "Frequent") and 43 not in got  # its first hundred chunks lie in one document


def phrases(spark, rows):
    listed = {}
    for r in frame(spark, rows).where("i between 2 and 7").select("doc", "i", T.phrase_candidates(F.col("body")).alias("p")).orderBy("doc", "i").collect():
        listed.setdefault(r["doc"], []).extend(r["p"] or [])
    return lambda doc: listed.get(doc, [])[:12]


def test_phrases_in_rounds(spark):
    rows = collection()
    want = expected(rows, phrases(spark, rows))
    digest = F.md5(F.col("doc").cast("string"))
    order = sorted(want, key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
    for n in (3, 1000):
        got = {r["gold"]: (r["place"], r["query"]) for r in Q.phrase_set(frame(spark, rows), "doc", "i", "body", n, digest).collect()}
        assert got == {d: want[d] for d in order[:n]}


def test_large_query_tables_are_not_broadcast(spark, monkeypatch):
    rows = collection()
    digest = F.md5(F.col("doc").cast("string"))
    small = Q.phrase_set(frame(spark, rows), "doc", "i", "body", 9, digest).collect()
    monkeypatch.setattr(Q, "BROADCAST_QUERIES", 0)
    assert sorted(Q.phrase_set(frame(spark, rows), "doc", "i", "body", 9, digest).collect()) == sorted(small)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert Q.rare_token_set(none, "doc", "i", "body").count() == 0
    assert Q.phrase_set(none, "doc", "i", "body", 5, F.col("doc")).count() == 0


def test_a_common_query_is_cut_before_the_exchange(spark):
    asked = spark.createDataFrame([("q", 1)], "query string, gold long")
    matches = spark.range(100).select(F.concat(F.lit("q"), F.when(F.col("id") < 0, "x").otherwise("")).alias("query"), F.col("id").alias("document"))
    plan = Q.gated(asked, matches)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and Q.gated(asked, matches).count() == 0


def odd_texts():
    """Texts of other white space, words that are cut by signs, letters that lower to others, and lengths at the ends of windows."""
    draw = random.Random(5)
    signs = ["Alpha", "beta", "Namely", "x-ray", "Kelvin", "İstan", "Straße", "--", "a1b2", "Common", " ", "Zeta_eta", "don't"]
    rows = [(d, draw.choice(["", " ", "\n"]) + draw.choice([" ", "\t", "\n \x0b", "\r\n"]).join(draw.choice([*signs, f"Rare{chr(97 + draw.randrange(26))}"]) for _ in range(n)) + draw.choice(["", "\f"]))
            for d, n in enumerate([1, 2, 7, 8, 9, 11, 12, 13, 14, 20, 60, 61, 62, 400, 64, 65])]
    rows += [(50 + d, f"Sole{'abcdefgh'[d]} Common end. " * 3) for d in range(8)] + [(60, rows[13][1]), (61, rows[13][1])]
    return [*rows, (70, None), (71, ""), (72, " \n"), (73, " "), (None, "Nobody Common")]


def test_words_of_windows_are_those_of_their_chunks(spark, monkeypatch):
    docs = spark.createDataFrame(odd_texts(), "doc long, body string")
    windows = Q.Windows(docs, "doc", "body", 8, 3)
    chunks = windows.chunks("i", "body")
    asked = spark.createDataFrame([(f"rare{c}",) for c in "abcdefghijklmnopqrstuvwxyz"] + [("common",), ("kelvin",), ("x",), ("zeta",)], "query string")
    want = chunks.select("doc", F.explode(F.array_distinct(Q.analysis.lexemes(F.col("body")))).alias("query")).groupBy("query", "doc").count()
    want = {tuple(r) for r in want.join(asked, "query").collect()}
    for held in (8_000_000, 200):
        monkeypatch.setattr(Q, "HELD_BYTES", held)
        got = Q.term_documents(windows, asked, "doc", "body", most=1000).join(asked, "query").groupBy("query", "document").agg(F.sum("chunks"))
        assert {tuple(r) for r in got.collect()} == want
    assert sorted(map(tuple, Q.rare_token_set(windows, "doc", "i", "body").collect())) == sorted(map(tuple, Q.rare_token_set(chunks, "doc", "i", "body").collect()))


def test_words_are_counted_before_the_exchange(spark):
    docs = spark.createDataFrame([(d, "Common words. " * 90) for d in range(60)], "doc long, body string").coalesce(1)
    for chunks in (Q.Windows(docs, "doc", "body", 8, 3), Q.Windows(docs, "doc", "body", 8, 3).chunks("i", "body")):
        got = Q.term_documents(chunks, spark.createDataFrame([("common",)], "query string"), "doc", "body").where("query = 'common'").collect()
        assert [(r["document"], r["chunks"]) for r in got] == [(d, 36) for d in range(6)]
        plan = Q.rare_token_set(chunks, "doc", "i", "body")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and plan.count("Generate explode") <= 1  # of the documents that a query may have, not of words


def test_phrases_of_windows_are_those_of_their_chunks(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(d, " ".join(draw.choice([*WORDS, "Kelvin", "x-ray", f"rare{chr(97 + draw.randrange(26))}"]) for _ in range(n)) + ".\n") for d, n in enumerate([3, 9, 15, 20, 40, 41, 42, 60, 80] * 4)]
    docs = spark.createDataFrame([*rows, (100, None), (101, " \t"), (102, rows[8][1]), (None, rows[7][1])], "doc long, body string")
    windows = Q.Windows(docs, "doc", "body", 12, 4)
    chunks, digest = windows.chunks("i", "body"), F.md5(F.coalesce(F.col("doc").cast("string"), F.lit("")))
    want = sorted(map(tuple, Q.phrase_set(chunks, "doc", "i", "body", 1000, digest).collect()))
    assert len(want) > 8
    for held in (1_000_000, 5):  # words that are compared at once
        monkeypatch.setattr(Q, "HELD_WORDS", held)
        assert sorted(map(tuple, Q.phrase_set(windows, "doc", "i", "body", 1000, digest).collect())) == want
    some = Q.phrase_set(windows, "doc", "i", "body", 3, digest).collect()
    assert len(some) == 3 and {tuple(r) for r in some} <= set(want)
    monkeypatch.setattr(Q, "BROADCAST_QUERIES", 0)
    assert sorted(map(tuple, Q.phrase_set(windows, "doc", "i", "body", 1000, digest).collect())) == want


def test_a_later_round_asks_other_documents(spark, monkeypatch):
    """The first documents by the order match too often, so rounds go on; each asks those not asked before, and chunks are not exchanged."""
    rows = [(d, i, f"common words stand here in every text of number {d if d > 20 else 0} again") for d in range(40) for i in range(3)]
    made, asked = [], Q.phrase_asked
    monkeypatch.setattr(Q, "phrase_asked", lambda own, *a: made.append({r["doc"] for r in own.select("doc").distinct().collect()}) or asked(own, *a))
    monkeypatch.setattr(Q, "conjunctions", None)
    rows += [(d, 2, f"quite singular findings {chr(97 + d - 25) * 4} appear inside documents") for d in range(25, 40)]
    got = Q.phrase_set(frame(spark, rows), "doc", "i", "body", 3, F.format_string("%05d", F.col("doc"))).collect()
    assert [r["gold"] for r in got] == [25, 26, 27]
    assert made == [set(range(12)), set(range(12, 40))]
