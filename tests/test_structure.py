"""Broken words, sections, chunks by structure, rebuilt spans and their census."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfathom.functions import chunking, structure

JOINED = [
    ("by max- imizing the agreement", "by maximizing the agreement"),
    ("a func-\ntion of time", "a function of time"),
    ("a func- \n  tion of time", "a function of time"),
    ("a multi-\nvariate model", "a multivariate model"),
    ("well­-conducted", "well-conducted"),
    ("a well-\nknown fact; wellknown too", "a wellknown fact; wellknown too"),
    ("ends in func-\ntion", "ends in function"),
    ("éle-\nvé", "élevé"),
]
KEPT = [
    "fixed-\nand random-effects", "pre- and post-match", "a well-\nknown result", "state-of-the-art", "x-\n3 and y", "low-\nDimensional",
    "an over-\nparameterized net and an over-parameterized one", "a x-\nray", "", "- \n-", None,
]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def by_id(rows, value="text"):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["id"], r.asDict().get("chunk_index", 0))):
        out.setdefault(r["id"], []).append(r[value])
    return out


def test_broken_words(spark):
    want = [b for _, b in JOINED] + KEPT
    got = texts(spark, [a for a, _ in JOINED] + KEPT).select("id", structure.dehyphenated(F.col("text")).alias("text"))
    assert [x[0] for x in by_id(got).values()] == want


def test_cuts_at_headings_and_page_breaks(spark):
    values = [
        "intro text\n# Methods\nbody one\n\f\nbody two\n## Results\nbody three\n", "a = \f\f det(x)\n b = c\n", "x #notheading\n#also not",
        "word " * 250, "# Head\n" + "word " * 250, None, " \n\f\n ", "# One\n# Two", "nul\0 goes",
    ]
    rows = structure.structure_chunks(texts(spark, values), ["id"], "text", 100, 20).cache()
    got, titles = by_id(rows, "content"), by_id(rows, "heading")
    assert got[0] == ["intro text\n", "# Methods\nbody one\n\f\n", "body two\n", "## Results\nbody three\n"]
    assert titles[0] == [None, "Methods", "Methods", "Results"]
    assert (got[1], got[2]) == ([values[1]], [values[2]])
    plain = chunking.chunk_words(texts(spark, values).where("id = 3"), ["id"], "text", 100, 20)
    assert got[3] == by_id(plain, "content")[3]
    assert len(got[4]) == 3 and max(len(c.split()) for c in got[4]) == 100 and titles[4] == ["Head"] * 3
    assert got[7] == ["# One\n", "# Two"] and titles[7] == ["One", "Two"] and got[8] == ["nul goes"]
    assert 5 not in got and 6 not in got
    assert sorted(by_id(rows, "chunk_index")[0]) == [0, 1, 2, 3]
    assert by_id(rows, "section")[0] == [0, 1, 1, 2]


def test_riders_apply_one_after_another(spark):
    span = "# Intro\nby max- imizing the agree-\nment\n# TOC\n" + ". " * 60 + "\n# Last\nword\n"
    rows = structure.rider_chunks(texts(spark, [span]).withColumn("heading", F.lit("clash")), ["id"], "text", 100, 20)
    assert by_id(rows, "content")[0] == ["# Intro\nby maximizing the agreement\n", "# Last\nword\n"]
    assert by_id(rows, "chunk_index")[0] == [0, 1]


def test_chunking_does_not_shuffle(spark):
    rows = structure.rider_chunks(texts(spark, ["a"]), ["id"], "text")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("step", [None, 50])
def test_spans_are_rebuilt(spark, step):
    values = [" ".join(f"word{i}" for i in range(500)), "one", " ".join(["same"] * 300) if step else "two words", None]
    docs = texts(spark, values)
    rows = structure.rebuilt(chunking.chunk_words(docs, ["id"], "text", 100, 50), ["id"], "chunk_index", "content", step)
    assert {r["id"]: r["text"] for r in rows.collect()} == {i: t for i, t in enumerate(values) if t}


def test_chunks_that_do_not_overlap_follow_each_other(spark):
    rows = spark.createDataFrame([(1, 0, "abc"), (1, 1, "xyz")], "id int, i int, c string")
    assert structure.rebuilt(rows, ["id"], "i", "c").first()["text"] == "abcxyz"


def test_census(spark):
    row = structure.census(texts(spark, ["# A\nfunc-\ntion\n\f\nx­", "plain", None]), "text").first()
    assert row.asDict() == {
        "heading_lines": 1, "spans_with_heading": 1, "page_breaks": 1, "form_feeds": 1, "broken_words": 1, "joined": 1, "soft_hyphens": 1,
    }
    assert set(structure.census(texts(spark, ["a"]).where("false"), "text").first()) == {0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab# \n\f.", max_size=30), min_size=1, max_size=6))
def test_segments_lose_nothing_but_blanks(spark, values):
    rows = by_id(structure.structure_chunks(texts(spark, values), ["id"], "text", 1000, 0), "content")
    squeeze = lambda t: "".join(t.split())
    for i, text in enumerate(values):
        assert squeeze("".join(rows.get(i, []))) == squeeze(text)
