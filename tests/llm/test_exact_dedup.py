import hashlib

import pytest
from pyspark.sql import functions as F

from sparkfathom.llm import exact_dedup, shared

from . import odd


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, keep):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(lowered(text), []).append(i)
    out = []
    for i, text, *_ in rows:
        ids = groups[lowered(text)]
        known = [x for x in ids if x is not None]
        out.append((i, keep(known) if known else None, len(ids), hashlib.sha256(lowered(text).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,pick", [("min", min), ("max", max)])
def test_matches_brute_force(spark, keep, pick):
    got = exact_dedup.exact_groups(odd.table(spark), keep=keep)
    found = [(r.ident, r.keep_id, r.group_size, r.digest.hex()) for r in got.collect()]
    assert sorted(found, key=repr) == brute(odd.rows(), pick)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    data = [(i, f"text {i % 40}", None, None, None) for i in range(200)]
    got = exact_dedup.exact_groups(odd.table(spark, data), keep="max", bits=8)
    assert {(r.ident, r.keep_id, r.group_size) for r in got.collect()} == {(i, 160 + i % 40, 5) for i in range(200)}


def test_empty_table(spark):
    assert exact_dedup.exact_groups(odd.table(spark, [])).count() == 0


def test_index_compacts_several_flushes(spark):
    index = exact_dedup.LsmIndex(spark, "min")
    rows = lambda xs: spark.createDataFrame([(bytes([d]), i) for d, i in xs], "digest binary, ident long")
    index.flush(rows([(1, 5), (2, 6)]))
    index.compact()
    index.flush(rows([(1, 3), (3, 9)]))
    level = {(r.digest[0], r.n, r.keep_id) for r in index.compact().collect()}
    assert level == {(1, 2, 3), (2, 1, 6), (3, 1, 9)}
    with pytest.raises(ValueError):
        exact_dedup.LsmIndex(spark, "any")


def test_drop_keeps_columns_and_one_text_each(spark):
    docs = odd.table(spark)
    kept = exact_dedup.drop_exact_copies(docs, keep="max")
    assert kept.columns == docs.columns
    texts = [lowered(r.text) for r in kept.select("doc_id", "text").collect()]
    assert sorted(set(texts)) == sorted({lowered(t) for _, t, *_ in odd.rows()})
    assert len(texts) == len(set(texts))


def test_one_group_of_a_third(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")
    )
    got = exact_dedup.exact_groups(docs, keep="max")
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000
    assert got.where("group_size = 1 and keep_id = ident").count() == 2000


def test_without_is_null_safe_and_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None), (2, None), (3, "c")], "`ident` long, `a.b` string")
    gone = spark.createDataFrame([(1, "a"), (None, "a"), (2, None), (9, "z")], "ident long, digest string")
    kept = shared.without(docs, gone, {"ident": docs["ident"], "digest": docs["`a.b`"]})
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "b"), (3, "c")]
    none = shared.without(docs, gone.limit(0), {"ident": docs["ident"], "digest": docs["`a.b`"]})
    assert none.count() == 6


def test_the_filter_never_rules_out_a_wanted_key(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").cast("binary").alias("digest"), "id")
    bits = shared.bitmap(rows.where("id % 10 = 0"), "digest")
    found = shared.flagged(rows, bits, "digest", "hit")
    assert found.where("id % 10 = 0 and not hit").isEmpty() and found.count() == 20_000
    assert found.where("hit").count() < 2200
