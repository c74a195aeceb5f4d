import math
import random
from collections import Counter

import pytest

from sparkfathom.llm import sharding

from . import odd


@pytest.mark.parametrize("n", [0, 1, 5, 16, 333])
def test_sizes_are_exact_and_nothing_is_lost(spark, n):
    data = [(i % 7, f"t{i}", None, None, None) for i in range(n)]
    got = sharding.shuffle_into_shards(odd.table(spark, data), 16)
    rows = got.select("text", "shard", "slot").collect()
    assert sorted(r.text for r in rows) == sorted(f"t{i}" for i in range(n))
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s, size in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(size))


def test_odd_rows_keep_all_columns(spark):
    docs = odd.table(spark)
    got = sharding.shuffle_into_shards(docs, 3)
    assert set(got.columns) == set(docs.columns)
    assert dict(got.dtypes)["shard"] == "int" and dict(got.dtypes)["slot"] == "bigint"
    assert got.count() == docs.count()


def test_reruns_agree_and_seeds_differ(spark):
    docs = odd.table(spark, [(i, "x", None, None, None) for i in range(200)])
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, 4, seed).collect()}
    assert place(1) == place(1) != place(2)


def test_bad_count(spark):
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(odd.table(spark), 0)


def test_hypergeometric_law():
    rng, n = random.Random(1), 20_000
    seen = Counter(sharding.hypergeometric(rng, 50, 30, 20) for _ in range(n))
    chi = 0.0
    for k in range(21):
        want = math.comb(50, k) * math.comb(30, 20 - k) / math.comb(80, 20) * n
        chi += (seen[k] - want) ** 2 / want if want > 5 else 0
    assert chi < 36  # 14 degrees of freedom, 0.1%


def test_matrix_margins():
    matrix = sharding.communication_matrix([10**9, 7, 0, 123_456], 16, 3)
    assert [sum(line) for line in matrix] == [10**9, 7, 0, 123_456]
    columns = [sum(c) for c in zip(*matrix, strict=True)]
    assert max(columns) - min(columns) <= 1


def test_every_row_reaches_every_shard_evenly(spark):
    docs = odd.table(spark, [(i, "x", None, None, None) for i in range(8)], [])
    seen = Counter()
    for seed in range(60):
        for r in sharding.shuffle_into_shards(docs, 4, seed).where("doc_id = 0").collect():
            seen[(r.shard, r.slot)] += 1
    assert len(seen) == 8 and max(seen.values()) < 20


def test_query_takes_whole_documents_through_the_shards(spark, tmp_path, monkeypatch):
    import zlib

    from pyspark.sql import functions as F

    from sparkfathom.llm import queries

    docs = odd.table(spark, extra=[])
    folder, given = odd.write(spark, tmp_path, documents=docs), []
    real = sharding.shuffle_into_shards

    def marked(df, *args):
        given.append(df.columns)
        return real(df, *args).withColumn("text", F.concat("text", F.lit("!")))

    monkeypatch.setattr(sharding, "shuffle_into_shards", marked)
    got = queries.op1_sharding(spark, folder)
    assert given == [docs.columns]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    before_window = plan[plan.index("Window [row_number") :]
    assert "kept#" in before_window and ".text" not in before_window and "_extract" not in before_window
    sent = lambda t: b"" if t is None else (t + "!").encode()
    want = Counter((r.doc_id, len(sent(r.text)) + 1, zlib.crc32(sent(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got.collect()) == want
