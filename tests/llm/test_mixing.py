import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfathom.llm import mixing

from . import odd


def brute_targets(sizes, weights, most=3):
    """Bisection on the level at which capped shares add up."""
    total, lo, hi = sum(sizes), 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(mid * w, most * n) for n, w in zip(sizes, weights, strict=True)) < total:
            lo = mid
        else:
            hi = mid
    return [min(lo * w, most * n) for n, w in zip(sizes, weights, strict=True)]


def test_targets_match_bisection():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, rng.randrange(10**6)]) for _ in range(rng.randrange(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got = mixing.targets_of(sizes, weights)
        if sum(sizes):
            assert got == pytest.approx(brute_targets(sizes, weights), rel=1e-6, abs=1e-6)
            assert sum(got) == pytest.approx(sum(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_inverts(n):
    j, size, key = np.arange(n), np.full(n, n), np.full(n, 12345)
    p = mixing.permutation(j, size, key)
    assert sorted(p) == list(range(n))
    assert (mixing.permutation(p, size, key, inverse=True) == j).all()


def test_buckets_and_their_rows_stay_below_the_root_of_all_rows():
    for rows in (0, 1, 5, 999, 10**3, 10**6, 10**9, 5 * 10**10):
        n = mixing.buckets_for(rows)
        assert n >= 1 and n * n <= max(rows, 1)
        assert rows / n <= max(mixing.ROWS_PER_BUCKET, rows**0.5 * 1.01)


def test_plan_gives_each_source_its_words():
    rng = random.Random(1)
    for _ in range(100):
        sizes = [rng.choice([0, 1, 5, 300, rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 9))]
        plan = mixing.Plan([str(i) for i in range(len(sizes))], sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], rng.choice([1, 7, 64]), 4)
        assert (plan.counts.sum(0) == np.array(plan.needs)).all()
        for i, n in enumerate(sizes):
            given = 0
            for j in range(plan.needs[i]):
                turn, q = divmod(j, plan.blocks[i])
                one = lambda x: np.array([x])
                b = int(mixing.permutation(one(q), one(plan.blocks[i]), one(plan.keys[i] + turn))[0])
                words = n - b * plan.block if b == plan.blocks[i] - 1 else plan.block
                given += plan.last[i] if j == plan.needs[i] - 1 and plan.last[i] else words
            assert given == plan.words[i]


def documents(spark, data):
    return odd.table(spark, data).select(
        F.col("doc_id").alias("ident"), "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")
    )


def test_odd_rows_meet_targets(spark):
    got = mixing.taken_by_document(documents(spark, odd.rows())).collect()
    assert len(got) == len(odd.rows())
    docs = odd.rows()
    sizes = defaultdict(int)
    for _, text, _, source, _ in docs:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets_of([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    by_size = {sizes[s]: s for s in order}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        source = by_size[r.source_size]
        assert r.target == pytest.approx(want[source])
        taken[source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 1


def test_reruns_agree(spark):
    data = [(i, "w " * (i % 50), None, f"s{i % 4}", None) for i in range(300)]
    run = lambda: sorted(tuple(r) for r in mixing.taken_by_document(documents(spark, data)).collect())
    assert run() == run()


def test_mix_is_the_words_of_the_slots(spark):
    """Every slot is used once, in full, and slots of a shard are gapless."""
    data = [(i, " ".join(f"w{i}_{k}" for k in range(37 * (i % 9))), None, f"s{i % 3}", None) for i in range(120)]
    docs = documents(spark, data)
    plan = mixing.plan_of(docs, block=16, n_shards=4)
    placed, mixed = mixing.mix(docs, plan)
    slots = mixing.slots_of(spark, plan).collect()
    per_shard = defaultdict(list)
    for s in slots:
        per_shard[s.shard].append(s.slot)
    for found in per_shard.values():
        assert sorted(found) == list(range(len(found)))
    words = {(r.shard, r.slot): r.n for r in mixed.groupBy("shard", "slot").agg(F.sum("n").alias("n")).collect()}
    assert words == {(s.shard, s.slot): s.words for s in slots}
    assert placed.count() == len(data)


def test_mixed_documents_keep_columns_and_words(spark):
    data = [(i, " ".join(f"w{i}_{k}" for k in range(1 + 20 * (i % 5))), "en", f"s{i % 3}", None) for i in range(60)]
    docs = odd.table(spark, data)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    texts = {r[0]: r[1] for r in data}
    total = 0
    for r in got.select("doc_id", "text", "n_chars").collect():
        own = texts[r.doc_id].split()
        part = r.text.split()
        total += len(part)
        assert set(part) <= set(own) and len(part) <= len(own) and r.n_chars == len(r.text)
    assert total == sum(len(t.split()) for t in texts.values())


def test_empty_and_wordless_tables(spark):
    assert mixing.taken_by_document(documents(spark, [])).count() == 0
    got = mixing.taken_by_document(documents(spark, [(1, None, None, None, None), (2, "", None, "a", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(odd.table(spark, [])).count() == 0
