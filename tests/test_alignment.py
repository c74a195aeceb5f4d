"""Span alignment, fuzzy pairs and canaries, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfathom.engine import Engine
from sparkfathom.operators import canary, embedding, fuzzy, spans

KIND = "doc_id long, chunk int, start int, end int"


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    cut = lambda n: [(rng.randrange(4), i, s, s + rng.choice([0, 1, 40, 900, 5000])) for i in range(n) for s in [rng.randrange(9000)]]
    a, b = cut(60), cut(60)
    got = spans.overlaps(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND), bin_size=256)
    want = sorted((x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))
    assert sorted(map(tuple, got.collect())) == want
    best = {}
    for d, i, j, n in want:
        best[d, i] = max(best.get((d, i), (0, 0)), (n, -j))
    found = spans.aligned(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND))
    assert {(r.doc_id, r.chunk_a): (r.shared, -r.chunk_b) for r in found.collect()} == best


def test_windows_cover_the_text_and_labels_carry_over(spark):
    docs = spark.createDataFrame([(1, "x" * 250), (2, "x" * 100), (3, ""), (4, None)], "doc_id long, text string")
    small, large = spans.char_windows(docs, 100, 80), spans.char_windows(docs, 200, 200)
    assert [tuple(r) for r in small.orderBy("doc_id", "chunk").collect()] == [(1, 0, 0, 100), (1, 1, 80, 180), (1, 2, 160, 250), (2, 0, 0, 100)]
    relevant = spark.createDataFrame([(1, 2)], "doc_id long, chunk int")
    assert [tuple(r) for r in spans.carried(relevant, small, large).orderBy("chunk").collect()] == [(1, 1)]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_fuzzy_pairs_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(6)
    names = ["kalman filter", "tidal gauges", "straße", "", None, "aaaaaaa", "a", "Tidal Gauge"]
    for _ in range(60):
        base = list(rng.choice(["harmonic tables of tides", "lichen growth marks", "kalman filters"]))
        for _ in range(rng.randrange(6)):
            base[rng.randrange(len(base))] = rng.choice("abc ")
        names.append("".join(base))

    def grams(t):
        p = "  " + (t or "").lower() + " "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    rows = spark.createDataFrame(list(enumerate(names)), "id long, text string")
    got = {(r.left_id, r.right_id): round(r.similarity, 9) for r in fuzzy.similar_pairs(rows, rows, threshold).collect()}
    want = {}
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            s = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
            if s >= threshold - 1e-12:
                want[i, j] = round(s, 9)
    assert got == want
    with pytest.raises(ValueError):
        fuzzy.similar_pairs(rows, rows, 0)


class Shifted(embedding.HashProvider):
    """Another model behind the same name."""

    by = 1e-6

    def embed(self, texts):
        return [[x + self.by * (i % 2) for i, x in enumerate(v)] for v in super().embed(texts)]


class Exchanged(Shifted):
    by = 3.0


def test_canaries(spark, tmp_path):
    now = canary.fresh(spark, lambda: embedding.HashProvider(8))
    stored = canary.decoded(canary.captured(now, 3)).select("text", "vector")
    assert canary.compared(stored, now) == "identical"
    assert canary.compared(stored, canary.fresh(spark, lambda: Shifted(8))) == "scheduling"
    assert canary.compared(stored, canary.fresh(spark, lambda: Exchanged(8))) == "semantic"
    with pytest.raises(ValueError, match="dimension"):
        canary.compared(stored, canary.fresh(spark, lambda: embedding.HashProvider(9)))
    with pytest.raises(ValueError, match="counterpart"):
        canary.compared(stored, now.limit(2))
    assert canary.decoded(spark.createDataFrame([(1, "no json")], canary.CANARIES)).count() == 0


def test_the_engine_keeps_the_first_canary(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"), provider=lambda: embedding.HashProvider(8))
    profile = e.profile("embedding", e.payloads()["embedding"])
    assert e._canary_state() == [] and e.capture_canary(profile) and not e.capture_canary(profile)
    assert e._canary_state()[0] == {"check": "model_canary", "ok": True, "detail": "identical"}
    e.provider = lambda: Exchanged(8)
    assert not e.capture_canary(profile) and not e._canary_state()[0]["ok"]
    assert e.read("canaries").agg(F.count(F.lit(1))).first()[0] == 1
