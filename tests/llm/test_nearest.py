import numpy as np
from pyspark.sql import functions as F

from sparkfathom.llm import nearest


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, class string, list string")


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            others = [(-float((q * v).sum()), j) for j, v in zip(ids, x, strict=True) if j != i]
            out[i] = [j for _, j in sorted(others)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.ident)
    return out


def test_recall_on_noise_and_clusters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[:1000] = x[0] + 0.1 * rng.normal(size=(1000, 24)).astype(np.float32)
    x *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    got = found(nearest.search(table(spark, [(i, v.tolist(), "c", "l") for i, v in enumerate(x)])))
    want = brute(range(3000), x.astype(float), 20, 20)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert hits / (20 * len(want)) >= 0.9


def test_small_tables_are_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(45)]
    bad = [(200, None), (220, [0.0] * 4), (240, [float("nan"), 1.0, 1.0, 1.0]), (260, [float("inf"), 1.0, 1.0, 1.0]), (280, [None, 1.0, 1.0, 1.0]), (300, [1.0]), (None, [1.0] * 4)]
    got = nearest.search(table(spark, [(i, v, "c", "l") for i, v in rows + bad]))
    good = [(i, v) for i, v in rows if any(v)]
    want = brute([i for i, _ in good], np.array([v for _, v in good]), 20, 20)
    assert found(got) == want
    scores = {(r.query_id, r.ident): r.score for r in got.collect()}
    by_id = dict(good)
    assert all(s == sum(a * b for a, b in zip(by_id[q], by_id[c], strict=True)) for (q, c), s in scores.items())


def test_fewer_candidates_than_wanted(spark):
    got = nearest.search(table(spark, [(i, [1.0, float(i)], "c", "l") for i in range(5)]))
    assert found(got) == {0: [1, 2, 3, 4]}
    assert [r.rank for r in got.orderBy("rank").collect()] == [1, 2, 3, 4]


def test_repeated_rows_and_empty_tables(spark):
    assert nearest.search(table(spark, [])).count() == 0
    assert nearest.search(table(spark, [(1, None, "c", "l")])).count() == 0
    got = nearest.search(table(spark, [(0, [1.0, 0.0], "c", "l"), (0, [1.0, 0.0], "c", "l"), (1, [2.0, 0.0], "c", "l")]))
    assert found(got) == {0: [1]}


def test_a_third_of_equal_vectors(spark):
    rows = spark.range(900).select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        .otherwise(F.array(F.rand(1), F.rand(2), F.rand(3)))
        .cast("array<float>")
        .alias("embedding"),
    )
    data = sorted(rows.collect())
    got = found(nearest.search(spark.createDataFrame(data, rows.schema)))
    want = brute([r.vec_id for r in data], np.array([r.embedding for r in data]), 20, 20)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert hits / (20 * len(want)) >= 0.9


def test_normal_tail():
    from math import erfc, sqrt

    z = np.linspace(-6, 6, 101)
    assert np.allclose(nearest.normal_tail(z), [0.5 * erfc(v / sqrt(2)) for v in z], atol=2e-7)
