import random

import numpy as np
from pyspark.sql import functions as F

from sparkfathom.llm import quality

from . import odd


def prose(rng, n):
    words = ["river", "stone", "the", "and", "walks", "slowly", "over", "green", "hills", "while", "birds", "sing"]
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def junk(rng, n):
    word = rng.choice(["buy", "click", "win", "now"])
    return rng.choice([" ".join(w.upper() + "!!" for w in prose(rng, n).split()), " ".join([word] * n), " | ".join(prose(rng, n).split())])


def corpus(spark, n=600):
    rng = random.Random(5)
    data, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        data.append((i, (prose if good else junk)(rng, rng.randrange(5, 80)), None, None, None))
        labels.append((i, int(good), 0))
    return odd.table(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    right = scored.where("(score >= 0.5) = (quality = 1)").count() / scored.count()
    assert scored.count() > 150 and right >= 0.95


def test_scores_are_reproducible_and_blind_to_other_columns(spark):
    docs, labels = corpus(spark, 200)
    a, b = quality.train(docs, labels), quality.train(docs.withColumn("lang", F.lit("xx")), labels)
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all() and a.bias == b.bias


def test_held_out_rows_are_never_learned(spark):
    docs, labels = corpus(spark, 200)
    held = quality.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels).weights == quality.train(docs, turned).weights).all()


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, quality.RANK)))
    ids, x = np.arange(0, 40, 3), rng.normal(size=14)
    pairs = sum(float(m.factors[ids[a]] @ m.factors[ids[b]]) * x[a] * x[b] for a in range(14) for b in range(a))
    assert abs(m.logit(ids, x) - (0.3 + float(m.weights[ids] @ x) + pairs)) < 1e-9


def test_odd_rows_and_empty_tables(spark):
    docs, labels = corpus(spark, 100)
    machine = quality.train(docs, labels)
    rows = quality.score(odd.table(spark), machine, score_col="score").collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(odd.table(spark, []), machine).count() == 0
    nothing = quality.train(odd.table(spark, []), labels)
    assert {round(r.score, 1) for r in quality.score(odd.table(spark, [(1, "", None, None, None)]), nothing).collect()} == {0.5}
    null_labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, null_labels).bias == nothing.bias


def test_sample_is_bounded(spark):
    docs, labels = corpus(spark, 300)
    assert quality.training_rows(docs, labels, 50).count() == 50


def test_size_of_a_text_does_not_change_its_letters():
    piece = "snake_case __init__ é漢²٣ á _ x1\n"
    place, share = quality.STATISTICS.index("alnum"), sum(map(str.isalnum, piece)) / len(piece)
    for times in (1, 50, 100, 150, 1000):
        _, values = quality.features(piece * times, quality.Words())
        assert abs(values[len(values) - len(quality.STATISTICS) + place] - share) < 1e-12
