import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfathom.operators import fusion, knn, lexical
from sparkfathom.operators.search import Corpus, Searcher, check_one_model, searchable_revisions


def arm(spark, docs):
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(docs)], "document_id string, pos int")


def brute(vector, lexical_, lead):
    scores = {}
    dedupe = lambda xs: list(dict.fromkeys(xs))
    v, l = dedupe(vector), dedupe(lexical_)  # noqa: E741
    for ranking in (v, l):
        for i, d in enumerate(ranking):
            scores[d] = scores.get(d, 0.0) + 1.0 / (61 + i)
    fused = sorted(scores, key=lambda d: -scores[d])
    first = (v if lead == "vector" else l)[:1]
    return dedupe(first + fused)


def order(spark, vector, lexical_, lead):
    fused = fusion.rrf(fusion.document_ranks(arm(spark, vector)), fusion.document_ranks(arm(spark, lexical_)))
    return [r.document_id for r in fusion.combined(fused, lead).orderBy("rank").collect()]


@pytest.mark.parametrize("lead", ["vector", "lexical"])
def test_fusion_matches_brute_force(spark, lead):
    rng = random.Random(7)
    cases = [(["v1", "v2", "s"], ["l1", "l2", "s"]), ([], ["a", "b"]), (["a"], []), ([], [])]
    cases += [([f"d{rng.randrange(12)}" for _ in range(rng.randrange(14))], [f"d{rng.randrange(12)}" for _ in range(rng.randrange(14))]) for _ in range(8)]
    for v, l in cases:  # noqa: E741
        assert order(spark, v, l, lead) == brute(v, l, lead)
    with pytest.raises(ValueError):
        fusion.combined(fusion.rrf(arm(spark, []).withColumnRenamed("pos", "rank"), arm(spark, []).withColumnRenamed("pos", "rank")), "both")


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [
        (1, 1, "tidal gauges with harmonic tables", "cs"), (2, 1, "further gauges", "cs"), (3, 2, "lichen growth on limestone", "bio"),
        (4, 3, "rareword occurs here in a long text about lichen and other things", "bio"), (5, 4, "unvectored rareword", "bio"),
    ]
    vectors = [(1, [1.0, 0, 0, 0]), (2, [0.9, 0.1, 0, 0]), (3, [0, 1.0, 0, 0]), (4, [0, 0.5, 0.5, 0])]
    chunks = spark.createDataFrame([t[:3] for t in texts], "chunk_id long, document_id long, content string")
    documents = spark.createDataFrame([(i, c, f"/d/{i}.txt") for i, c in ((1, "cs"), (2, "bio"), (3, "bio"), (4, "bio"))], "id long, collection string, source_path string")
    of = {t[0]: t[3] for t in texts}
    vecs = spark.createDataFrame([(i, [float(x) for x in v], of[i]) for i, v in vectors], "chunk_id long, embedding array<float>, collection string")
    return Corpus(documents, chunks, vecs)


def test_search_returns_documents_best_chunk_first(corpus):
    rows = Searcher(corpus).search("gauges tables", [1.0, 0.0, 0.0, 0.0], 3).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and len({r.document_id for r in rows}) == 3
    assert rows[0].document_id == 1 and rows[0].content.startswith("tidal") and rows[0].score == pytest.approx(1.0)


def test_collections_are_apart(corpus):
    rows = Searcher(corpus).search("gauges", [1.0, 0.0, 0.0, 0.0], 10, ["bio"]).collect()
    assert {r.collection for r in rows} == {"bio"}


def test_a_rare_word_leads_and_a_chunk_without_vector_is_invisible(corpus):
    s = Searcher(corpus)
    rows = s.search("rareword", [1.0, 0.0, 0.0, 0.0], 4).orderBy("rank").collect()
    assert rows[0].document_id == 3 and 4 not in {r.document_id for r in rows}
    assert s.lexical_should_lead("rareword") and not s.lexical_should_lead("rareword twice") and not s.lexical_should_lead("absent")


def test_typo_fallback(corpus):
    _, other = Searcher(corpus).candidates("lichen growth limesotne", [0.0, 1.0, 0.0, 0.0])
    assert [r.document_id for r in other.collect()] == [2]
    assert other.first().distance is None and other.first().score_kind == "lexical_rank"


def test_without_hybrid_rows_are_still_documents(corpus):
    rows = Searcher(corpus, hybrid=False).search("gauges", [1.0, 0.0, 0.0, 0.0], 10).collect()
    assert sorted(r.document_id for r in rows) == [1, 2, 3]


def test_query_checks(corpus):
    for query, k in ((" ", 5), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            Searcher(corpus).search(query, [1.0, 0, 0, 0], k)


@pytest.mark.parametrize("n,need", [(0, None), (1, 1), (2, 2), (4, 3), (5, 3), (8, 5), (9, None)])
def test_relaxed_terms(n, need):
    assert lexical.needed_terms(n) == need


def test_relaxed_match_is_the_or_of_conjunctions(spark):
    from itertools import combinations, product

    terms = ["a", "b", "c", "d"]
    texts = [" ".join(t for t, keep in zip(terms, bits, strict=True) if keep) for bits in product([0, 1], repeat=4)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    got = {r.chunk_id for r in lexical.ranked_matches(chunks, terms, 3).collect()}
    want = {i for i, t in enumerate(texts) if any(set(c) <= set(t.split()) for c in combinations(terms, 3))}
    assert got == want


def test_probe_caps(spark, corpus):
    full = lexical.probe(corpus.chunks, corpus.vectors, "rareword").first()
    assert (full.sampled, full.documents) == (2, 1)
    capped = lexical.probe(corpus.chunks, corpus.vectors, "rareword", cap=2).first()
    assert capped.documents == 2


def test_filtered_indexes_fill_a_page(spark, tmp_path):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(430, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), "slice" if i >= 400 else "crowd") for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, collection string")
    q = x[3].tolist()
    where = F.col("collection") == "slice"
    exact = [r.chunk_id for r in knn.build_index("exact", vectors).search(q, 10, where=where).orderBy("distance").collect()]
    assert len(exact) == 10 and min(exact) >= 400
    ivf = knn.build_index("ivf", vectors, path=str(tmp_path / "ivf"), cells=8)
    got = [r.chunk_id for r in ivf.search(q, 10, where=where, probes=1).collect()]
    assert len(got) == 10 and min(got) >= 400
    whole = [r.chunk_id for r in ivf.search(q, 10, where=where, probes=8).orderBy("distance").collect()]
    assert whole == exact
    lsh = knn.build_index("lsh", vectors)
    assert len(lsh.search(q, 10, where=where).collect()) == 10
    with pytest.raises(ValueError):
        knn.build_index("tree", vectors)


def test_top_k_plan_keeps_k_rows_a_task(spark, corpus):
    plan = knn.nearest(corpus.vectors, [1.0, 0, 0, 0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_overfetch():
    assert [knn.arm_limit(k) for k in (1, 10, 11, 50)] == [5, 50, 50, 50]
    assert knn.tuned_probes("ivf", 4, 10) == 10 and knn.tuned_probes("exact", 4, 10) == 0


def test_revision_choice_and_one_model(spark):
    rows = [(1, "a", "retired", 1), (2, "a", "active", 1), (3, "a", "ready", 1), (4, "b", "building", 2), (5, "b", "ready", 2), (6, "b", "ready", 2), (7, "c", "superseded", 3)]
    r = spark.createDataFrame(rows, "id long, collection string, status string, embedding_profile_id long")
    chosen = searchable_revisions(r)
    assert {x.collection: x.id for x in chosen.collect()} == {"a": 2, "b": 6}
    with pytest.raises(ValueError, match="different models"):
        check_one_model(chosen)
    check_one_model(chosen.where("collection = 'a'"))


def test_scores_explain_order(spark):
    rows = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (1, 3, 1.0), (2, 1, 0.1), (2, 2, 0.3)], "q int, pos int, score double")
    got = {r.q: r.explained for r in fusion.explains_order(rows, "q", "pos", "score").collect()}
    assert got == {1: True, 2: False}


def test_postings_index_agrees_with_a_scan(spark, tmp_path):
    rng = random.Random(4)
    words = ["red", "green", "blue", "grey", "pink"]
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(80)], "chunk_id long, content string")
    index = lexical.PostingsIndex.build(chunks, str(tmp_path / "p"))
    for terms, need in ((["red", "blue"], 2), (["red", "absent", "pink"], 2), (["absent"], 1)):
        a = {r.chunk_id: (r.matched, round(r["rank"], 9)) for r in index.matches(terms, need).collect()}
        b = {r.chunk_id: (r.matched, round(r["rank"], 9)) for r in lexical.ranked_matches(chunks, terms, need).collect()}
        assert a == b
    plan = index.matches(["red"], 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan
