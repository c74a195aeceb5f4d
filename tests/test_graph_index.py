"""The graph index against brute force, with and without a narrow filter."""

import numpy as np
import pytest

from sparkfathom.operators import graph_index, knn

N, K = 3000, 10


def made(seed=3, dimension=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dimension))
    return centres[rng.integers(0, 40, N)] + 0.6 * rng.normal(size=(N, dimension)), rng


@pytest.fixture(scope="module")
def table(spark):
    x, _ = made()
    rows = [(i, v.tolist(), "rare" if i % 97 == 0 else "crowd", None if i % 5 else "x") for i, v in enumerate(x)]
    rows += [(N, None, "crowd", None), (N + 1, [None] * 16, "crowd", None), (N + 2, [0.0] * 16, "zero", None)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, collection string, extra string")


@pytest.fixture(scope="module", params=["cosine", "l2", "ip"])
def index(request, spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph"))
    knn.build_index("graph", table, path=path, metric=request.param, shard_rows=400)
    return graph_index.GraphIndex.open(spark, path)


def nearest(x, q, metric, keep):
    x, q = (graph_index._prepared(a, metric) for a in (x, q[None, :]))
    d = graph_index._far(x, q[0], metric)
    return [i for i in np.lexsort((np.arange(len(x)), d)) if keep(i)][:K]


@pytest.mark.parametrize("narrow", [False, True])
def test_recall(index, narrow):
    x, rng = made()
    keep = (lambda i: i % 97 == 0) if narrow else (lambda i: True)
    where = (lambda r: r["collection"] == "rare") if narrow else None
    hits = 0
    queries = x[rng.choice(N, 8)] + 0.1 * rng.normal(size=(8, 16))
    for q in queries:
        got = index.search(q.tolist(), K, where=where).collect()
        assert len(got) == K and [r.distance for r in got] == sorted(r.distance for r in got)
        assert all(keep(r.chunk_id) for r in got)
        hits += len({r.chunk_id for r in got} & set(nearest(x, q, index.metric, keep)))
    assert hits >= 0.9 * K * len(queries)


def test_the_manifest_tells_method_and_parameters(index):
    m = index.manifest
    assert (m["method"], m["degree"], m["candidates"], m["rows"]) == ("graph", 24, 96, N + 1) and m["cells"] > 4


def test_degrees_are_bounded_and_every_row_is_reached():
    x, _ = made()
    x = np.concatenate([x[:600], np.repeat(x[:1], 60, axis=0), x[:100] + 50])
    edges, entry = graph_index.build_graph(x, "l2", 8, 32)
    assert np.mean([len(e) for e in edges]) <= 16
    seen, open_ = {entry}, [entry]
    while open_:
        for j in edges[open_.pop()].tolist():
            if j not in seen:
                seen.add(j)
                open_.append(j)
    assert len(seen) == len(x)


def test_the_beam_is_as_wide_as_the_page(index, monkeypatch):
    asked = []
    monkeypatch.setattr(index, "_probe", lambda cells, q, k, where, width: asked.append(width) or [])
    assert index.search([1.0] * 16, 200, width=64).count() == 0
    assert set(asked) == {200}


def test_odd_tables(spark, tmp_path):
    kind = "chunk_id long, embedding array<float>, collection string"
    empty = knn.build_index("graph", spark.createDataFrame([], kind), path=str(tmp_path / "a"))
    assert empty.search([1.0], 5).count() == 0
    one = knn.build_index("graph", spark.createDataFrame([(7, [1.0, 0.0], None)], kind), path=str(tmp_path / "b"))
    assert [r.chunk_id for r in one.search([1.0, 0.0], 5).collect()] == [7]
    assert one.search([1.0, 0.0], 5, where=lambda r: r["collection"] == "x").count() == 0
    with pytest.raises(ValueError, match="several dimensions"):
        knn.build_index("graph", spark.createDataFrame([(1, [1.0], None), (2, [1.0, 2.0], None)], kind), path=str(tmp_path / "c"))
    with pytest.raises(ValueError, match="ranks by cosine"):
        one.search([1.0, 0.0], 5, "l2")


def test_the_vector_arm_walks_the_graph(spark, table, index, monkeypatch):
    from sparkfathom.operators.search import Corpus, Searcher

    if index.metric != "cosine":
        return
    chunks = table.selectExpr("chunk_id", "chunk_id as document_id", "'text' as content")
    documents = table.selectExpr("chunk_id as id", "collection", "'p' as source_path")
    x, _ = made()
    own = Searcher(Corpus(documents, chunks, table.limit(0), vector_index=index))
    assert own.vector_arm(x[5].tolist(), 10, None).orderBy("pos").first().chunk_id == 5
    assert {r.chunk_id % 97 for r in own.vector_arm(x[5].tolist(), 10, ["rare"]).collect()} == {0}
