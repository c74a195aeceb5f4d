"""The text index and set-based search, against scans and plain Python."""

import math
import random
import shutil
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfathom.operators import batch_search, knn, lexical, lexical_index
from sparkfathom.operators.lexical_index import LexicalIndex
from sparkfathom.operators.search import Corpus, Searcher

WORDS = ["red", "green", "blue", "grey", "pink", "teal", "the", "of"]


def texts(n, seed=4):
    rng = random.Random(seed)
    return [(i, i // 2, " ".join(rng.choices(WORDS, [8, 5, 3, 2, 1, 0.2, 9, 9], k=rng.randrange(14))), "ab"[i % 2]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, document_id long, content string, collection string")


def ranks(df, n=9):
    return [(r.chunk_id, round(r["rank"], n)) for r in df.collect()]


@pytest.fixture(scope="module")
def chunks(spark):
    return frame(spark, [*texts(300), (300, 150, None, "a"), (301, 150, "", "b")])


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    made = LexicalIndex(spark, str(tmp_path_factory.mktemp("index")), route=("collection",), stripe_bits=3)
    assert made.add(chunks) == 302 and made.add(chunks) == 0
    return made


@pytest.mark.parametrize(("query", "relaxed"), [("red the", False), ("teal pink", False), ("red absent", False), ("red pink teal blue absent", True), ("", False)])
def test_same_as_a_scan(spark, chunks, index, query, relaxed):
    scoped = chunks.where("chunk_id % 3 = 0").select("chunk_id")
    for pool in (2000, 20, 5):
        a = index.lexical_top(query, 10, scoped, relaxed, pool)
        b = lexical.lexical_top(chunks, scoped, query, 10, relaxed=relaxed, pool=pool)
        assert ranks(a) == ranks(b)


def test_best_skips_stripes_that_cannot_enter(spark, chunks, index):
    terms = ["teal", "red"]
    want = lexical.ranked_matches(chunks, terms, 1).orderBy(F.desc("rank"), "chunk_id").limit(3)
    got = index.best(terms, 1, 3)
    assert [(r.id, round(r["rank"], 9)) for r in got.collect()] == ranks(want)
    assert index.looked_at < index.could_look_at


def test_stripes_beyond_the_list_stay_in_tables(spark, chunks, index, monkeypatch):
    monkeypatch.setattr("sparkfathom.operators.lexical_index.LISTED", 8)
    for pool in (2000, 5, None):
        got = ranks(index.lexical_top("red the", 10, None, False, pool))
        every = lexical.ranked_matches(chunks, ["red", "the"], 2)
        every = every if pool is None else every.orderBy("chunk_id").limit(pool)
        assert got == ranks(every.orderBy(F.desc("rank"), "chunk_id").limit(10))


def test_routing_columns_filter_blocks(spark, index):
    found = index.lexical_top("red", 50, where=F.col("collection") == "a")
    assert {r.chunk_id % 2 for r in found.collect()} == {0}


def test_probe(spark, chunks, index):
    scoped = chunks.where("chunk_id % 5 < 2").select("chunk_id")
    for word in ("teal", "red", "absent", "teal pink"):
        for cap in (400, 10):
            assert index.probe(word, scoped, cap).first() == lexical.probe(chunks, scoped, word, cap).first()


def test_no_text_is_read(spark, chunks, index):
    plan = index.lexical_top("red the", 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(stripe" in plan or "In(term" in plan
    assert "content" not in plan and "positions" not in plan.split("ReadSchema")[1]


def test_segments_merge_and_repair(spark, chunks, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "i"), route=("collection",), stripe_bits=3)
    whole = lambda rows: ranks(lexical.ranked_matches(rows, ["red", "the"], 2).orderBy(F.desc("rank"), "chunk_id").limit(20))
    index.add(chunks.where("chunk_id < 100"))
    index.add(chunks.where("chunk_id < 200"))
    index.add(chunks)
    assert len(index.segments()) == 3 and ranks(index.lexical_top("red the", 20, pool=None)) == whole(chunks)

    shutil.rmtree(index._path(index.segments()[1]["segment"]))
    assert len(index.damaged()) == 1 and index.unindexed(chunks).count() == 100
    assert index.add(chunks) == 100 and not index.damaged()
    assert ranks(index.lexical_top("red the", 20, pool=None)) == whole(chunks)

    alive = chunks.where("chunk_id % 4 != 0")
    index.merge(alive)
    assert len(index.segments()) == 1 and index.vacuum() > 0
    assert ranks(index.lexical_top("red the", 20, pool=None)) == whole(alive)
    index.merge(alive.limit(0))
    assert index.segments() == [] and index.lexical_top("red", 5).count() == 0


def plain_proximity(words, query):
    total = 0.0
    for i, a in enumerate(query):
        for b in query[:i]:
            for p in (k for k, w in enumerate(words) if w == a):
                for q in (k for k, w in enumerate(words) if w == b):
                    if abs(p - q) <= 100:
                        total += math.log1p(-0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))))
    return 1 - math.exp(total)


def test_proximity_and_phrases(spark, chunks, index):
    rows = {r.chunk_id: (r.content or "").split() for r in chunks.collect()}
    query = ["red", "of", "blue"]
    want = sorted(((-round(plain_proximity(w, query), 9), i) for i, w in rows.items() if set(query) <= set(w)))[:15]
    got = index.lexical_top("red of blue", 15, pool=None, near=True)
    assert [(-r, i) for i, r in ranks(got)] == want
    for phrase in (["of", "the"], ["the", "the"], ["red", "of", "the"], ["teal", "absent"]):
        times = {i: sum(w[k : k + len(phrase)] == phrase for k in range(len(w))) for i, w in rows.items()}
        found = {r.chunk_id: r.times for r in index.phrase(" ".join(phrase)).collect()}
        assert found == {i: n for i, n in times.items() if n}


# -- many queries -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, chunks):
    rng = random.Random(9)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], "ab"[i % 2] if i < 280 else "c") for i in range(300)]
    vectors += [(400, None, "a"), (401, [1.0, None, 0.0, 0.0], "a"), (402, [1.0], "a"), (403, [0.0] * 4, "b")]
    vecs = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>, collection string")
    documents = chunks.select(F.col("document_id").alias("id"), F.lit("x").alias("collection"), F.col("document_id").cast("string").alias("source_path")).distinct()
    return Corpus(documents, chunks.drop("collection"), vecs, by=("collection",))


@pytest.fixture(scope="module")
def queries(spark):
    unit = lambda i: [float(i == j) for j in range(4)]
    rows = [(1, "red the", unit(0)), (2, "teal", unit(1)), (3, "red blue qzxv", unit(2)), (4, "", unit(3)), (5, None, [0.0] * 4), (6, "of", None), (7, "absent", [1.0])]
    return spark.createDataFrame(rows, "query_id long, query string, vector array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_vector_arms_by_revision(corpus, queries, metric, monkeypatch):
    usable = corpus.vectors.where("size(embedding) = 4 and not exists(embedding, x -> x is null)")
    got = batch_search.vector_arms(corpus.vectors, queries, 7, metric, ("collection",)).collect()
    monkeypatch.setattr(batch_search, "PASS_BYTES", 64)
    again = batch_search.vector_arms(corpus.vectors, queries, 7, metric, ("collection",)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    for q in queries.where("size(vector) = 4").collect():
        for c in "abc":
            own = knn.nearest(usable.where(F.col("collection") == c), q.vector, 7, metric).orderBy("distance", "chunk_id")
            mine = sorted((r.place, r.chunk_id) for r in got if r.query_id == q.query_id and r.collection == c)
            assert [i for _, i in mine] == [r.chunk_id for r in own.collect()]
    assert {r.chunk_id for r in got if r.query_id == 7} == {402} and not any(r.query_id == 6 for r in got)


def test_many_queries_are_single_ones_side_by_side(spark, corpus, queries, index):
    def listed(df):
        return sorted((r.query_id, r["rank"], r.document_id, round(r.score, 9), r.score_kind) for r in df.collect())

    many = listed(batch_search.search_many(corpus, queries, 5))
    assert many == listed(batch_search.search_many(replace(corpus, index=index), queries, 5))
    one_by_one = []
    for q in queries.where("query is not null and trim(query) <> '' and size(vector) = 4").collect():
        found = Searcher(corpus).search(q.query, q.vector, 5)
        one_by_one += listed(found.withColumn("query_id", F.lit(q.query_id)))
    assert one_by_one == [r for r in many if r[0] in (1, 2, 3)]


def test_arms_of_each_revision_fallback_and_lead(corpus, queries):
    found = batch_search.arms(corpus, queries, 2).collect()
    assert {(r.query_id, r.collection) for r in found if r.arm == 0} >= {(q, c) for q in (1, 2, 3, 4, 5) for c in "abc"}
    assert all(sum(1 for r in found if (r.query_id, r.arm, r.collection) == key) <= 10 for key in {(r.query_id, r.arm, r.collection) for r in found})
    assert any(r.query_id == 3 and r.arm == 1 for r in found)  # two of three words
    rare = {r.query_id for r in found if r.leads}
    holds = {r.document_id for r in corpus.chunks.where("content rlike 'teal'").collect()}
    assert rare == ({2} if len(holds) <= lexical.RARE_DOCUMENTS else set())


def test_no_queries(corpus, queries):
    assert batch_search.search_many(corpus, queries.limit(0)).count() == 0


def test_texts_are_cut_into_blocks_once(spark, chunks, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    made = lexical_index._blocks_of

    def counted(batches):
        def each():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return made(each())

    monkeypatch.setattr(lexical_index, "_blocks_of", counted)
    assert LexicalIndex(spark, str(tmp_path / "once")).add(chunks) == 302
    assert seen.value == 302


def test_blocks_of_awkward_rows(monkeypatch):
    monkeypatch.setattr(lexical_index, "HELD_WORDS", 4)
    rows = [(1, 10, None, 0, []), (2, 10, "a", 0, ["b", "a", "b"]), (3, None, None, 0, ["b"]), (4, 11, "a", 0, ["é", "b"]), (5, 11, "a", 1, None), (6, 12, "a", 2, ["z"] * 9), (7, 12, "b", 2, ["z"])]
    kinds = {"id": pa.int64(), "doc": pa.int64(), "r": pa.string(), "stripe": pa.int64(), "words": pa.list_(pa.string())}
    for size in (1, 3, 7):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kinds, r, strict=True)) for r in rows[i : i + size]], pa.schema(kinds)) for i in range(0, 7, size)]
        found = [b for batch in lexical_index._blocks_of(iter(batches)) for b in batch.to_pylist()]
        got = sorted((b["stripe"], b["term"], b["r"] or "", x, d, n, tf, p) for b in found for x, d, n, tf, p in zip(b["id"], b["doc"], b["length"], b["tf"], b["positions"], strict=True))
        want = sorted((s, w, r or "", x, d, len(ws or []), ws.count(w), [i for i, v in enumerate(ws) if v == w]) for x, d, r, s, ws in rows for w in set(ws or []))
        assert got == want
        for b in found:
            assert (b["first_id"], b["n"], b["max_tf"], b["min_length"]) == (min(b["id"]), len(b["id"]), max(b["tf"]), min(b["length"]))


def test_terms_of_few_queries_go_to_the_postings(spark, chunks, index):
    queries = spark.createDataFrame([(1, "red the"), (2, "teal"), (3, "absent")], "query_id long, query string")
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"))
    found = batch_search.lexical_matches(Corpus(chunks, chunks, vectors, index=index), queries)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 2
    want = [(1, *r) for r in ranks(lexical.ranked_matches(chunks, ["red", "the"], 2))] + [(2, *r) for r in ranks(lexical.ranked_matches(chunks, ["teal"], 1))]
    assert sorted((r.query_id, r.id, round(r["rank"], 9)) for r in found.collect()) == sorted(want)


# -- more matches than a pool holds -------------------------------------------------------


@pytest.fixture(scope="module")
def crowd(spark):
    """2400 chunks that hold the words, the best and the only ones with a vector last."""
    content = F.when(F.col("id") < 2390, "red the grey").otherwise(F.concat(F.lit("the"), F.repeat(F.lit(" red"), (F.col("id") - 2388).cast("int"))))
    return spark.range(2400).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), content.alias("content"))


@pytest.fixture(scope="module")
def crowd_index(spark, crowd, tmp_path_factory):
    made = LexicalIndex(spark, str(tmp_path_factory.mktemp("crowd")), stripe_bits=6)
    made.add(crowd)
    return made


@pytest.fixture(scope="module")
def crowd_corpus(crowd):
    documents = crowd.select(F.col("document_id").alias("id"), F.lit("x").alias("collection"), F.lit("p").alias("source_path"))
    vectors = crowd.where("chunk_id >= 2390").select("chunk_id", F.array(F.lit(1.0), F.col("chunk_id") / 100).alias("embedding"), F.lit("x").alias("collection"))
    return Corpus(documents, crowd, vectors)


def test_all_matches_of_many_queries_compete(spark, crowd, crowd_index, crowd_corpus):
    queries = spark.createDataFrame([(1, "red the", [1.0, 0.0]), (2, "red the qzxv", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    for index in (None, crowd_index):
        own = replace(crowd_corpus, index=index, by=("collection",))
        assert batch_search.lexical_matches(own, queries.where("query_id = 1")).count() == 2400
        found = batch_search.arms(own, queries, 10).where("arm = 1").collect()
        for q, need in ((1, 2), (2, 2)):
            words = ["red", "the"] if q == 1 else ["red", "the", "qzxv"]
            every = lexical.ranked_matches(crowd, words, need).where("chunk_id >= 2390").orderBy(F.desc("rank"), "chunk_id")
            assert [r.chunk_id for r in sorted(found, key=lambda r: r.pos) if r.query_id == q] == [r.chunk_id for r in every.collect()]


@pytest.mark.parametrize("query", ["red the", "red the qzxv"])
def test_all_matches_of_a_search_compete(crowd, crowd_index, crowd_corpus, query):
    every = lexical.ranked_matches(crowd, query.split(), 2).where("chunk_id >= 2390").orderBy(F.desc("rank"), "chunk_id").limit(4)
    want = [r.chunk_id for r in every.collect()]
    for index in (None, crowd_index):
        found = Searcher(replace(crowd_corpus, index=index)).lexical_arm(query, 4, None, relaxed="qzxv" in query)
        assert [r.chunk_id for r in found.orderBy("pos").collect()] == want


def test_all_matches_in_the_index_compete(crowd, crowd_index, crowd_corpus):
    every = lexical.ranked_matches(crowd, ["red", "the"], 2)
    assert ranks(crowd_index.lexical_top("red the", 3)) == ranks(every.orderBy(F.desc("rank"), "chunk_id").limit(3))
    scoped = crowd_corpus.vectors.where("chunk_id < 2396")
    assert ranks(crowd_index.lexical_top("red the", 3, scoped)) == ranks(every.where("chunk_id between 2390 and 2395").orderBy(F.desc("rank"), "chunk_id").limit(3))
