import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkfathom.functions import analysis, chunking, identity, validation
from sparkfathom.functions import text as T
from sparkfathom.functions import vectors as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vector_arithmetic(spark):
    a, b = arr(1, 2, 2), arr(2, 0, 0)
    got = one(spark, V.inner_product(a, b), V.norm(a), V.cosine_similarity(a, b), V.l2_distance(a, b), V.literal(a))
    assert got == (2.0, 3.0, pytest.approx(1 / 3), 3.0, "[1.0,2.0,2.0]")
    zero = one(spark, V.cosine_similarity(arr(0, 0), arr(1, 0)), V.normalised(arr(0, 0)))
    assert zero == (0.0, [0.0, 0.0])
    with pytest.raises(ValueError):
        V.distance("manhattan", a, b)
    with pytest.raises(ValueError):
        V.score_of("manhattan", a)


def test_scores_grow_with_nearness(spark):
    for metric in V.DISTANCES:
        near, far = (V.score_of(metric, V.distance(metric, arr(1, 0), arr(*x)))[0] for x in ((1, 0.1), (0.2, 1)))
        assert one(spark, near > far) == (True,)


def test_mean_pool(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0])], "g string, v array<double>")
    got = {(r.g, r.pos): r.value for r in V.mean_pooled(rows, ["g"], "v").collect()}
    assert got[("a", 0)] == pytest.approx(0.5**0.5) and got[("b", 1)] == 0.0


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (512, 1), (600, 2), (896, 2), (897, 3)])
def test_window_count(spark, n, want):
    assert one(spark, chunking.window_count(F.lit(n), 512, 128)) == (want,)


def test_chunks_cover_the_text_without_a_duplicate_tail(spark):
    words = [f"w{i}" for i in range(45)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "  \n"), (4, "one")], "id long, t string")
    rows = chunking.chunk_words(docs, ["id"], "t", 20, 5).orderBy("id", "chunk_index").collect()
    mine = [r.content.split() for r in rows if r.id == 1]
    assert [len(c) for c in mine] == [20, 20, 15] and mine[0][-5:] == mine[1][:5] and mine[-1][-1] == "w44"
    assert [(r.id, r.content) for r in rows if r.id != 1] == [(4, "one")]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.check_window(*bad)


def test_byte_windows_lose_nothing():
    rng = random.Random(1)
    for text in ("\U0001f389" * 60, "नमस्ते " * 60, "漢字かな" * 60, "plain words " * 30, ""):
        data = text.encode()
        cuts, at = [], 0
        while at < len(data):
            at = min(len(data), at + rng.randrange(1, 4))
            cuts.append(at)
        assert "".join(chunking.byte_windows(data, cuts, 16, 0)) == text
        assert all("�" not in c for c in chunking.byte_windows(data, cuts, 7, 3))


def test_text_preparation(spark):
    got = one(
        spark, T.longest_run(F.lit("ab  cdef\ng")), T.longest_run(F.lit("")), T.without_nul(F.lit("a\0b")), T.preview(F.lit(" a \n b ")),
        T.is_identifier(F.lit(" word ")), T.is_identifier(F.lit("two words")), T.is_identifier(F.lit("  ")), T.punctuation_share(F.lit("a -- ..")),
        T.punctuation_share(F.lit("")),
    )
    assert got == (4, 0, "ab", "a b", True, False, False, pytest.approx(2 / 3), 1.0)


def test_task_prefix_is_idempotent(spark):
    model = "/x/Nomic-Embed-Text-v1.5.gguf"
    once = T.with_task_prefix(F.lit("hello"), "query", model)
    assert one(spark, once, T.with_task_prefix(once, "query", model)) == ("search_query: hello",) * 2
    assert one(spark, T.with_task_prefix(F.lit("hello"), "query", "other.gguf")) == ("hello",)


def test_titles_and_phrases(spark):
    path = F.lit("/papers/2019-attention-is_all-you-need.pdf")
    assert one(spark, T.title_from_path(path), T.file_name(path)) == ("attention is all you need", "2019-attention-is_all-you-need.pdf")
    (found,) = one(spark, T.phrase_candidates(F.lit("Plans emerge while models train on text. Too short.")))
    assert found[0] == "Plans emerge while models train on" or not found[0].endswith(" on")
    assert all(w.split()[0].lower() not in T.FUNCTION_WORDS and w.split()[-1].lower() not in T.FUNCTION_WORDS for w in found)
    assert {len(w.split()) for w in found} <= {3, 4, 5, 6}


def test_capitalised_tokens_and_trigrams(spark):
    (tokens,) = one(spark, T.capitalised_tokens(F.lit("The Kalman filter of Kalman and ABc With Érdi")))
    assert sorted(tokens) == ["ABc", "Kalman"]
    assert one(spark, T.trigram_similarity(F.lit("word"), F.lit("word"))) == (1.0,)


def test_perturbations_keep_their_promises(spark):
    phrase = "enable planning to emerge while training"
    made = {k: one(spark, change(F.lit(phrase), 4), change(F.lit(phrase), 4)) for k, change in T.PERTURBATIONS.items()}
    assert all(a == b != phrase for a, b in made.values())
    assert sorted(made["phrase-reordered"][0].split()) == sorted(phrase.split())
    assert len(made["phrase-dropped"][0].split()) == 5
    typo = made["phrase-typo"][0].split()
    assert [i for i, w in enumerate(phrase.split()) if typo[i] != w] == [1] and sorted(typo[1]) == sorted("planning")
    drawn = {one(spark, T.reordered(F.lit(phrase), seed))[0] for seed in range(12)}
    assert len(drawn) > 1 and all(w.split()[0] not in T.FUNCTION_WORDS and w.split()[-1] not in T.FUNCTION_WORDS for w in drawn)
    assert one(spark, T.dropped(F.lit("two words"), 1), T.reordered(F.lit("same same"), 1), T.mistyped(F.lit("aaaa b2b2b2 cat"), 1)) == (None, None, None)


def test_parts_fit():
    parts = T.fitting_parts("one two three four five six seven", lambda t: len(t) <= 9)
    assert all(len(p) <= 9 for p in parts) and " ".join(parts).split() == "one two three four five six seven".split()
    assert "".join(T.fitting_parts("x" * 40, lambda t: len(t) <= 9)) == "x" * 40


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
     ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"),
     ("triplicate", "triplic"), ("goodness", "good"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("sky", "sky")],
)
def test_porter_stems(word, stem):
    assert analysis.porter_stem(word) == stem


def test_analyzers(spark):
    text = F.lit("The Cats' 2 ponies, running!")
    assert one(spark, analysis.lexemes(text)) == (["the", "cats", "2", "ponies", "running"],)
    assert one(spark, analysis.lexemes(text, "english")) == (["cat", "2", "poni", "run"],)
    with pytest.raises(ValueError):
        analysis.lexemes(text, "klingon")


def test_identity():
    assert identity.canonical_json({"b": 1, "a": [1, {"d": 2, "c": 3}]}) == '{"a":[1,{"c":3,"d":2}],"b":1}'
    assert identity.fingerprint({"a": 1, "b": 2}) == identity.fingerprint({"b": 2, "a": 1})
    a = identity.embedding_profile("p", "/one/m.gguf", "d", 3, "cosine", 512)
    assert a == identity.embedding_profile("p", "/two/m.gguf", "d", 3, "cosine", 512)
    assert identity.drift({"x": 1, "n": {"a": 1, "b": 2}}, {"x": 1, "n": {"a": 3}}) == [("n.a", 1, 3), ("n.b", 2, None)]


def test_validation():
    validation.check_query("word", 50)
    for args in (("word", 0), ("word", 51), (" ", 5), ("x" * 8001, 5), ("word", 5, 500, 512)):
        with pytest.raises(ValueError):
            validation.check_query(*args)
    assert validation.check_collection_name(" papers-1 ") == "papers-1"
    for bad in ("", "-x", "a b", "x" * 101):
        with pytest.raises(ValueError):
            validation.check_collection_name(bad)


def test_sql_functions_agree_with_columns(spark):
    from sparkfathom.functions import sql

    sql.register(spark)
    row = spark.sql(
        "SELECT cosine_distance(array(1D, 0D), array(1D, 1D)) c, l2_distance(array(1D, 0D), array(0D, 1D)) l, inner_product(array(2D, 1D), array(1D, 1D)) d, "
        "vector_normalise(array(3D, 4D)) n, vector_normalise(array(0D)) z, lexemes('The Cat-2') t, longest_run('a bcd') r, text_preview(' a  b ') p"
    ).first()
    assert row.c == pytest.approx(1 - 2**-0.5) and row.l == pytest.approx(2**0.5) and row.d == 3.0
    assert (row.n, row.z, row.t, row.r, row.p) == ([0.6, 0.8], [0.0], ["the", "cat", "2"], 3, "a b")
    spark.createDataFrame([(1, "a b c d e"), (2, None)], "id int, t string").createOrReplaceTempView("chunk_input")
    rows = spark.sql("SELECT id, c.* FROM chunk_input, LATERAL chunk_words(t, 3, 1) c ORDER BY chunk_index").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a b c"), (1, 1, "c d e")]


def test_a_long_run_does_not_stop_other_documents(spark, tmp_path):
    from sparkfathom.plans import text_queries

    data = [(1, "a b"), (2, "x" * 100_001 + " tail"), (3, "y" * 100_000), (4, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = text_queries.chunk_documents(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.chunk_index, r.n_tokens) for r in rows] == [(1, 0, 2), (2, 0, 2), (3, 0, 1)]
    assert [r.content_sha256 for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for _, t in data[:3]]
    errors = docs.select("doc_id", chunking.run_error(docs["text"]).alias("e")).where("e is not null").collect()
    assert [(r.doc_id, r.e) for r in errors] == [(2, "unbroken run of 100001 characters, over 100000")]
