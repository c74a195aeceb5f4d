import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkfathom.llm import queries

from . import odd
from .test_quality import junk, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(240):
        good = i % 5 != 0
        text = (prose if good else junk)(rng, rng.randrange(30, 90))
        data.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    for i in range(240, 260):
        data.append((i, data[i - 239][1].upper() if i % 2 else data[i - 239][1], "en", "s0", 1))
    for i in range(260, 280):
        words = data[i - 259][1].split()
        data.append((i, " ".join([*words, "indeed"]), "en", "s1", 1))
    path = str(tmp_path_factory.mktemp("sf"))
    odd.table(spark, data, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_stages_in_order_change_what_they_should(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    assert all(df.columns == columns for df in seen[:-1])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    good = {i for i in range(240) if i % 5}
    assert len(ids[1] & good) >= 0.95 * len(good) and len(ids[1] - good - set(range(240, 280))) <= 5
    lower = lambda t: t.lower()
    kept = [lower(r.text) for r in seen[2].select("text").collect()]
    assert len(kept) == len(set(kept)) == len({lower(r.text) for r in seen[1].select("text").collect()})
    assert ids[3] < ids[2] and ids[4] <= ids[3]
    words = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words(seen[4]) == words(seen[3])
    last = seen[5]
    assert last.where("not parity or not round_trip").count() == 0 and last.count() == seen[4].count()


def test_run_gives_the_rows_of_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_their_contract(spark, sf_dir, name):
    want = {
        "op1_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
        "op2_near_dedup": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
        "op3_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
        "op4_sentencepiece": "doc_id:bigint token_ids:array<int> n_tokens:bigint",
        "op5_pii": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
        "op6_exact_dedup": "doc_id:bigint keep_id:bigint group_size:bigint kept:boolean text_sha256:string",
        "op7_secrets": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
        "op8_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
        "op9_nearest": "query_id:bigint rank:int vec_id:bigint score:double",
        "op10_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    }[name]
    got = queries.QUERIES[name](spark, sf_dir)
    types = dict(got.dtypes)
    assert all(types[c.split(":", 1)[0]] == c.split(":", 1)[1] for c in want.split())
    assert got.count() == (100 if name == "op9_nearest" else 280)
