import os

import pytest
from pyspark.sql import functions as F

from sparkfathom.__main__ import parser, run
from sparkfathom.engine import Engine
from sparkfathom.operators import embedding
from sparkfathom.sources import files
from sparkfathom.sources.config import ChunkConfig, Config


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


@pytest.fixture
def docs(tmp_path):
    root = str(tmp_path / "docs")
    put(root, "a.txt", "tidal gauges record harmonic tables " * 3)
    put(root, "b.md", "lichen growth marks limestone and membranes")
    put(root, "sub/c.txt", " ".join(f"filler{i}" for i in range(60)) + " rareword at the end")
    put(root, "empty.txt", " ")
    return root


def engine(spark, tmp_path, size=20):
    return Engine(spark, str(tmp_path / "index"), Config(chunk=ChunkConfig(size, 5)), provider=lambda: embedding.HashProvider(16))


def paths(rows):
    return [os.path.basename(r.source_path) for r in rows.orderBy("rank").collect()]


def test_build_promote_search_and_change(spark, tmp_path, docs):
    e = engine(spark, tmp_path)
    counts = e.build("papers", docs)
    assert (counts["documents"], counts["extracted_done"], counts["extracted_failed"], counts["complete"]) == (4, 3, 1, True)
    assert counts["chunks"] == counts["embeddings_done"] > 3
    assert e.promote("papers").result == "blocked_by_failures" and e.promote("papers", force=True).result == "promote"
    assert e.promote("papers").result == "no_ready"
    assert paths(e.search("rareword"))[0] == "c.txt" and paths(e.search("lichen growth limestone", 1)) == ["b.md"]
    assert all(c["ok"] for c in e.check()) and e.health() == {"ok": True, "dimension": 16, "provider": "hash"}

    os.rename(os.path.join(docs, "a.txt"), os.path.join(docs, "sub", "a.txt"))  # moved: keeps its work
    os.remove(os.path.join(docs, "empty.txt"))
    put(docs, "b.md", "lichen growth rewritten about enzymes")
    before = {r.source_path: r.id for r in e.read("documents").collect()}
    assert e.register("papers", docs) == {"new": 0, "moved": 1, "deleted": 1}
    after = {os.path.basename(r.source_path): r.id for r in e.read("documents").collect() if r.status != "deleted"}
    assert after["a.txt"] == before[os.path.join(docs, "a.txt")]
    again = e.build("papers")
    assert (again["documents"], again["extracted_failed"], again["complete"]) == (3, 0, True)
    assert "b.md" in paths(e.search("enzymes")) and e.read("chunks").where("content like '%membranes%'").count() == 0
    assert e.status()[0]["embedded_percent"] == 100.0 and e.collections().first().documents == 3

    changed = engine(spark, tmp_path, 30)  # other chunks: another revision beside the active one
    assert changed.build("papers")["complete"]
    states = {r.id: r.status for r in changed.read("revisions").collect()}
    assert states == {1: "active", 2: "ready"}
    assert not next(c for c in e.check() if c["check"] == "chunk_drift")["ok"]
    assert changed.promote("papers").result == "promote"
    assert {r.id: r.status for r in changed.read("revisions").collect()} == {1: "retired", 2: "active"}
    assert paths(changed.search("rareword"))[0] == "c.txt"

    assert changed.remove("papers") and not changed.remove("papers") and changed.read("vectors").isEmpty()


def test_collections_do_not_mix_and_nothing_is_found_in_none(spark, tmp_path, docs):
    e = engine(spark, tmp_path)
    other = str(tmp_path / "other")
    put(other, "d.txt", "tidal gauges elsewhere")
    e.build("one", docs)
    e.build("two", other)
    assert set(paths(e.search("tidal gauges", 10, ["two"]))) == {"d.txt"}
    assert "d.txt" not in paths(e.search("tidal gauges", 10, ["one"]))
    assert engine(spark, tmp_path / "fresh").search("anything").count() == 0
    with pytest.raises(ValueError):
        e.search(" ")
    with pytest.raises(ValueError):
        e.register("bad name", docs)
    with pytest.raises(ValueError):
        e.register("one", docs + "-missing")


def test_commands(spark, tmp_path, docs):
    call = lambda *argv: run(spark, parser().parse_args(["--root", str(tmp_path / "cli"), *argv]))
    assert call("build", docs, "-c", "papers")[0]["documents"] == 4
    assert call("promote", "papers", "--force")[0]["result"] == "promote"
    assert call("search", "rareword", "-k", "1")[0]["source_path"].endswith("c.txt")
    assert call("status")[0]["collection"] == "papers" and call("collections")[0]["active"] == 1
    assert {c["check"] for c in call("doctor")} >= {"stranded_chunkings", "orphan_vectors", "chunk_budget"}
    assert call("config")[0]["chunk"]["size"] == 320
    assert len(call("extract", docs)) == 4
    chunks = call("chunk", os.path.join(docs, "b.md"))
    assert chunks == [{"chunk_index": 0, "content": "lichen growth marks limestone and membranes"}]
    lines = put(docs, "x.jsonl", '{"chunk_index": 0, "content": "a b"}\n')
    assert len(call("embed", lines)[0]["embedding"]) == 16
    assert call("remove", "papers") == [{"removed": True}]


def test_a_refused_chunking_fails_alone(spark, tmp_path, docs):
    put(docs, "long.txt", "z" * 100_001)
    e = engine(spark, tmp_path)
    counts = e.build("papers", docs)
    assert (counts["extracted_done"], counts["chunked_done"], counts["chunked_failed"], counts["complete"]) == (4, 3, 1, True)
    failed = e.read("chunked").where("status = 'failed'").collect()
    assert [(r.total_chunks, r.error_message) for r in failed] == [(0, "unbroken run of 100001 characters, over 100000")]
    assert counts["chunks"] == counts["embeddings_done"] > 3 and e.chunk(e.target("papers")) == 0
    with pytest.raises(ValueError, match="unbroken run"):
        run(spark, parser().parse_args(["chunk", os.path.join(docs, "long.txt")]))
    put(docs, "long.txt", "short again")
    assert e.build("papers", docs)["chunked_failed"] == 0


def test_a_stage_that_dies_is_given_up_after_three_claims(spark, tmp_path, docs, monkeypatch):
    e = engine(spark, tmp_path)

    def dies(content):
        raise RuntimeError("out of memory")

    work = e.registry.extract
    monkeypatch.setattr(e.registry, "extract", dies)
    for n in (1, 2, 3):
        with pytest.raises(RuntimeError):
            e.build("papers", docs)
        assert {(r.status, r.attempts) for r in e.read("extracted").collect()} == {("processing", n)}
    monkeypatch.setattr(e.registry, "extract", work)
    counts = e.build("papers", docs)
    assert counts["extracted_failed"] == 4
    assert {r.error_message for r in e.read("extracted").collect()} == {"interrupted 3 times in a row"}
    put(docs, "b.md", "other words now")  # another content starts anew
    assert e.build("papers", docs)["extracted_done"] == 1


def test_failed_work_is_tried_again_and_reindex_keeps_extractions(spark, tmp_path, docs):
    e = engine(spark, tmp_path)
    first = e.build("papers", docs)
    rows = e.read("embeddings")
    e.write("embeddings", rows.withColumn("status", F.when(F.col("chunk_id") == rows.agg(F.min("chunk_id")).first()[0], "failed").otherwise(F.col("status"))))
    assert e.build("papers")["embeddings_done"] == first["embeddings_done"]
    before = {r.id: r.chunk_id for r in e.read("chunks").selectExpr("document_id AS id", "chunk_id").collect()}
    stamps = {r.id: r.content_hash for r in e.read("extracted").collect()}
    again = e.reindex("papers")
    assert again["complete"] and again["chunks"] == first["chunks"]
    assert {r.id: r.content_hash for r in e.read("extracted").collect()} == stamps
    assert before.keys() == {r.document_id for r in e.read("chunks").collect()}


def test_promotion_loses_a_race(spark, tmp_path, docs, monkeypatch):
    e = engine(spark, tmp_path)
    e.build("papers", docs)
    counts = e.counts

    def meanwhile(revision):
        made = counts(revision)
        e.write("revisions", e.read("revisions"))
        return made

    monkeypatch.setattr(e, "counts", meanwhile)
    assert e.promote("papers", force=True).result == "lost_race"
    monkeypatch.undo()
    assert e.promote("papers", force=True).result == "promote"


def test_a_file_that_is_too_large_is_refused_with_its_reason(spark, tmp_path, docs, monkeypatch):
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 200)
    e = engine(spark, tmp_path)
    counts = e.build("papers", docs)
    assert (counts["documents"], counts["extracted_done"], counts["extracted_failed"], counts["complete"]) == (4, 2, 2, True)
    assert "file is over 200 bytes" in {r.error_message for r in e.read("extracted").collect()}


def test_search_reads_the_index_and_a_build_repairs_it(spark, tmp_path, docs):
    import shutil

    e = engine(spark, tmp_path)
    e.build("papers", docs)
    index = e.text_index()
    assert len(index.segments()) == 1 and not os.path.exists(f"{e.root}/_stage")
    searcher = e.searcher()
    searcher.corpus.chunks = searcher.corpus.chunks.withColumn("content", F.lit("not read"))
    assert paths(searcher.search("rareword", e.provider().embed(["rareword"])[0], 3))[0] == "c.txt"

    shutil.rmtree(f"{e.root}/text_index/data/{index.segments()[0]['segment']}")
    state = e._text_index_state()
    assert not state["ok"] and state["detail"].startswith("1 damaged")
    assert e.searcher().corpus.index is None  # texts are read until a build has repaired it
    put(docs, "d.txt", "a later document about rareword sediments")
    e.build("papers", docs)
    assert e._text_index_state()["ok"] and {"c.txt", "d.txt"} <= set(paths(e.search("rareword")))
