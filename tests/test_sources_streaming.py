import json
import os

import pytest
from pyspark.sql import functions as F

from sparkfathom.operators import embedding as E
from sparkfathom.sources import config, files, sinks
from sparkfathom.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    for name, body in {
        "a.txt": b"plain text", "sub/b.md": "café \u0000end".encode(), "bad.txt": b"broken \xff byte", "empty.txt": b"  \n", "c.bin": b"x",
        ".git/d.txt": b"no", "node_modules/x/e.txt": b"no", "upper.TXT": b"loud", "f.cmd": b"run me",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(tmp_path)


def test_scan_admits_supported_files_outside_ignored_directories(spark, tree):
    os.symlink(f"{tree}/a.txt", f"{tree}/link.txt")
    names = {r.path.rsplit("/", 1)[-1] for r in files.scan(spark, tree, content=False).collect()}
    assert names == {"a.txt", "b.md", "bad.txt", "empty.txt", "upper.TXT"}
    assert "content" not in files.scan(spark, tree, content=False).columns


def test_extraction_isolates_errors(spark, tree):
    registry = files.default_registry()
    registry.register("shout", (".cmd",), files.command_extractor(["tr", "a-z", "A-Z"]))
    registry.register("echo", (".cmd",), files.command_extractor(["cat", "{path}"]))
    found = registry.extract(files.scan(spark, tree, registry.suffixes()), {".cmd": "echo"})
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in found.collect()}
    assert got["a.txt"] == ("plain text", None) and got["b.md"][0] == "café end" and "�" in got["bad.txt"][0]
    assert got["empty.txt"][1] == "extraction is empty" and got["f.cmd"] == ("run me", None)
    broken = files.Registry()
    broken.register("fails", (".cmd",), files.command_extractor(["false"]))
    (row,) = broken.extract(files.scan(spark, tree, (".cmd",))).collect()
    assert row.text is None and "exit 1" in row.error
    with pytest.raises(ValueError):
        registry.resolve(".xyz")
    with pytest.raises(ValueError):
        registry.resolve(".txt", "shout")


def test_chunk_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"chunk_index": 0, "content": "a"}\nnot json\n{"chunk_index": 2, "content": " "}\n')
    assert [r.invalid for r in files.read_chunks_jsonl(spark, str(path), strict=False).collect()] == [False, True, True]
    with pytest.raises(Exception, match="invalid chunk line"):
        files.read_chunks_jsonl(spark, str(path)).collect()


def test_readers_see_the_old_or_the_new_version(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "v"))
    table.replace(spark.range(3))
    held, first = table.read(), table.version()
    seen = []

    class Watched:
        """Reads the table while its next version is being written."""

        def __init__(self, df):
            self.df, self.write = df, self

        def parquet(self, path):
            seen.append(table.read().count())
            self.df.write.parquet(path)
            seen.append(table.read().count())

    table.replace(Watched(spark.range(5)))
    assert seen == [3, 3] and table.read().count() == 5 and held.count() == 3
    with pytest.raises(sinks.Changed):
        table.replace(spark.range(1), expect=first)
    table.replace(spark.range(7), expect=table.version())
    assert table.vacuum(1) == 2 and table.read().count() == 7 and table.vacuum(1) == 0


def test_versioned_table(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *xs: spark.createDataFrame(list(xs), "chunk_id long, v int, collection string")
    assert not table.exists() and table.is_empty()
    table.upsert(rows((1, 0, "a"), (2, 0, "a")), "chunk_id", "v", ("collection",))
    table.upsert(rows((2, 1, "b"), (2, 2, "c")), "chunk_id", "v")
    assert sorted(map(tuple, table.read().collect())) == [(1, 0, "a"), (2, 2, "c")]
    assert table.append(rows((3, 0, "a"))) == 1 and table.read().count() == 3
    with pytest.raises(ValueError):
        table.upsert(rows((4, 0, None)), "chunk_id", "v", ("collection",))
    assert sorted(json.loads(x)["chunk_id"] for x in sinks.json_lines(table.read())) == [1, 2, 3]
    assert json.loads(sinks.json_document(rows((1, 1, None)), ok=True)) == {"ok": True, "rows": [{"chunk_id": 1, "v": 1, "collection": None}]}


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda *xs: spark.createDataFrame(list(xs), "k int, x string")
    sinks.replace_partitions(rows((1, "a"), (2, "b")), path, "k")
    sinks.replace_partitions(rows((2, "c")), path, "k")
    assert sorted((r.k, r.x) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_configuration_order(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("n_ctx = 1024\n[chunk]\nsize = 100\noverlap = 10\n[search]\nhybrid = false\n")
    got = config.load(str(path), {"SPARKFATHOM_CHUNK_SIZE": "200", "SPARKFATHOM_SEARCH_HYBRID": "yes"})
    assert (got.chunk.size, got.chunk.overlap, got.n_ctx, got.search.hybrid) == (200, 10, 1024, True)
    with pytest.raises(ValueError):
        config.load(None, {"SPARKFATHOM_CHUNK_SIZE": "505"})
    path.write_text("[chunk]\nshape = 1\n")
    with pytest.raises(ValueError):
        config.load(str(path), {})


def test_snapshot_difference_and_renames(spark):
    known = spark.createDataFrame([(1, "/r/a/x.txt", "h1"), (2, "/r/b.txt", "h2"), (3, "/r/c.txt", "h3"), (4, "/else/d.txt", "h4")], "id long, path string, file_hash string")
    now = spark.createDataFrame([("/r/z/x.txt", "h1"), ("/r/b.txt", "h9"), ("/r/c.txt", "h3")], "path string, file_hash string")
    change = {r.path: r.change for r in ingest.snapshot_diff(now, known).collect()}
    assert change == {"/r/a/x.txt": "deleted", "/r/z/x.txt": "created", "/r/b.txt": "modified", "/else/d.txt": "deleted"}
    gone = ingest.missing(known, now, ["/r"])
    assert [r.id for r in gone.collect()] == [1]
    created = now.join(known.select("path"), "path", "left_anti")
    assert [(r.id, r.path) for r in ingest.renamed(gone, created).collect()] == [(1, "/r/z/x.txt")]
    docs = known.withColumn("status", F.lit("active"))
    after = {r.id: (r.status, r.file_hash) for r in ingest.tombstoned(docs, gone).collect()}
    assert after[1] == ("deleted", None) and after[2] == ("active", "h2")


def test_debounce_keeps_the_last_event(spark):
    rows = [("/a", 1, "create"), ("/a", 3, "delete"), ("/a", 2, "modify"), ("/b", 1, "create")]
    got = ingest.debounced(spark.createDataFrame(rows, "path string, ts long, kind string"))
    assert {r.path: (r.ts, r.kind) for r in got.collect()} == {"/a": (3, "delete"), "/b": (1, "create")}


def test_stage_claims_works_and_writes(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "one two"), (2, ""), (3, "three")], "id long, content string").write.parquet(src)
    stream = spark.readStream.schema("id long, content string").parquet(src)
    work = lambda df: E.embed(df, lambda: E.HashProvider(4))
    query = ingest.stage(stream, lambda df: df.where("content != ''"), work, lambda df: df.write.mode("append").parquet(out), str(tmp_path / "ck"), {"availableNow": True}).start()
    query.awaitTermination(60)
    rows = spark.read.parquet(out).collect()
    assert {r.id for r in rows} == {1, 3} and all(len(r.embedding) == 4 and r.error is None for r in rows)


class Picky(E.HashProvider):
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise E.Refused("refused")
        return super().embed(texts)


def test_refused_texts_fail_alone_and_long_ones_are_pooled():
    provider = Picky(8, n_ctx=13)
    texts = ["good one", "bad one", "fine", " ".join(f"w{i}" for i in range(40)), "other"]
    got = E.embed_batch(provider, texts)
    assert [e is None for _, e in got] == [True, False, True, True, True]
    assert got[1][0] is None and abs(sum(x * x for x in got[3][0]) - 1) < 1e-9
    assert got[0][0] == provider.embed(["good one"])[0]


def test_count_mismatch_is_an_error():
    class Short(E.HashProvider):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    with pytest.raises(RuntimeError):
        E.embed_batch(Short(4), ["a", "b"])


def test_canary_verdicts(spark):
    table = lambda *xs: spark.createDataFrame(list(xs), "text string, vector array<double>")
    stored = table(("a", [1.0, 0.0]), ("b", [0.0, 1.0]))
    assert E.canary(stored, stored) == "identical"
    assert E.canary(stored, table(("a", [1.0, 0.01]), ("b", [0.0, 1.0]))) == "scheduling"
    assert E.canary(stored, table(("a", [0.5, 0.5]), ("b", [0.0, 1.0]))) == "semantic"


def test_ignored_directories_below_any_root(spark):
    rows = spark.createDataFrame([("/a/.git/x.txt",), ("/a/b/x.txt",), ("/.git/a/x.txt",)], "path string")
    seen = lambda root: [r.x for r in rows.select(files.in_ignored_directory(F.col("path"), root).alias("x")).collect()]
    assert seen("/") == [True, False, True] and seen("/a")[:2] == [True, False]
    below = spark.createDataFrame([("/.git/a/x.txt",)], "path string")
    assert not below.select(files.in_ignored_directory(F.col("path"), "/.git")).first()[0]
