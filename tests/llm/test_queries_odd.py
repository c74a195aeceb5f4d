"""Registered queries over awkward documents, against plain Python."""

import re
import zlib
from collections import Counter
from types import SimpleNamespace

import pytest

from sparkfathom.llm import queries, shared

from . import odd
from .test_mixing import brute_targets


def n_words(text):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(14)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int"
    )
    return odd.write(spark, tmp_path_factory.mktemp("odd"), documents=odd.table(spark), labels=labels)


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return odd.write(spark, tmp_path_factory.mktemp("none"), documents=odd.table(spark, []), labels=labels)


def test_sharding_sizes_and_checksums(spark, sf_dir):
    got = queries.op1_sharding(spark, sf_dir).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd.rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in sorted(counts) for k in range(counts[s])]
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_mixing_targets_and_words_taken(spark, sf_dir):
    got = queries.op3_mixing(spark, sf_dir).collect()
    rows = [(i, n_words(t), source) for i, t, _, source, _ in odd.rows()]
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for i, n, _ in rows)
    names = ["s1", "s2", None]
    sizes = [sum(n for _, n, s in rows if s == name) for name in names]
    target = dict(zip(names, brute_targets(sizes, [5, 2, 1]), strict=True))
    source_of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        name = source_of[r.doc_id]
        assert r.source_size == sizes[names.index(name)] and r.target == pytest.approx(target[name])
        assert 0 <= r.taken <= 3 * r.size
        taken[name] += r.taken
    assert all(abs(taken[name] - target[name]) <= 1 for name in names)
    again = queries.op3_mixing(spark, sf_dir).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_quality_scores_every_row(spark, sf_dir):
    got = queries.op10_quality(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in odd.rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("name", ["op1_sharding", "op3_mixing", "op10_quality"])
def test_empty_documents(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(
        master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.scratch_dir(SimpleNamespace(conf={}, sparkContext=context))
