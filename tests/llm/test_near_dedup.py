import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfathom.llm import components, near_dedup, shingles

from . import odd


def brute(rows, width, percent):
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text, *_ in rows:
        if i is None:
            continue
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - width + 1)
        sets[i] = {tuple(words[k : k + width]) for k in range(n)} if words else set()
        parent[i] = i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(seed, n_groups, size, words=60, edits=6):
    rng = random.Random(seed)
    out = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return [(i, t, None, None, None) for i, t in enumerate(out)]


@pytest.mark.parametrize("width", [4, 5])
def test_odd_rows_match_brute_force(spark, width):
    got = near_dedup.near_groups(odd.table(spark), width=width)
    want = brute(odd.rows(), width, 80)
    for r in got.collect():
        if r.ident is None:
            assert r.component is None
        else:
            assert (r.n_shingles, r.component) == want[r.ident], r.ident
    assert got.count() == len(odd.rows())


def test_chains_and_bridges_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    data = near_texts(3, 12, 25)
    got = near_dedup.near_groups(odd.table(spark, data), width=4)
    want = brute(data, 4, 80)
    assert {r.ident: (r.n_shingles, r.component) for r in got.collect()} == want


def test_empty_table(spark):
    assert near_dedup.near_groups(odd.table(spark, [])).count() == 0
    assert near_dedup.near_groups(odd.table(spark, [(1, None, None, None, None)])).first().component == 1


def test_drop_keeps_the_smallest(spark):
    docs = odd.table(spark)
    kept = near_dedup.drop_near_copies(docs, width=4)
    want = brute(odd.rows(), 4, 80)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {i for i, (_, c) in want.items() if i == c} | {None}


def test_a_hot_group_of_copies_is_one_component(spark):
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "a hot text of several common words here").otherwise(F.col("id").cast("string")).alias("text"),
    )
    got = near_dedup.near_groups(docs)
    assert got.where("component = 0").count() == 300
    assert got.where("component = ident").count() == 601


def test_pigeonhole_keys_cover_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    for wrong in range(near_dedup.DISTANCE + 1):
        a = rng.integers(0, 2**16, near_dedup.SIZE, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(near_dedup.SIZE, wrong, False)
        b[at] ^= np.uint16(1)
        keys = near_dedup.keys_of(np.stack([a, b]))
        shared = set(keys[0]) & set(keys[1])
        assert shared
        number = near_dedup.first_shared_key((a != b)[None, :])[0]
        assert number == min(k >> 48 for k in shared)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 5, 100, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[: max(1, int(len(a) * 0.9))]
        ok = near_dedup.may_link(
            near_dedup.bitmap(a), len(a), near_dedup.bitmap(keep), len(keep), 80
        )
        both = len(np.intersect1d(a, keep))
        assert ok or 100 * both < 80 * (len(a) + len(keep) - both)


def test_overlaps_agree():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 80)).astype(np.uint64)) for _ in range(40)]
    for one in sets:
        assert near_dedup.overlaps(one, sets).tolist() == [len(np.intersect1d(one, x)) for x in sets]


@pytest.mark.parametrize("tile", [4, 1024])
def test_tiles_alone_find_every_link(spark, monkeypatch, tile):
    """Without hub rounds the tiles must do all the work."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "likeliest_hubs", lambda active, turn: spark.createDataFrame([], "a long, b long"))
    data = near_texts(4, 6, 20)
    got = near_dedup.near_groups(odd.table(spark, data), width=5)
    assert {r.ident: (r.n_shingles, r.component) for r in got.collect()} == brute(data, 5, 80)


def test_a_large_group_behind_a_foreign_hub_gives_few_rows(spark, monkeypatch):
    """Members that share keys with a text that is no copy of theirs, with the smallest identifier."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = [" ".join(base[:70] + [f"x{i}" for i in range(40)])]
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(100)] = f"e{i}"
        texts.append(" ".join(copy))
    data = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows = {}
    keep = near_dedup.shared.materialise

    def counting(df, name, **options):
        made = keep(df, name, **options)
        rows[name] = max(rows.get(name, 0), made.count())
        return made

    monkeypatch.setattr(near_dedup.shared, "materialise", counting)
    got = near_dedup.near_groups(odd.table(spark, data), width=5)
    assert {r.ident: (r.n_shingles, r.component) for r in got.collect()} == brute(data, 5, 80)
    assert rows["near-stars"] <= len(data) and rows["near-links"] <= len(data)
    assert rows["near-tiles"] <= len(data)


def test_one_identifier_with_several_texts(spark):
    """Rows of one identifier are one document: it may link groups that are apart."""
    one, two = ([f"{c}{i}" for i in range(30)] for c in "ab")
    texts = [(5, one), (5, two), (1, [*one, "end"]), (2, [*two, "end"]), (3, ["alone"])]
    data = [(i, " ".join(t), None, None, None) for i, t in texts] * 2
    got = near_dedup.near_groups(odd.table(spark, data)).select("ident", "component").distinct().collect()
    assert {(r.ident, r.component) for r in got} == {(5, 1), (1, 1), (2, 1), (3, 3)}


def test_short_and_long_signatures_are_stable():
    m = shingles.MinHash(8)
    s = np.arange(5000, dtype=np.uint64)
    assert (m.signature(s) == m.signature(s[::-1])).all()


def test_components_of_a_path_and_a_loop(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = components.components(spark.createDataFrame(path, "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingle_sets_are_those_of_the_words(width):
    rng = random.Random(6)
    texts = [b"", b" \t\n", b"One", b"a B\x0bc\x0cd\r\ne f", "é　x \xa0 y".encode(), b"x" * 65 + b" " + b"x" * 64, b"x" * 5000]
    texts += [" ".join(rng.choice(["ab", "Ab", "b", "c" * 70, "dé"]) for _ in range(rng.randrange(200))).encode() for _ in range(50)]
    texts.append(b"long word " * 200_000)
    names = {}
    for text, got in zip(texts, shingles.shingle_sets(texts, width), strict=True):
        words = text.lower().split()
        size = min(width, len(words))
        want = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()
        assert len(got) == len(want)
        for shingle in want:  # equal shingles have equal hashes whatever the text
            names.setdefault(shingle, set()).add(got.tobytes() if len(want) == 1 else None)
    assert all(len(x) <= 2 for x in names.values())
