"""Spelling variants against comparisons of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from sparkfathom.llm import queries, spelling

from . import odd


def plain_words(rows):
    found = Counter()
    for who, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if who is not None and (h := zlib.crc32(f"{who}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, times=10):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants(rng, word):
    letters = "abcdeéß÷"
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind != 1) :]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    made = Counter({"aaaaaaa": 5000, "aaaaaaaa": 400, "aaaaaaaaa": 40, "aaaaaaaaaa": 3, "abababab": 30, "babababa": 3000, "antidisestablishmentarianism": 700})
    for base in ("thereabouts", "crème brûlée".replace(" ", ""), "aabbaabb", "straßenbahn", "antidisestablishmentarianism"):
        made[base] += 2000
        for _ in range(120):
            word = variants(rng, base)
            made[word] += rng.choice([2, 3, 19, 200])
            made[variants(rng, word)] += 2
    return {w: n for w, n in made.items() if len(w) >= 7}


@pytest.mark.parametrize("two_only", [False, True])
def test_all_pairs_agree(spark, words, two_only):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variant_groups(df, two_only=two_only).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(words)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain


def test_awkward_documents(spark, tmp_path):
    rows = odd.rows() + [(200 + i, "Straßenbahn strassenbahn STRASSENBAHN ÀÉÎÕÜãä ÀÉÎÕÜãäx×÷ thereabouts " * (1 + i % 3), "de", "s", 1) for i in range(60)]
    rows += [(None, "thereabouts thereaboots " * 3, None, None, None)]
    sf = odd.write(spark, tmp_path, documents=odd.table(spark, rows))
    got = queries.op12_spelling(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_words(rows))
    assert any(r[1] for r in want)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_words_of_all_tasks_are_added_up(spark):
    rows = [(i, f"alphabet{'abcdefgh'[i % 8] * 3} common words", None, None, None) for i in range(64)]
    got = {r.word: r.n for r in spelling.word_counts(odd.table(spark, rows)).collect()}
    assert got == plain_words(rows)


def test_no_documents(spark):
    assert spelling.variants_of(odd.table(spark, [])).count() == 0
    assert spelling.variants_of(odd.table(spark, [(1, None, None, None, None), (2, "short words", None, None, None)])).count() == 0
