"""The filter audit against plain Python, and its walk over the orders."""

import itertools
import re

import numpy as np
import pytest

from sparkfathom.llm import filter_audit, queries

from . import odd

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """Failed filters of each row, by the letter of the definitions."""
    out = []
    for i, (who, text, *_) in enumerate(rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        bad += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        earlier = any((t or "") == text and w is not None and who is not None and w < who for k, (w, t, *_) in enumerate(rows) if k != i)
        out.append(bad + "E" * earlier)
    return out


def plain_audit(rows, labels):
    bad, out = fails(rows), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {r[3] or "" for r in rows}:
        mine = [(r[0], b) for r, b in zip(rows, bad, strict=True) if (r[3] or "") == part]
        lines, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                before = order[: step - 1]
                redundant = sum(f in b and any(g in b for g in before) for _, b in mine)
                alone = sum(b == f for _, b in mine)
                total[f] += len(here)
                lines.append(["".join(order), step, len(left), len(here), redundant, alone, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), f])
        out += [(part, *line[:-1], total[line[-1]]) for line in lines]
    return sorted(out)


def test_plain_changes_visit_every_order_by_swaps_of_neighbours():
    visits = list(filter_audit.plain_changes(5))
    assert len({order for order, _ in visits}) == len(visits) == 120
    for (before, _), (after, i) in itertools.pairwise(visits):
        swapped = list(before)
        swapped[i], swapped[i + 1] = swapped[i + 1], swapped[i]
        assert tuple(swapped) == after


def test_walk_takes_two_steps_an_order_and_shapley_shares_all_removed():
    counts = np.random.default_rng(1).integers(0, 50, (3, 4, 32))
    walk = filter_audit.Walk(*counts).run()
    assert walk.updates == 5 + 2 * 119
    assert (walk.shapley.sum(axis=0) == 120 * counts[0][:, 1:].sum(axis=1)).all()
    kept = walk.steps[:, -1, filter_audit.COUNTS.index("kept")]
    assert (kept == counts[0][:, 0]).all()


@pytest.fixture(scope="module")
def rows():
    made = [r for r in odd.rows() if len(r[1] or "") < 100_000]
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words) + " #", " ".join(["same"] * 60), "AAA " + " ".join(words), " ".join(words).upper(), "İstanbul " * 55]
    made += [(100 + i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts * 3)]
    made += [(90, texts[0], "en", None, 1), (90, texts[0], "en", "s1", 1), (None, texts[0], "en", "s1", 1)]
    return made


def test_awkward_rows_against_plain_python(spark, tmp_path, rows):
    labels = [(100, 1, 0), (101, 1, 1), (101, 0, 1), (104, None, 1), (None, 1, 1), (12, 1, 0), (90, 1, 1)]
    sf = odd.write(spark, tmp_path, documents=odd.table(spark, rows), labels=spark.createDataFrame(labels, LABELS))
    got = queries.op11_filter_audit(spark, sf)
    names = [f.split()[0] for f in filter_audit.SCHEMA.split(", ")]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_no_documents_and_no_labels(spark, tmp_path, rows):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(odd.table(spark, []), labels).count() == 0
    got = filter_audit.audit_filters(odd.table(spark, rows), labels)
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() == 600 * len({r[3] or "" for r in rows})
