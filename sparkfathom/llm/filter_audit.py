"""What the order of filters changes: counts for every order, and Shapley values.

A document's outcome under any order depends only on which filters it fails, so the
table is reduced to cells first: per part and set of failed filters the number of
documents. The orders are then visited by swapping two neighbouring filters at a
time (plain changes), which alters two steps; only these are taken from the cells
again, and the Shapley sums grow along the walk.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfathom.llm import shared

#: Letters of the five filters; the letter at place i has the bit 1 << i.
FILTERS = "ABCDE"

#: The counts of a step, in the order of the result's columns.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = re.compile(rb"[#$%&*|]")

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def plain_changes(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """All orders of ``0..n-1``; each but the first comes with the place it was swapped at.

    The swap exchanged that place and the next one, so consecutive orders differ
    in two neighbours only.
    """
    order, heading = list(range(n)), [-1] * n
    yield tuple(order), None
    for _ in range(math.factorial(n) - 1):
        at = {x: i for i, x in enumerate(order)}
        free = [x for x in order if 0 <= (to := at[x] + heading[x]) < n and order[to] < x]
        x = max(free)
        i, to = at[x], at[x] + heading[x]
        order[i], order[to] = order[to], order[i]
        for y in range(x + 1, n):
            heading[y] = -heading[y]
        yield tuple(order), min(i, to)


def failed_by_text(text: bytes) -> int:
    """The mask of the filters A to D that a UTF-8 text fails."""
    words = text.split()  # bytes: exactly the ASCII white space of the word rule
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    code_points = len(text) if text.isascii() else len(text.decode())
    short = len(words) < 50
    repeated = 100 * len(set(words)) < 65 * len(words)
    return short | repeated << 1 | (100 * capitals > 5 * code_points) << 2 | (_MARKS.search(text) is not None) << 3


def masks_and_digests(texts: pa.Array) -> list[pa.Array]:
    """The mask of A to D and the SHA-256 digest of each text; a null one is empty."""
    raw = [x.as_py() or b"" for x in texts.cast(pa.large_binary())]
    return [pa.array([failed_by_text(x) for x in raw], pa.int32()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and set of failed filters.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns do not matter. A
    null text is empty, a null source is the part ''. A row fails E if a row with a
    smaller identifier has the same text; one without an identifier never does.
    Rows with one identifier are rows of their own. A document is good (toxic) if
    any label of its identifier says so.

    Each row is reduced to a digest and a mask where it is read; equal rows are
    counted before each exchange, so neither copies nor a hot source gather.
    """
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    made = [T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]
    rows = shared.with_arrow_columns(named, ["doc_id", "part"], F.col("text"), made, lambda: masks_and_digests)
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))

    says = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality"), says("toxic"))
    # Rows without an identifier match no label; a salt keeps them from one task.
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    known = known.withColumn("salt", F.lit(0).cast("long"))
    rows = salted.join(known, ["doc_id", "salt"], "left").na.fill(0, ["quality", "toxic"])

    group = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    stay = F.col("nameless") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split_up = group.withColumn("least", least).withColumn("stay", stay)
    parted = split_up.select(
        "part", "quality", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")),
            F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")),
        )),
    )
    return (
        parted.where("n > 0")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    )


class Walk:
    """The steps of every order for a batch of parts, by single swaps.

    ``n``, ``good`` and ``toxic`` have a row for each part and a column for each
    mask. After ``run``, ``steps`` is indexed by order, step, count and part, and
    ``shapley`` by filter and part.
    """

    def __init__(self, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int = len(FILTERS)) -> None:
        self.n, self.good, self.toxic, self.filters = n, good, toxic, filters
        self.masks = np.arange(1 << filters)
        self.orders: list[tuple[int, ...]] = []
        self.updates = 0

    def step(self, before: int, f: int) -> np.ndarray:
        """The counts of filter ``f`` after the filters of the set ``before``."""
        self.updates += 1
        fails, gone = (self.masks >> f) & 1 == 1, self.masks & before != 0
        here = fails & ~gone
        return np.stack([
            self.n[:, ~fails & ~gone].sum(axis=1),
            self.n[:, here].sum(axis=1),
            self.n[:, fails & gone].sum(axis=1),
            self.n[:, 1 << f],
            self.good[:, here].sum(axis=1),
            self.toxic[:, here].sum(axis=1),
        ])

    def run(self) -> Walk:
        parts, k = len(self.n), self.filters
        self.steps = np.empty((math.factorial(k), k, len(COUNTS), parts), dtype=np.int64)
        self.shapley = np.zeros((k, parts), dtype=np.int64)
        now = np.empty((k, len(COUNTS), parts), dtype=np.int64)
        for visit, (order, swapped) in enumerate(plain_changes(k)):
            for i in range(k) if swapped is None else (swapped, swapped + 1):
                now[i] = self.step(sum(1 << f for f in order[:i]), order[i])
            self.steps[visit] = now
            self.shapley[list(order)] += now[:, COUNTS.index("removed")]
            self.orders.append(order)
        return self


def audit(cell_rows: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; empty without cells.

    A part has one cell for each set of failed filters, 32 at most, so its cells
    are one small row whatever the size of the table.
    """
    gathered = cell_rows.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    shared.modest_batches(cell_rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            filled = np.zeros((3, len(names), 1 << len(FILTERS)), dtype=np.int64)
            owner = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
            inner = lists.flatten()
            mask = inner.field("mask").to_numpy()
            for i, name in enumerate(("n", "good", "toxic")):
                filled[i, owner, mask] = inner.field(name).to_numpy()
            walk = Walk(*filled).run()
            labels = ["".join(FILTERS[f] for f in order) for order in walk.orders]
            per_part = len(labels) * len(FILTERS)
            order_col = pa.array(np.repeat(labels, len(FILTERS)), pa.string())
            step_col = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(labels)))
            filter_at = np.array(walk.orders).reshape(-1)
            for p, name in enumerate(names.to_pylist()):
                counts = walk.steps[:, :, :, p].reshape(per_part, len(COUNTS))
                columns = [pa.array([name] * per_part, pa.string()), order_col, step_col]
                columns += [pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(COUNTS))]
                columns.append(pa.array(walk.shapley[filter_at, p]))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return gathered.mapInArrow(shared.tidy(run), SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``; see ``cells`` for odd rows."""
    return audit(cells(docs, labels))
