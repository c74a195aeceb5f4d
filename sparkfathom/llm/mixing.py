"""Mixing sources to target weights by index arithmetic over packed blocks.

1. Pack: the words of each source's documents form one stream, cut into blocks
   of ``BLOCK`` words. A document's place in the stream comes from two levels of
   running sums, so no task gets a whole source.
2. Draw: targets give each source a number of blocks, and each output shard
   draws its counts by source from a multinomial law over what is left to give.
3. Map: the j-th block that a source gives is block ``permutation(j)`` of its
   stream; the permutation is computed from j alone (a keyed Feistel network
   walked until it falls inside the range) and differs for each pass.
4. Join: slots meet documents on (source, block).

A target is met to the word: whole passes over the source, then the first
blocks of a last pass, the final one cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.llm import shared

#: Words in a block.
BLOCK = 256

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)

#: A source gives no more than so many times its words.
MOST = 3

#: Rows that a bucket holds at least: beyond its square, rows and buckets grow alike.
ROWS_PER_BUCKET = 1_000

#: Slots that one task maps.
SLOTS_PER_TASK = 50_000

#: Sources of a mix, at most: their sizes and weights are known to the driver.
#: A table with more is refused, so what is broadcast has this bound.
MAX_SOURCES = 100_000

SEED = 13


def permutation(j: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Where a keyed pseudorandom permutation of ``[0, size)`` sends ``j``.

    Four Feistel rounds permute the least power of four that holds ``size``;
    numbers that land outside walk on until they fall inside. ``inverse`` runs
    the rounds backward.
    """
    size, key, out = size.astype(np.uint64), key.astype(np.uint64), j.astype(np.uint64)
    one = np.uint64(1)
    half = np.ones(len(out), np.uint64)
    while (small := (one << (half + half)) < size).any():
        half[small] += one
    walking = np.arange(len(out))
    while len(walking):
        h, k = half[walking], key[walking]
        m = (one << h) - one
        left, right = out[walking] >> h, out[walking] & m
        for turn in reversed(range(4)) if inverse else range(4):
            x = left if inverse else right
            x = (x + k + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(32))) & m
            left, right = (right ^ x, left) if inverse else (right, left ^ x)
        out[walking] = (left << h) | right
        walking = walking[out[walking] >= size[walking]]
    return out.astype(np.int64)


def targets_of(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size.

    The excess of capped sources goes to the others by weight, again and again;
    with room left in none (all sizes zero) targets are zero.
    """
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free = {i for i, n in enumerate(sizes) if n > 0}
    left = total
    while free and left > 0:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(most * sizes[i])
            free.remove(i)
        left = total - sum(target)
    return target


def whole_words(targets: list[float]) -> list[int]:
    """Targets in whole words with the same sum: the largest fractions round up."""
    words = [int(t + 1e-6) for t in targets]
    left = round(sum(targets)) - sum(words)
    by_fraction = sorted(range(len(targets)), key=lambda i: (words[i] - targets[i], i))
    for i in by_fraction[: max(left, 0)]:
        words[i] += 1
    return words


def draw_counts(needs: list[int], n_shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source in each shard, ``(n_shards, sources)``.

    Shards are equal within one block. Each draws a multinomial over what the
    sources still have to give; a draw beyond that is drawn again from the rest,
    and the last shard takes what remains, so that each source gives its need.
    """
    rng = np.random.default_rng(seed)
    left = np.array(needs, np.int64)
    room = [int(left.sum()) // n_shards + (s < int(left.sum()) % n_shards) for s in range(n_shards)]
    out = np.zeros((n_shards, len(needs)), np.int64)
    for s, size in enumerate(room):
        todo = size
        while todo:
            got = np.minimum(rng.multinomial(todo, left / left.sum()), left)
            out[s] += got
            left -= got
            todo -= int(got.sum())
    return out


class Plan:
    """What the driver knows of a mix: a line for each source, a matrix of counts."""

    def __init__(self, sources: list[str | None], sizes: list[int], weights: list[float], block: int, n_shards: int):
        self.sources, self.sizes, self.block = sources, sizes, block
        self.targets = targets_of(sizes, weights)
        self.words = whole_words(self.targets)
        self.blocks = [-(-n // block) for n in sizes]
        self.keys = [(i + 1) * 1_000_003 + SEED for i in range(len(sources))]
        self.needs, self.last = [], []
        for i in range(len(sources)):
            need, last = self._need(i)
            self.needs.append(need)
            self.last.append(last)
        self.counts = draw_counts(self.needs, n_shards)

    def _need(self, i: int) -> tuple[int, int]:
        """Blocks until source ``i`` has given its words, and words of the final one.

        The latter is 0 if that block is given whole. Only the place of the
        source's short last block in the permutation needs to be known.
        """
        size, n, block = self.sizes[i], self.blocks[i], self.block
        passes, rest = divmod(self.words[i], size) if size else (0, 0)
        if not rest:
            return passes * n, 0
        tail = size - (n - 1) * block
        one = lambda x: np.array([x])
        place = int(permutation(one(n - 1), one(n), one(self.keys[i] + passes), inverse=True)[0])
        full = -(-rest // block)
        if place >= full:
            return passes * n + full, rest - (full - 1) * block
        k = max(place + 1, -(-(rest - tail) // block) + 1)
        before = place * block if k == place + 1 else (k - 2) * block + tail
        return passes * n + k, rest - before


def plan_of(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, n_shards: int = 16) -> Plan:
    """The plan for ``docs(source, size)``: one line a source reaches the driver."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("size"))
    lines = sums.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(lines) > MAX_SOURCES:
        raise ValueError(f"a mix has weights for at most {MAX_SOURCES} sources")
    return Plan(
        [r["source"] for r in lines],
        [int(r["size"] or 0) for r in lines],
        [float(weights[i % len(weights)]) for i in range(len(lines))],
        block,
        n_shards,
    )


def slots_of(spark, plan: Plan) -> DataFrame:
    """Every slot of the mix: ``(shard, slot, src, pass, block, words)``.

    Slots are numbered through; each task computes its own from its numbers.
    ``words`` is how many words of the block the slot takes.
    """
    flat = plan.counts.reshape(-1)  # shard by shard, source by source
    ends = np.cumsum(flat)
    before = np.cumsum(plan.counts, 0) - plan.counts  # blocks the source gave to shards before
    shard_ends = np.cumsum(plan.counts.sum(1))
    total, n_src = int(flat.sum()), len(plan.sources)
    blocks, sizes, keys = (np.array(x, np.int64) for x in (plan.blocks, plan.sizes, plan.keys))
    needs = np.array(plan.needs, np.int64)
    last = np.array(plan.last, np.int64)
    block = plan.block

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            g = frame["id"].to_numpy()
            cell = np.searchsorted(ends, g, side="right")
            shard, src = cell // n_src, cell % n_src
            j = before.reshape(-1)[cell] + g - (ends[cell] - flat[cell])
            turn = j // blocks[src]
            b = permutation(j % blocks[src], blocks[src], keys[src] + turn)
            full = np.where(b == blocks[src] - 1, sizes[src] - b * block, block)
            words = np.where((j == needs[src] - 1) & (last[src] > 0), last[src], full)
            start = np.where(shard > 0, shard_ends[shard - 1], 0)
            width = shard_ends[shard] - start
            slot = permutation(g - start, width, shard.astype(np.int64) + 7919)
            yield pd.DataFrame(
                {"shard": shard.astype("int32"), "slot": slot, "src": src.astype("int32"), "pass": turn.astype("int32"),
                 "block": b, "words": words}
            )

    schema = "shard int, slot long, src int, pass int, block long, words long"
    return spark.range(0, total, 1, max(1, -(-total // SLOTS_PER_TASK))).mapInPandas(shared.tidy(run), schema)


def buckets_for(rows: int) -> int:
    """Buckets in which running sums of ``rows`` are made.

    One task sums a bucket's rows and another one a source's buckets, so neither
    number may outgrow the square root of all rows.
    """
    return max(1, min(-(-rows // ROWS_PER_BUCKET), math.isqrt(rows)))


def packed(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with ``src``, ``bucket``, ``row`` and ``first``, the place of its first word.

    Documents of a source are dealt into buckets by a hash of ``ident`` and
    ``tie`` and ordered in them; buckets follow each other. Both levels are
    running sums.
    """
    spark = docs.sparkSession
    names = spark.createDataFrame([(name, i) for i, name in enumerate(plan.sources)], "source string, src int")
    rows = docs.count()
    keyed = docs.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(SEED), "ident", "tie"), F.lit(buckets_for(rows))).cast("int")
    )
    named = keyed.alias("d").join(
        F.broadcast(names.alias("n")), F.col("d.source").eqNullSafe(F.col("n.source"))
    ).select("d.*", "n.src")
    inside = Window.partitionBy("src", "bucket").orderBy("ident", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = named.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("src", "bucket", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("start"))
    return (
        named.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("row", F.row_number().over(Window.partitionBy("src", "bucket").orderBy("ident", "size", "tie")))
        .join(starts, ["src", "bucket"])
        .withColumn("first", F.col("start") + F.col("before"))
        .drop("start", "before")
    )


def mix(docs: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Packed documents and the mix itself.

    ``docs`` has ``ident`` (long), ``source``, ``size`` and ``tie`` (a long that
    tells rows of one identifier apart). The mix has one row
    for each slot and document that meet: ``shard, slot, src, pass, block``, the
    document's ``bucket, row`` (its key among the packed), and ``word``, ``n``:
    the first of its words taken and how many. Documents without words are
    packed and never taken; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    placed = shared.materialise(packed(docs, plan), "mix-packed")
    size = F.lit(plan.block)
    first_block, last_block = F.expr(f"first div {plan.block}"), F.expr(f"(first + size - 1) div {plan.block}")
    parts = placed.where("size > 0").select(
        "src", "bucket", "row", "first", "size", F.explode(F.sequence(first_block, last_block)).alias("block")
    )
    slots = slots_of(spark, plan)
    joined = slots.join(parts, ["src", "block"])
    block_start = F.col("block") * size
    begin = F.greatest(block_start, F.col("first"))
    end = F.least(block_start + F.col("words"), F.col("first") + F.col("size"))
    mixed = joined.select(
        "shard", "slot", "src", "pass", "block", "bucket", "row",
        (begin - F.col("first")).alias("word"), (end - begin).alias("n"),
    ).where("n > 0")
    return placed, mixed


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def taken_by_document(docs: DataFrame) -> DataFrame:
    """``ident, size, source_size, target, taken`` of each row of ``docs(ident, source, size, tie)``.

    Null identifiers and sources are values like others (null is the last
    source); repeated rows each count. Rows of equal ``ident``, ``size`` and
    ``tie`` are alike: which of them gives more is open, what they give is not. No
    document gives more than MOST times its words. The same rows give the same mix.
    """
    spark = docs.sparkSession
    base = shared.materialise(docs.select("ident", "source", "size", "tie"), "mix-docs")
    plan = plan_of(base)
    placed, mixed = mix(base, plan)
    taken = mixed.groupBy("src", "bucket", "row").agg(F.sum("n").alias("taken"))
    lines = spark.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(zip(plan.sizes, plan.targets, strict=True))],
        "src int, source_size long, target double",
    )
    return (
        placed.join(taken, ["src", "bucket", "row"], "left")
        .join(F.broadcast(lines), "src")
        .select("ident", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars"
) -> DataFrame:
    """``docs`` as the mix takes them: a row for each document and pass.

    A document that a pass takes whole keeps its text as it is; of one taken in
    part, the words taken stay, in order, joined by spaces. Columns and their
    order stay, and ``chars_col``, if present, is the new length. Documents
    without words, or that no slot takes, are left out. The mix is made from
    identifiers and sizes; texts move once, to the passes that take them.
    """
    doc = F.struct(*shared.named(*docs.columns))
    # Two 64-bit hashes of the whole row stand for it; equal rows are alike anyway.
    key = [F.xxhash64(doc).alias("tie"), F.xxhash64(F.lit(SEED), doc).alias("tie_2")]
    narrow = docs.select(
        *key,
        docs[id_col].cast("long").alias("ident"),
        docs[source_col].cast("string").alias("source"),
        word_count(docs[text_col]).alias("size"),
    )
    narrow = shared.materialise(narrow, "mix-sizes")
    placed, mixed = mix(narrow, plan_of(narrow))
    runs = mixed.groupBy("src", "bucket", "row", "pass").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("word", "n"))).alias("runs")
    )
    picks = placed.join(runs, ["src", "bucket", "row"]).select("tie", "tie_2", "size", "n", "runs")
    # Equal rows share their key; each is picked by itself, so one copy of the text will do.
    texts = docs.select(*key, doc.alias("doc")).dropDuplicates(["tie", "tie_2"])
    words = F.regexp_extract_all(F.col("doc").getField(text_col), F.lit(shared.WORD), F.lit(0))
    some = F.array_join(
        F.flatten(F.transform("runs", lambda r: F.slice("all_words", (r["word"] + 1).cast("int"), r["n"].cast("int")))), " "
    )
    part = F.when(F.col("n") < F.col("size"), some).otherwise(F.col("doc").getField(text_col))
    out = (
        texts.join(picks, ["tie", "tie_2"])
        .select("doc", "size", "n", "runs")
        .withColumn("all_words", F.when(F.col("n") < F.col("size"), words))
        .withColumn("part", part)
    )
    as_was = {c: F.col("doc").getField(c) for c in docs.columns}
    as_was[text_col] = F.col("part")
    if chars_col in as_was:
        as_was[chars_col] = F.char_length("part").cast(docs.schema[chars_col].dataType)
    return out.select(*[v.alias(c) for c, v in as_was.items()])
