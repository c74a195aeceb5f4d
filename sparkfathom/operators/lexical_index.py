"""An inverted index of chunks that searches read in place of the texts.

Chunks, as they are read, are cut into stripes; a block holds the
postings of one term in one stripe, with positions, and bounds of what they can add to
a rank. Segments are immutable Parquet tables whose files are sorted by term, so a search
reads its own terms, and columns of a block besides the bounds only where the stripe can matter. New
chunks make a new segment; a merge joins segments and drops chunks that are gone.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.functions import analysis
from sparkfathom.operators.lexical import B, K1, RARE_DOCUMENTS, needed_terms
from sparkfathom.sources import sinks

SEGMENTS = "segment string, number int, chunks long, tokens long, first_id long, last_id long"

#: A stripe has 1 << STRIPE_BITS chunks at most, a segment fewer than 1 << SEGMENT_BITS stripes.
STRIPE_BITS, SEGMENT_BITS = 10, 44

#: Stripes that a search looks at first, and the most that it names one by one.
SEEDS, LISTED = 8, 1000

#: Words whose places a task holds before it hands their blocks on.
HELD_WORDS = 1_000_000

#: Fixed values of the proximity rank: weight of a position, largest distance, and the curve's constants.
WEIGHT, FARTHEST, CURVE = 0.1, 100, (1.005, 0.05, 1.5, 2.0)


def _blocks(held: list[pa.RecordBatch], names: list[str], kinds: list[pa.DataType], stripe: int) -> pa.RecordBatch:
    """The blocks of some rows ``id, doc, route.., stripe, words`` of a stripe, sorted by term and route.

    Words are numbered and sorted as numbers, so no word is handled by itself.
    """
    rows = pa.Table.from_batches(held).combine_chunks()
    lists = rows.column(rows.num_columns - 1)
    flat = pc.list_flatten(lists).combine_chunks().cast(pa.string()).dictionary_encode()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int32)
    total, order = len(flat), pc.sort_indices(flat.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    routes: dict[tuple, int] = {}
    given = zip(*(c.to_pylist() for c in rows.columns[2:-2]), strict=True) if names else [()] * rows.num_rows
    route = np.array([routes.setdefault(r, len(routes)) for r in given])
    owner = np.repeat(np.arange(rows.num_rows), lengths)
    key = place[flat.indices.to_numpy()] * len(routes) + route[owner]
    at = np.sort(key * total + np.arange(total)) % total  # by term and route, then as read
    key, owner = key[at], owner[at]
    position = (at - np.repeat(np.cumsum(lengths) - lengths, lengths)[at]).astype(np.int32)
    posts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))))
    key, owner = key[posts], owner[posts]
    tfs = np.diff(np.append(posts, total)).astype(np.int32)
    blocks = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    offsets = pa.array(np.append(blocks, len(posts)).astype(np.int32))
    ids, docs = (c.combine_chunks().take(pa.array(owner)).cast(pa.int64()) for c in rows.columns[:2])
    of_route = list(routes)
    positions = pa.ListArray.from_arrays(pa.array(np.append(posts, total).astype(np.int32)), pa.array(position))
    made = {
        "term": flat.dictionary.take(order).take(pa.array(key[blocks] // len(routes))),
        **{name: pa.array([of_route[k][i] for k in (key[blocks] % len(routes)).tolist()], kinds[i]) for i, name in enumerate(names)},
        "stripe": pa.array(np.full(len(blocks), stripe), pa.int64()), "first_id": pa.array(np.minimum.reduceat(ids.to_numpy(), blocks)),
        "n": pa.array(np.diff(offsets.to_numpy())), "max_tf": pa.array(np.maximum.reduceat(tfs, blocks)), "min_length": pa.array(np.minimum.reduceat(lengths[owner], blocks)),
        **{name: pa.ListArray.from_arrays(offsets, x) for name, x in {"id": ids, "doc": docs, "length": pa.array(lengths[owner]), "tf": pa.array(tfs), "positions": positions}.items()},
    }
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``id, doc, route.., stripe, words`` to a row for each stripe, route and term.

    A stripe's rows follow each other, so its blocks are made where it is read. A
    stripe of very many words gives several blocks a term.
    """
    held: list[pa.RecordBatch] = []
    current, tokens, names, kinds = None, 0, [], []
    for batch in batches:
        names, kinds = batch.schema.names[2:-2], [f.type for f in batch.schema][2:-2]
        stripes = batch.column(batch.num_columns - 2).to_numpy()
        words = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy().cumsum()
        ends = np.append(np.flatnonzero(stripes[1:] != stripes[:-1]) + 1, batch.num_rows)
        start = 0
        while start < batch.num_rows:
            if tokens and (stripes[start] != current or tokens >= HELD_WORDS):
                yield _blocks(held, names, kinds, current)
            if stripes[start] != current or tokens >= HELD_WORDS:
                held, tokens = [], 0
            current, before = stripes[start], words[start - 1] if start else 0
            stop = int(min(ends[np.searchsorted(ends, start, side="right")], np.searchsorted(words, before + HELD_WORDS - tokens) + 1))
            held.append(batch.slice(start, stop - start))
            tokens += int(words[stop - 1] - before)
            start = stop
    if tokens:
        yield _blocks(held, names, kinds, current)


def contribution(tf: Column, length: Column, idf: Column, mean: float) -> Column:
    """What a term adds to the rank; it grows with ``tf`` and falls with ``length``."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))


def _most(max_tf: int, min_length: int, idf: float, mean: float) -> float:
    """``contribution`` of one block's bounds, on the driver."""
    return idf * max_tf * (K1 + 1) / (max_tf + K1 * (1 - B + B * min_length / max(mean, 1e-9)))


class Stripe(NamedTuple):
    """A stripe that may hold matches, ``most`` of them, none above ``bound``."""

    stripe: int
    first_id: int
    bound: float
    most: int


@dataclass
class Plan:
    """The blocks of a search and its weights; stripes listed, or as a table if many."""

    blocks: DataFrame
    idf: Column
    mean: float
    listed: list[Stripe] | None = None
    stripes: DataFrame | None = None


def proximity(terms: list[str]) -> Column:
    """A rank that grows as the terms come nearer, from ``at``: a map from term to positions.

    Each pair of positions of two terms, ``FARTHEST`` apart at most, is a chance of
    relevance that falls with the distance; chances combine as independent ones do.
    """
    a, b, c, d = CURVE

    def chance(x: Column, y: Column) -> Column:
        gap = F.abs(x - y)
        near = WEIGHT * F.sqrt(1 / (a + b * F.exp(gap / c - d)))
        return F.when(gap <= FARTHEST, F.log1p(-near)).otherwise(0.0)

    def of_pair(one: str, other: str) -> Column:
        beside = lambda x: F.aggregate(F.col("at")[other], F.lit(0.0), lambda s, y: s + chance(x, y))
        return F.aggregate(F.col("at")[one], F.lit(0.0), lambda acc, x: acc + beside(x))

    total = F.lit(0.0)
    for i, one in enumerate(terms):
        for other in terms[:i]:
            total = total + of_pair(one, other)
    return 1 - F.exp(total)


class LexicalIndex:
    """Segments under ``root``, and a versioned table that lists those that count.

    ``route`` names columns of the chunks that searches filter by; they are columns
    of the blocks. Identifiers of chunks are unique and grow: what is added later has
    larger ones. One driver writes.
    """

    def __init__(self, spark: SparkSession, root: str, analyzer: str = "simple", route: tuple[str, ...] = (), stripe_bits: int = STRIPE_BITS):
        self.spark, self.root, self.analyzer, self.route, self.stripe_bits = spark, root.rstrip("/"), analyzer, tuple(route), stripe_bits
        #: A condition on the routing columns that every search is under.
        self.only: Column | None = None
        self.log = sinks.VersionedTable(spark, f"{self.root}/segments")
        self._listed: tuple[str | None, list] = (None, [])
        self._opened: tuple[tuple[str, ...], DataFrame | None] = ((), None)
        #: Stripes that the last search took apart, and those that hold its terms.
        self.looked_at, self.could_look_at = 0, 0

    # -- segments ------------------------------------------------------------------------

    def segments(self) -> list:
        """The segments that count; a merge keeps them few."""
        version = self.log.version()
        if version is not None and self._listed[0] != version:
            self._listed = version, sorted(self.log.read().collect(), key=lambda r: r["number"])
        return self._listed[1]

    def _path(self, segment: str) -> str:
        return f"{self.root}/data/{segment}"

    def damaged(self) -> list:
        """Listed segments whose table is gone or was not finished."""
        out = []
        for row in self.segments():
            fs, at = self.log._fs(f"{self._path(row['segment'])}/_SUCCESS")
            if not fs.exists(at):
                out.append(row)
        return out

    def unindexed(self, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
        """Chunks that no undamaged segment covers."""
        bad = {r["segment"] for r in self.damaged()}
        covered = F.lit(False)
        for row in self.segments():
            if row["segment"] not in bad:
                covered = covered | F.col(id_col).between(row["first_id"], row["last_id"])
        return chunks.where(~covered)

    def add(self, chunks: DataFrame, id_col: str = "chunk_id", doc_col: str = "document_id", text_col: str = "content") -> int:
        """Make a segment of the chunks that no segment covers; how many they are.

        Listed segments that are damaged leave the list, so their chunks are made anew.
        """
        bad = self.damaged()
        fresh = self.unindexed(chunks, id_col).select(
            F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), *self.route, F.coalesce(F.col(text_col), F.lit("")).alias("text")
        )
        facts = fresh.agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).first()
        # Damaged ranges may lie between others: a new segment's range must cover no other's.
        kept = [r for r in self.segments() if r["segment"] not in {x["segment"] for x in bad}]
        if not facts["chunks"]:
            if bad:
                self._list(kept)
            return 0
        if any(r["first_id"] <= facts["last_id"] and facts["first_id"] <= r["last_id"] for r in kept):
            fresh = chunks.select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), *self.route, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            facts = fresh.agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).first()
            kept = []
        self._list([*kept, self._written(self._made(fresh, self._number()), facts)])
        return facts["chunks"]

    def merge(self, live: DataFrame, id_col: str = "chunk_id") -> None:
        """One segment of all, without chunks that ``live`` lacks; texts are not read."""
        ids = live.select(F.col(id_col).alias("id"))
        rows = ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("place", F.monotonically_increasing_id())
        stripes = rows.select("id", (F.shiftright("place", self.stripe_bits) + (self._number() << SEGMENT_BITS)).alias("stripe"))
        blocks = self._blocks()
        if blocks is None:
            return
        posts = blocks.select("term", *self.route, F.inline(F.arrays_zip("id", "doc", "length", "positions"))).join(stripes, "id")
        facts = ids.agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).first()
        self._list([self._written(self._regrouped(posts), facts)] if facts["chunks"] else [])

    def vacuum(self) -> int:
        """Delete the tables of segments that are not listed; how many went."""
        self.log.vacuum(1)
        listed = {r["segment"] for r in self.segments()}
        fs, at = self.log._fs(f"{self.root}/data")
        old = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName() not in listed] if fs.exists(at) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

    def _number(self) -> int:
        return max((r["number"] for r in self.segments()), default=0) + 1

    def _list(self, rows: list) -> None:
        self.log.replace(self.spark.createDataFrame([tuple(r) for r in rows], SEGMENTS))

    def _made(self, rows: DataFrame, number: int) -> DataFrame:
        """The blocks of ``id, doc, route.., text`` rows; a stripe is a run of rows as they are read."""
        placed = rows.withColumn("place", F.monotonically_increasing_id())
        stripe = F.shiftright("place", self.stripe_bits) + F.lit(number << SEGMENT_BITS)
        longs = [F.col(c).cast("long").alias(c) for c in ("id", "doc")]
        words = placed.select(*longs, *self.route, stripe.alias("stripe"), analysis.lexemes(F.col("text"), self.analyzer).alias("words"))
        routes = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in words.select(*self.route).schema) if self.route else ""
        return words.mapInArrow(
            _blocks_of, f"term string, {routes}stripe long, first_id long, n int, max_tf int, min_length int, "
            "id array<long>, doc array<long>, length array<int>, tf array<int>, positions array<array<int>>",
        )

    def _regrouped(self, posts: DataFrame) -> DataFrame:
        """Blocks of ``term, route.., stripe, id, doc, length, positions`` rows."""
        gathered = posts.groupBy(*self.route, "stripe", "term").agg(F.sort_array(F.collect_list(F.struct("id", "doc", "length", "positions"))).alias("p"))
        tf = F.transform("p", lambda x: F.size(x["positions"]))
        return gathered.select(
            "term", *self.route, "stripe", F.col("p")[0]["id"].alias("first_id"), F.size("p").alias("n"), F.array_max(tf).alias("max_tf"),
            F.array_min(F.col("p.length")).alias("min_length"), F.col("p.id").alias("id"), F.col("p.doc").alias("doc"),
            F.col("p.length").alias("length"), tf.alias("tf"), F.col("p.positions").alias("positions"),
        ).repartitionByRange("term", "stripe")

    def _written(self, blocks: DataFrame, facts) -> tuple:
        """Write a segment's table, each file sorted by term; its row of the list.

        Blocks are written by the task that made them: no posting is moved, and no text read twice.
        """
        segment = uuid.uuid4().hex
        number = self._number()
        blocks.sortWithinPartitions("term", "stripe").write.option("parquet.block.size", 8 << 20).parquet(self._path(segment))
        total = F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x))
        tokens = self.spark.read.parquet(self._path(segment)).agg(total.alias("t")).first()["t"] or 0
        return segment, number, facts["chunks"], tokens, facts["first_id"], facts["last_id"]

    # -- search --------------------------------------------------------------------------

    def searched(self) -> DataFrame | None:
        """The blocks that searches may see."""
        blocks = self._blocks()
        return blocks if blocks is None or self.only is None else blocks.where(self.only)

    def _blocks(self) -> DataFrame | None:
        paths = tuple(self._path(r["segment"]) for r in self.segments())
        if paths and paths != self._opened[0]:
            self._opened = paths, self.spark.read.parquet(*paths)
        return self._opened[1] if paths else None

    def _plan(self, terms: list[str], need: int, where: Column | None) -> Plan | None:
        """What is known of the terms before a posting is read; None if no chunk can match.

        The bounds of up to ``LISTED`` stripes come to the driver, and serve for the
        document frequencies too. Beyond that number both stay where they are.
        """
        blocks = self.searched()
        if blocks is None or not terms:
            return None
        rows = self.segments()
        n, tokens = sum(r["chunks"] for r in rows), sum(r["tokens"] for r in rows)
        own = blocks.where(F.col("term").isin(terms)).withColumn("inside", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
        facts = F.collect_list(F.struct("term", "n", "max_tf", "min_length", "inside")).alias("facts")
        seen = own.groupBy("stripe").agg(F.min("first_id").alias("first_id"), facts).limit(LISTED + 1).collect()
        dfs: dict[str, int] = defaultdict(int)
        if len(seen) <= LISTED:
            for fact in (x for r in seen for x in r["facts"]):
                dfs[fact["term"]] += fact["n"]
        else:
            dfs |= {r["term"]: r["df"] for r in own.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        if len(dfs) < need:
            return None
        idf = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for t, df in dfs.items()}
        plan = Plan(own.where("inside"), F.create_map(*[F.lit(x) for item in idf.items() for x in item])[F.col("term")], tokens / max(n, 1))
        if len(seen) > LISTED:
            bound = F.sum(contribution(F.col("max_tf"), F.col("min_length"), plan.idf, plan.mean))
            stripes = plan.blocks.groupBy("stripe").agg(F.count_distinct("term").alias("terms"), F.min("first_id").alias("first_id"), bound.alias("bound"))
            plan.stripes = stripes.where(F.col("terms") >= need)
            return plan
        plan.listed = []
        for row in seen:
            facts = [x for x in row["facts"] if x["inside"]]
            if len({x["term"] for x in facts}) >= need:
                bound = sum(_most(x["max_tf"], x["min_length"], idf[x["term"]], plan.mean) for x in facts)
                plan.listed.append(Stripe(row["stripe"], row["first_id"], bound, sum(x["n"] for x in facts) // need))
        return plan

    def _scored(self, blocks: DataFrame, terms: list[str], need: int, idf: Column, mean: float, near: bool) -> DataFrame:
        """``id, doc, matched, rank`` of the matches in ``blocks``.

        Ranks are rounded: terms are added in any order, and equal texts have to tie.
        """
        columns = ["id", "doc", "length", "tf", *(["positions"] if near else [])]
        rows = blocks.select("term", F.inline(F.arrays_zip(*columns)))
        facts = [F.count(F.lit(1)).alias("matched"), F.first("doc").alias("doc"), F.round(F.sum(contribution(F.col("tf"), F.col("length"), idf, mean)), 9).alias("rank")]
        if near:
            facts.append(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        found = rows.groupBy("id").agg(*facts).where(F.col("matched") >= need)
        if near and len(terms) > 1:
            found = found.withColumn("rank", F.round(proximity(terms), 9))
        return found.select("id", "doc", "matched", "rank", *(["at"] if near else []))

    def _within(self, plan: Plan, stripes: list[Stripe]) -> DataFrame:
        return plan.blocks.where(F.col("stripe").isin([x.stripe for x in stripes]))

    def pool(self, terms: list[str], need: int, size: int, where: Column | None = None, near: bool = False) -> DataFrame | None:
        """The ``size`` matches of the smallest identifiers, or all if they are fewer.

        Stripes are taken in order of their first identifiers, more each time, until the
        rest can only hold larger ones. What comes back has ``size`` rows at most.
        """
        plan = self._plan(terms, need, where)
        if plan is None:
            return None

        def smallest(blocks: DataFrame) -> DataFrame:
            return self._scored(blocks, terms, need, plan.idf, plan.mean, near).orderBy("id").limit(size)

        if plan.listed is None:
            ordered = plan.stripes.orderBy("first_id", "stripe").limit(LISTED)
            stripes = [Stripe(r["stripe"], r["first_id"], r["bound"], size) for r in ordered.collect()]
        else:
            stripes = sorted(plan.listed, key=lambda x: (x.first_id, x.stripe))
            if sum(x.most for x in stripes) <= size:
                return smallest(self._within(plan, stripes))
        run = SEEDS
        while run < len(stripes):
            found = smallest(self._within(plan, stripes[:run]))
            held = self.spark.createDataFrame(found.toArrow(), found.schema)
            last = held.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).first()
            if last["n"] == size and last["m"] < stripes[run].first_id:
                return held
            run *= 8
        if plan.listed is None:
            return smallest(plan.blocks.join(plan.stripes.select("stripe"), "stripe", "left_semi"))
        return smallest(self._within(plan, stripes))

    def best(self, terms: list[str], need: int, k: int, scoped: DataFrame | None = None, where: Column | None = None) -> DataFrame | None:
        """``id, doc, matched, rank``: the ``k`` best of all matches, ties to smaller identifiers.

        The stripes of the largest bounds are ranked first; of the others only
        those whose bound reaches the k-th rank found are taken apart.
        """
        plan = self._plan(terms, need, where)
        if plan is None:
            return None

        def top(own: DataFrame) -> DataFrame:
            found = self._scored(own, terms, need, plan.idf, plan.mean, False)
            found = found if scoped is None else found.join(scoped.select(F.col(scoped.columns[0]).alias("id")), "id", "left_semi")
            return found.orderBy(F.desc("rank"), "id").limit(k)

        if plan.listed is None:
            ordered = plan.stripes.orderBy(F.desc("bound"), "stripe").limit(SEEDS)
            seeds = [Stripe(r["stripe"], r["first_id"], r["bound"], 0) for r in ordered.collect()]
        else:
            stripes = sorted(plan.listed, key=lambda x: (-x.bound, x.stripe))
            seeds, later = stripes[:SEEDS], stripes[SEEDS:]
            self.could_look_at = self.looked_at = len(stripes)
            if not later:
                return top(self._within(plan, seeds))
        first = top(self._within(plan, seeds))
        first = self.spark.createDataFrame(first.toArrow(), first.schema)
        ranks = [r["rank"] for r in first.select("rank").collect()]
        least = min(ranks) - 1e-8 if len(ranks) == k else 0.0
        if plan.listed is None:
            rest = plan.stripes.where(~F.col("stripe").isin([x.stripe for x in seeds]) & (F.col("bound") >= least))
            more = plan.blocks.join(rest.select("stripe"), "stripe", "left_semi")
        else:
            later = [x for x in later if x.bound >= least]
            self.looked_at = len(seeds) + len(later)
            if not later:
                return first
            more = self._within(plan, later)
        return first.unionByName(top(more)).orderBy(F.desc("rank"), "id").limit(k)

    def _terms(self, query: str) -> list[str]:
        return list(dict.fromkeys(analysis.lexemes_of(query, self.analyzer)))

    def lexical_top(
        self, query: str, k: int, scoped: DataFrame | None = None, relaxed: bool = False, pool: int | None = None, where: Column | None = None,
        near: bool = False, id_col: str = "chunk_id",
    ) -> DataFrame:
        """``chunk_id, rank``: what ``lexical.lexical_top`` gives, without a look at texts.

        Without ``pool`` all matches compete. ``near`` ranks by proximity.
        """
        terms = self._terms(query)
        need = needed_terms(len(terms)) if relaxed else len(terms)
        empty = self.spark.createDataFrame([], f"{id_col} long, rank double")
        if not need:
            return empty
        if pool is None and not near:
            found = self.best(terms, need, k, scoped, where)
        else:
            found = self.pool(terms, need, pool or (1 << 31) - 1, where, near)
            if found is not None and scoped is not None:
                found = found.join(scoped.select(F.col(id_col).alias("id")), "id", "left_semi")
        if found is None:
            return empty
        return found.select(F.col("id").alias(id_col), "rank").orderBy(F.desc("rank"), id_col).limit(k)

    def phrase(self, query: str, where: Column | None = None) -> DataFrame:
        """``chunk_id, times``: chunks that hold the words one after another, and how often."""
        words = analysis.lexemes_of(query, self.analyzer)
        terms = list(dict.fromkeys(words))
        plan = self._plan(terms, len(terms), where)
        if plan is None:
            return self.spark.createDataFrame([], "chunk_id long, times int")
        stripes = plan.stripes.select("stripe") if plan.listed is None else None
        own = self._within(plan, plan.listed) if stripes is None else plan.blocks.join(stripes, "stripe", "left_semi")
        found = self._scored(own, terms, len(terms), plan.idf, plan.mean, True)

        def runs(p: Column) -> Column:
            follows = F.lit(True)
            for i, word in enumerate(words[1:], 1):
                follows = follows & F.array_contains(F.col("at")[word], p + i)
            return follows

        times = F.size(F.filter(F.col("at")[words[0]], runs))
        return found.select(F.col("id").alias("chunk_id"), times.alias("times")).where("times > 0")

    def probe(self, word: str, scoped: DataFrame, cap: int = 20 * RARE_DOCUMENTS, id_col: str = "chunk_id") -> DataFrame:
        """One row, ``sampled, documents``, as ``lexical.probe`` gives it."""
        terms = self._terms(word)
        sample = self.pool(terms, len(terms), cap)
        if sample is None:
            return self.spark.createDataFrame([(0, 0)], "sampled long, documents long")
        marked = sample.select("id", "doc").join(scoped.select(F.col(id_col).alias("id"), F.lit(True).alias("in_scope")), "id", "left")
        seen = F.count_distinct(F.when(F.col("in_scope"), F.col("doc")))
        return marked.agg(
            F.count(F.lit(1)).alias("sampled"),
            F.when(F.count(F.lit(1)) < cap, seen).otherwise(F.count_distinct("doc")).alias("documents"),
        )
