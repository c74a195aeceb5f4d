"""Near-duplicate groups by MinHash and a multi-index Hamming join.

A text's signature is ``SIZE`` minima of its shingles, ``BITS`` bits of each; the
distance of two signatures is the number of places where they differ. The
signature is split into chunks of ``CHUNK`` places. If two signatures differ in
at most ``DISTANCE`` places, some chunk of both differs in ``ERRORS`` at most, by
the pigeonhole principle; enumerating the places that may be wrong (a key for
each, without that place) makes every such pair share a key. A pair at a
similarity of 0.8 exceeds the distance with a probability below 1e-5.

1. Texts of the same word sequence are one class and need no comparison.
2. In rounds, every bucket of one key that still holds several components has a
   member drawn as its hub. Each other member is compared with the hubs of its
   buckets and linked to the likeliest once full sets confirm it; components are
   contracted. Rounds go on while they save the next step enough comparisons.
3. Members of different components that share a bucket meet in tiles of bounded
   size, inside a task. First signatures and bitmaps tell which members have a
   partner there at all; full sets of these alone come to the tile, and it
   returns a spanning forest of its confirmed links. After that, every pair
   within the distance is either linked or inside one component.

Bitmaps of shingles bound the similarity from above: a bit of one that the other
lacks is a shingle that it lacks. The bound loses nothing.

No pairs of a group are emitted: a round gives at most one link for each class, a
tile fewer links than it has members. Links and components stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfathom.llm import shared
from sparkfathom.llm.components import components
from sparkfathom.llm.shingles import MinHash, digest_of, shingle_sets

#: Signature places, bits of each, places in a chunk, and errors that a key allows.
SIZE, BITS, CHUNK, ERRORS = 48, 16, 4, 1

#: Signatures that differ in more places than these are not compared further.
DISTANCE = SIZE // CHUNK * (ERRORS + 1) - 1

#: Bits of the bitmap of a set.
MAP_BITS = 2048

#: Members of a bucket on each side of a tile, and shingles of these, on average.
TILE, TILE_SHINGLES = 1024, 1 << 21

#: Hubs that a class is compared with in a round, by the number of shared keys.
HUBS = 3

#: Comparisons for each class, on average, that tiles may make; above that another
#: round of hubs goes first, unless the last one has not even halved them.
PAIRS = 1000


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature, one for each chunk and place left out.

    Three places of 16 bits, the chunk and the place fit in 54 bits: keys are
    equal only if chunk, place and the other places are.
    """
    s = signatures.astype(np.int64).reshape(len(signatures), SIZE // CHUNK, CHUNK)
    chunk = np.arange(SIZE // CHUNK)[None, :]
    out = []
    for wrong in range(CHUNK):
        key = chunk * CHUNK + wrong
        for place in range(CHUNK):
            if place != wrong:
                key = (key << BITS) | s[:, :, place]
        out.append(key)
    return np.stack(out, 2).reshape(len(signatures), -1)


def unpack(column, kind, width: int | None = None) -> np.ndarray:
    flat = np.frombuffer(b"".join(column), kind)
    return flat.reshape(-1, width) if width else flat


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[shingles % np.uint64(MAP_BITS)] = 1
    return np.packbits(bits).view(np.uint64)


def may_link(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these bitmaps and sizes can be similar enough; never wrongly false."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b) * (100 + percent) >= percent * (n_a + n_b)


def first_shared_key(differ: np.ndarray) -> np.ndarray:
    """The number of the first key that two signatures share, from where they differ."""
    chunks = differ.reshape(len(differ), SIZE // CHUNK, CHUNK)
    wrong = chunks.sum(2)
    chunk = (wrong <= ERRORS).argmax(1)
    return chunk * CHUNK + chunks[np.arange(len(differ)), chunk].argmax(1)


def overlaps(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a set with others, all sorted and not empty."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum([0, *(len(x) for x in many[:-1])])
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def signatures_of(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``ident, n_shingles, class, signature, map`` (three binaries), text by text.

    Documents without words have 0 shingles and none of the three.
    """
    given = docs.select(docs[id_col].cast("long").alias("ident"), docs[text_col].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(SIZE)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            digests = [digest_of(t) for t in texts]
            counts, signatures, maps = [], [], []
            for shingles in shingle_sets(texts, width):
                counts.append(len(shingles))
                signatures.append(minhash.signature(shingles).tobytes() if len(shingles) else None)
                maps.append(bitmap(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ident"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.array(maps, pa.binary()),
                ],
                ["ident", "n_shingles", "class", "signature", "map"],
            )

    return given.mapInArrow(
        shared.tidy(run), "ident long, n_shingles long, class binary, signature binary, map binary"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, packed)``: the shingles of the wanted documents.

    A bounded filter of the wanted identifiers keeps other texts out of Python,
    and only packed rows move to the exact join. Rows that repeat an identifier
    and its text count once.
    """
    given = docs.select(docs[id_col].cast("long").alias("node"), docs[text_col].cast("binary").alias("text"))
    some = shared.maybe_among(given, wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, packed = [], []
            sets = shingle_sets([t or b"" for t in batch.column("text").to_pylist()], width)
            for node, shingles in zip(batch.column("node").to_pylist(), sets, strict=True):
                raw = shingles.tobytes()
                mark = (node, xxhash.xxh3_128_digest(raw))
                if raw and mark not in seen:
                    seen.add(mark)
                    nodes.append(node)
                    packed.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "packed"])

    made = some.mapInArrow(shared.tidy(run), "node long, packed binary").join(wanted, "node", "left_semi")
    once = made.groupBy("node").agg(F.collect_set("packed").alias("packed"))
    return shared.materialise(once.select("node", F.explode("packed").alias("packed")), "near-sets")


def key_rows(classes: DataFrame) -> DataFrame:
    """``(key, node)``: every key of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = keys_of(unpack(batch.column("signature").to_pylist(), np.uint16, SIZE))
                ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                rows = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), rows], ["node", "keys"])

    made = classes.select("node", "signature").mapInArrow(shared.tidy(run), "node long, keys array<long>")
    return made.select(F.explode("keys").alias("key"), "node")


def likeliest_hubs(active: DataFrame, turn: int) -> DataFrame:
    """``(a, b)``: for each node, the hubs of other components it shares most keys with.

    ``active`` is ``(key, node, comp)``. The hub of a key is drawn by a hash, another
    one each turn; a node has ``HUBS`` of them at most.
    """
    drawn = F.xxhash64(F.lit(turn), "node")
    hubs = active.groupBy("key").agg(F.min(F.struct(drawn.alias("drawn"), "node", "comp")).alias("hub"))
    apart = active.join(hubs, "key").where(F.col("comp") != F.col("hub.comp"))
    votes = apart.groupBy("node", F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    most = F.sort_array(F.collect_list(F.struct("votes", F.xxhash64(F.lit(turn), "b").alias("tie"), "b")), False)
    best = votes.groupBy("node").agg(F.slice(most, 1, HUBS).alias("best"))
    return best.select(F.col("node").alias("a"), F.explode("best.b").alias("b"))


def close_stars(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """For each ``a`` the nearest ``b`` that signatures and bitmaps do not rule out."""
    side = lambda name: shape.select(
        *[F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in ("node", "n", "signature", "map")]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, y = (unpack(frame[f"{c}_signature"], np.uint16, SIZE) for c in "ab")
                p, q = (unpack(frame[f"{c}_map"], np.uint64, MAP_BITS // 64) for c in "ab")
                can = may_link(p, frame["a_n"].to_numpy(), q, frame["b_n"].to_numpy(), percent)
                far = (x != y).sum(1)
                yield frame.assign(far=far).loc[can & (far <= DISTANCE), ["a", "b", "far"]]

    near = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(shared.tidy(run), "a long, b long, far long")
    return near.groupBy("a").agg(F.min(F.struct("far", "b"))["b"].alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("packed").alias(f"{name}_set"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(linked(len(np.intersect1d(one, two, True)), len(one), len(two), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    return both.mapInArrow(shared.tidy(check), "a long, b long")


#: What names a tile, and what its rows carry.
CELL, CARRIED = ["key", "kind", "ta", "tb"], ["side", "node", "comp", "n", "signature", "map"]
TILE_TYPES = (
    "key long, kind int, ta int, tb int, side int, node long, comp long, n long, signature binary, map binary"
)


def dealt_tiles(active: DataFrame, shape: DataFrame) -> DataFrame:
    """The members of each bucket dealt to tiles in which all pairs of its components meet.

    Members of the bucket's largest component, if they fill a tile, meet only the
    others (``kind`` 1): what is in one component already is not compared again.
    """
    weighed = active.join(shape.select("node", "n"), "node")
    parts = F.count(F.lit(1)) / F.lit(TILE) + F.sum("n") / F.lit(TILE_SHINGLES)
    sizes = weighed.groupBy("key", "comp").agg(parts.alias("m"))
    grid = sizes.groupBy("key").agg(F.sum("m").alias("k"), F.max(F.struct("m", "comp")).alias("top")).select(
        "key",
        "k",
        F.when(F.col("top.m") >= 1, F.col("top.m")).otherwise(0).alias("large"),
        F.col("top.comp").alias("large_comp"),
    )
    rows = (
        active.join(grid, "key")
        .withColumn("inside", (F.col("large") > 0) & (F.col("comp") == F.col("large_comp")))
        .withColumns({"tl": F.ceil("large").cast("int"), "tr": F.ceil(F.greatest(F.lit(1e-9), F.col("k") - F.col("large"))).cast("int")})
        .withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("tl")).otherwise(F.col("tr"))).cast("int"))
    )
    cell = lambda kind, ta, tb, side: F.struct(
        F.lit(kind).alias("kind"), ta.alias("ta"), tb.alias("tb"), side.cast("int").alias("side")
    )
    own, others = F.col("own"), F.sequence(F.lit(0), F.col("tr") - 1)
    with_large = F.when(F.col("tl") > 0, F.sequence(F.lit(0), F.col("tl") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.when(F.col("inside"), F.transform(others, lambda j: cell(1, own, j, F.lit(0)))).otherwise(
        F.concat(
            F.transform(others, lambda j: cell(0, F.least(own, j), F.greatest(own, j), own > j)),
            F.transform(with_large, lambda i: cell(1, i, own, F.lit(1))),
        )
    )
    dealt = rows.withColumn("place", F.explode(places)).select("key", "place.*", "node", "comp")
    return dealt.join(shape, "node").select(*CELL, *CARRIED)


def by_tile(work: Callable[[pa.Table], pa.Table | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the rows of one tile after the other; they come sorted, in any batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def whole(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            marks = np.stack([table.column(c).to_numpy() for c in CELL], 1)
            cuts = (np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist()
            ends = [*cuts, table.num_rows] if last else cuts
            starts = [0, *ends]
            return [table.slice(a, b - a) for a, b in zip(starts, ends, strict=False)], table.slice(starts[-1])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                tiles, held = whole(pa.concat_tables([held, table]) if held is not None else table, False)
                for made in filter(None, map(work, tiles)):
                    yield from made.to_batches()
        if held is not None and held.num_rows:
            for made in filter(None, map(work, whole(held, True)[0])):
                yield from made.to_batches()

    return shared.tidy(run)


def facing(tile: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a tile, the later ones that may be linked to them.

    Two members are compared only in the first bucket that they share, and only
    if they are of different components.
    """
    side, comp, n = (tile.column(c).to_numpy() for c in ("side", "comp", "n"))
    sig = unpack(tile.column("signature").to_pylist(), np.uint16, SIZE)
    maps = unpack(tile.column("map").to_pylist(), np.uint64, MAP_BITS // 64)
    number = tile.column("key")[0].as_py() >> (BITS * (CHUNK - 1))
    within = tile.column("kind")[0].as_py() == 0 and tile.column("ta")[0].as_py() == tile.column("tb")[0].as_py()
    right = np.flatnonzero(side == 1)
    for i in range(len(comp)) if within else np.flatnonzero(side == 0):
        rest = np.arange(i + 1, len(comp)) if within else right
        rest = rest[comp[rest] != comp[i]]
        differ = sig[rest] != sig[i]
        near = differ.sum(1) <= DISTANCE
        near[near] = first_shared_key(differ[near]) == number
        near[near] = may_link(maps[i], n[i], maps[rest[near]], n[rest[near]], percent)
        if near.any():
            yield int(i), rest[near]


def with_partners(tiles: DataFrame, percent: int) -> DataFrame:
    """The rows of ``tiles`` that signatures and bitmaps leave some partner in their tile."""

    def work(tile: pa.Table) -> pa.Table | None:
        some = np.zeros(tile.num_rows, bool)
        for i, others in facing(tile, percent):
            some[i] = some[others] = True
        return tile.filter(pa.array(some)) if some.any() else None

    sorted_ = tiles.repartition(*CELL).sortWithinPartitions(*CELL)
    return sorted_.mapInArrow(by_tile(work), TILE_TYPES)


def tile_links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of components: a spanning forest of each tile's confirmed links."""

    def work(tile: pa.Table) -> pa.Table | None:
        shingles = [np.frombuffer(x.as_py(), np.uint64) for x in tile.column("packed")]
        sizes = np.array([len(s) for s in shingles])
        names, root = np.unique(tile.column("comp").to_numpy(), return_inverse=True)
        tree = np.arange(len(names))
        a, b = [], []
        for i, others in facing(tile, percent):
            others = others[tree[root[others]] != tree[root[i]]]
            if len(others):
                common = overlaps(shingles[i], [shingles[j] for j in others])
                for j in others[100 * common >= percent * (sizes[i] + sizes[others] - common)]:
                    x, y = tree[root[i]], tree[root[j]]
                    if x != y:
                        tree[tree == max(x, y)] = min(x, y)
                        a.append(names[root[i]])
                        b.append(names[root[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}) if a else None

    whole = tiles.join(sets, "node").select(*CELL, *CARRIED, "packed")
    return whole.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(by_tile(work), "a long, b long").distinct()


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, comp)`` after ``links(a, b)`` between components."""
    joins = components(links)
    roots = joins.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    made = shared.materialise(
        labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "near-labels"
    )
    shared.discard(labels, joins)
    return made


def unsettled(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """``(key, node, comp)`` of the buckets that hold several components.

    Also how many pairs of members of different components these buckets have.
    """
    placed = shared.materialise(buckets.join(labels, "node").select("key", "node", "comp"), "near-placed")
    rows = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("m"))
    apart = (F.pow(F.sum("m"), 2) - F.sum(F.col("m") * F.col("m"))) / 2
    keys = shared.materialise(rows.groupBy("key").agg(apart.alias("pairs")).where("pairs > 0"), "near-keys")
    active = shared.materialise(placed.join(keys, "key", "left_semi"), "near-active")
    pairs = keys.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")).first()["pairs"]
    shared.discard(placed, keys)
    return active, int(pairs)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``ident, n_shingles, component`` of each row: the smallest identifier it reaches.

    Two documents are linked if their sets of ``width``-word shingles have a
    Jaccard similarity of ``percent`` / 100 or more. Documents without words
    (null or empty texts too) are linked with nothing. Rows of one identifier
    are one document. A null identifier has a null component and no links; an
    empty table gives an empty result.
    """
    shared.modest_batches(docs.sparkSession)
    scanned = shared.materialise(signatures_of(docs, id_col, text_col, width), "near-docs")
    classes = shared.materialise(
        scanned.where("class is not null and ident is not null")
        .groupBy("class")
        .agg(
            F.min("ident").alias("node"),
            F.first("signature").alias("signature"),
            F.first("map").alias("map"),
            F.first("n_shingles").alias("n"),
            F.count(F.lit(1)).alias("rows"),
        ),
        "near-classes",
    )

    # Buckets of several classes, and what is known of these classes.
    keys = key_rows(classes)
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    buckets = shared.materialise(keys.join(several, "key", "left_semi"), "near-buckets")
    nodes = buckets.select("node").distinct()
    shape = shared.materialise(classes.select("node", "n", "signature", "map").join(nodes, "node", "left_semi"), "near-shapes")
    labels = shared.materialise(nodes.select("node", F.col("node").alias("comp")), "near-labels")

    n_classes, turn = classes.count(), 0
    active, pairs = unsettled(buckets, labels)
    while pairs:
        stars = shared.materialise(close_stars(likeliest_hubs(active, turn), shape, percent), "near-stars")
        sets = full_sets(docs, stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), id_col, text_col, width)
        links = shared.materialise(confirmed(stars, sets, percent), "near-links")
        if links.isEmpty():
            break
        comp_of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
        ends = links.join(comp_of("a"), "a").join(comp_of("b"), "b")
        labels = contracted(labels, ends.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
        shared.discard(stars, sets, links, active)
        before, turn = pairs, turn + 1
        active, pairs = unsettled(buckets, labels)
        if pairs <= PAIRS * n_classes or 2 * pairs > before:
            break

    # What the hubs left apart inside a bucket.
    tiles = shared.materialise(with_partners(dealt_tiles(active, shape), percent), "near-tiles")
    if not tiles.isEmpty():
        sets = full_sets(docs, tiles.select("node").distinct(), id_col, text_col, width)
        links = shared.materialise(tile_links(tiles, sets, percent), "near-links")
        if not links.isEmpty():
            labels = contracted(labels, links)
        shared.discard(sets, links)

    named = classes.join(labels, "node", "left").select(
        "class", "rows", F.coalesce("comp", "node").alias("component")
    )
    named = shared.materialise(named, "near-named")
    shared.discard(tiles, active, labels, shape, buckets, classes)
    linkable = F.col("class").isNotNull() & F.col("ident").isNotNull()
    found = shared.salted_lookup(scanned.where(linkable), named, "class", "rows", "ident")
    alone = scanned.where(~linkable).select("ident", "n_shingles", F.col("ident").alias("component"))
    return found.select("ident", "n_shingles", "component").unionByName(alone)


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest identifier.

    Columns and their order stay. Documents without words and those with a null
    identifier stay; rows that repeat a kept identifier all stay.
    """
    groups = near_groups(docs, id_col, text_col, width, percent)
    gone = shared.materialise(groups.where("ident != component").select("ident").distinct(), "near-gone")
    return shared.without(docs, gone, {"ident": docs[id_col].cast("long")})
