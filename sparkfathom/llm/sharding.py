"""Uniform shuffle into shards of exact sizes by a hypergeometric matrix.

Rows sit in ``P`` partitions and go to ``S`` shards whose sizes differ by at most
one. Which rows of a partition go to which shard is settled in three steps:

1. the communication matrix ``A[p][s]``, how many rows of partition ``p`` go to
   shard ``s``, is drawn from the multivariate hypergeometric law given both
   margins: the counts a uniform permutation of all rows would show;
2. each partition permutes its rows and deals them out by its line of the matrix;
3. rows are exchanged and each shard permutes what it has received.

The matrix is the only thing the driver holds: at most ``MAX_PARTITIONS`` lines
of one count per shard, whatever the input. Rows stay in DataFrame functions.
A partition is a bucket of the pinned row number, so no key can make it large,
and a shard is permuted in buckets whose offsets come from their counts, so no
task gets a whole shard.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.llm import shared

#: Bounds of the number of partitions and of the buckets of one shard.
MAX_PARTITIONS = 1 << 16
MAX_BUCKETS = 1 << 16

#: How the two tables of whole documents are written: they are read once each.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}

#: Rows that a partition or a bucket should hold while those bounds allow it.
ROWS_PER_PARTITION = 4_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """A draw of the number of good items among ``draws`` without replacement.

    Inversion outward from the mode. Margins are exact integers of any size; the
    mass at the mode comes from logarithms, whose error is below one part in a
    hundred up to 1e12 rows.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(total, draws))
    u = rng.random() - peak
    up, down = mode, mode
    p_up = p_down = peak
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(rows_of: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; both margins are exact."""
    rng = random.Random(seed)
    total = sum(rows_of)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for n in rows_of:
        line, left, free = [], n, sum(room)
        for s in range(n_shards):
            x = hypergeometric(rng, room[s], free - room[s], left)
            line.append(x)
            free -= room[s]
            left -= x
            room[s] -= x
        matrix.append(line)
    return matrix


def shuffle_into_shards(df: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Shard sizes differ by at most one. Every row counts, repeated ones and those
    with nulls in any column too; an empty table gives an empty result; shards
    may be empty when there are fewer rows than shards. ``df`` is first written
    to the shared folder, which pins row numbers: a task that runs again sees
    the same rows under the same numbers. The same files read in the same splits
    give the same shards. Columns of ``df`` named ``shard`` or ``slot`` are
    replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    numbered = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*shared.named(*names)).alias("kept"),
    )
    pinned = shared.materialise(numbered, "shard-rows", **PACKED)
    total = pinned.count()
    n_parts = min(MAX_PARTITIONS, max(1, -(-total // ROWS_PER_PARTITION)))
    n_buckets = min(MAX_BUCKETS, max(1, -(-total // (n_shards * ROWS_PER_PARTITION))))
    part = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n_parts)).cast("int")
    dealt = pinned.withColumn("part", part)

    # Both margins of the matrix; n_parts lines at most.
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(n_parts)], n_shards, seed)
    lines = spark.createDataFrame(
        [(p, list(accumulate(line))) for p, line in enumerate(matrix)], "part int, ends array<long>"
    )

    # Permute locally and deal out by the line: the first ends[0] rows go to shard 0, ...
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")
    shard = F.size(F.filter("ends", lambda end: end < F.col("rank"))).cast("int")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "row"), F.lit(n_buckets)).cast("int")
    sent = (
        dealt.withColumn("rank", F.row_number().over(local).cast("long"))
        .join(F.broadcast(lines), "part")
        .select("row", "kept", shard.alias("shard"), bucket.alias("bucket"))
    )
    sent = shared.materialise(sent, "shard-sent", **PACKED)
    shared.discard(pinned)

    # Permute again: random buckets, random order in each, offsets from counts.
    offset = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sent.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(offset), F.lit(0)).alias("start"))
    )
    again = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64(F.lit(seed + 3), "row"), "row")
    return (
        sent.withColumn("rank", F.row_number().over(again).cast("long"))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select("kept.*", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
    )
