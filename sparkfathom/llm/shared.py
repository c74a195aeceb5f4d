"""What several training-data operators share: scratch tables and hot keys.

Lineage is cut by writing Parquet tables to the folder that the cluster names
in ``spark.checkpoint.dir``; every executor can read them back, so losing an
executor loses nothing. A local folder is set only where that setting is unset,
as in tests.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot when it holds more than one row in HOT_SHARE, so there are at
#: most HOT_SHARE hot keys and a table of them may be broadcast.
HOT_SHARE = 1000

#: ASCII white space of the word rule, and a word.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster it must be named: other machines cannot read a local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkfathom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing will read again."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_scratch_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_CACHES: list = []


def cached(fn: Callable) -> Callable:
    """Remember the results of a worker's function until its task ends."""
    made = lru_cache(maxsize=4)(fn)
    _CACHES.append(made)
    return made


def release_memory() -> None:
    """Give back what a task has used: workers live on, and several share an executor."""
    for made in _CACHES:
        made.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function from batches to batches, that releases memory at its end."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


#: Rows that one Arrow batch takes to a Python worker, at most: texts can be long.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that workers hold few texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Words of 64 bits in a filter that is broadcast: 2 MiB of bits at most.
FILTER_WORDS = 1 << 18

#: Rows of one hot key that share a salt.
ROWS_PER_SALT = 20_000


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({key}), 32), 64) as int))")


def _word(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS)).cast("int")


def bitmap(wanted: DataFrame, key: str) -> DataFrame:
    """``(__word, __bits)``: a filter of the keys in ``wanted``.

    It has ``FILTER_WORDS`` rows at most, whatever the input, so it may be broadcast.
    """
    return wanted.select(_word(key).alias("__word"), _bit(key).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def flagged(rows: DataFrame, bits: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false only if ``key`` is certainly not in the filter."""
    hit = F.coalesce(_bit(key).bitwiseAND(F.col("__bits")) != 0, F.lit(False))
    joined = rows.withColumn("__word", _word(key)).join(F.broadcast(bits), "__word", "left")
    return joined.withColumn(name, hit).drop("__word", "__bits")


def maybe_among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be in ``wanted``; those left out certainly are not.

    The filter only spares work: an exact join follows it.
    """
    return flagged(rows, bitmap(wanted, key), key, "__maybe").where("__maybe").drop("__maybe")


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose ``keys`` equal those of a row of ``gone``, null-safe.

    ``keys`` gives, for each column of ``gone``, the expression over ``docs`` that it
    is compared with. Rows that the filter of ``gone`` rules out stay where they are:
    only the others, nearly all of them rows that go, take part in the exact join.
    """
    own = {f"__of_{n}": c for n, c in keys.items()}
    keyed = docs.withColumns(own).withColumn("__key", F.xxhash64(*own))
    bits = bitmap(gone.select(F.xxhash64(*keys).alias("__key")), "__key")
    parted = flagged(keyed, bits, "__key", "__maybe")
    same = [F.col(f"__of_{n}").eqNullSafe(gone[n]) for n in keys]
    stay = parted.where("not __maybe").select(*named(*docs.columns))
    doubtful = parted.where("__maybe").join(gone, same, "left_anti").select(*named(*docs.columns))
    return stay.unionByName(doubtful)


def salted_lookup(rows: DataFrame, entries: DataFrame, key: str, count_col: str, salt_by: str) -> DataFrame:
    """``rows`` with the columns of the one entry of their key.

    ``entries`` has ``count_col``, the rows of its key. Hot keys, those with more
    than one row in HOT_SHARE, number HOT_SHARE at most and are broadcast; their
    rows spread over salts by ``salt_by`` and their entries are repeated, so no
    task gets all of them. Rows whose key has no entry are left out.
    """
    total = entries.agg(F.coalesce(F.sum(count_col), F.lit(0)).alias("s")).first()["s"]
    least = max(ROWS_PER_SALT, total // HOT_SHARE)
    salts = F.ceil(F.col(count_col) / F.lit(ROWS_PER_SALT)).cast("int")
    hot = F.broadcast(entries.where(F.col(count_col) > least).select(key, salts.alias("__salts")))
    salt = F.pmod(F.xxhash64(salt_by), F.coalesce("__salts", F.lit(1))).cast("int")
    left = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__salts")
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    right = entries.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def named(*names: str) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col(f"`{n}`") for n in names]


def with_arrow_columns(
    df: DataFrame, names: list[str], value: Column, made: list[T.StructField],
    start: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """The columns ``names`` of ``df``, and ``made`` computed from ``value`` in Python.

    ``start`` is called once for each task and gives a function from one batch
    of values to the new columns. Inside, columns go by position, so their names
    may hold any characters.
    """
    modest_batches(df.sparkSession)
    given = df.select(*[c.alias(f"c{i}") for i, c in enumerate(named(*names))], value.alias("value"))
    kept = [T.StructField(f.name, f.dataType) for f in given.schema[:-1]]
    labels = [f.name for f in (*kept, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            fresh = compute(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *fresh], labels)

    return given.mapInArrow(tidy(run), T.StructType([*kept, *made])).toDF(*names, *[f.name for f in made])


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else.

    ``lower`` has a fast path for ASCII texts and then does exactly that; other
    texts go character by character.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with new columns that are computed once.

    Catalyst may copy a column's expression to where it is used, into the body of
    a lambda too, where it would be computed for each element. The output of a
    generator is never copied, so the columns pass through one that gives one row.
    """
    packed = F.struct(*[c.alias(n) for n, c in made.items()])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*rest, F.explode(F.array(packed)).alias("__held")).select(*rest, "__held.*")


def with_prefix_sums(df: DataFrame, names: list[str], block: int = 256) -> DataFrame:
    """``df`` with each named array of longs replaced by its running sums.

    Two levels, so that the work for ``n`` items is ``n * block + (n / block)^2``
    rather than the ``n^2`` of a plain fold that appends to an array.
    """
    zero = F.lit(0).cast("long")

    def running(part: Column, start: Column) -> Column:
        fold = F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(fold, 2, F.size(part))

    def blocks(name: str) -> Column:
        last = F.ceil(F.size(name) / F.lit(block)).cast("int") - 1
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(name, i * block + 1, block))
        return F.when(F.size(name) > 0, cut).otherwise(F.array().cast("array<array<bigint>>"))

    def starts(name: str) -> Column:
        totals = F.transform(name, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
        return F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    df = held(df, **{n: blocks(n) for n in names})
    df = held(df, **{f"{n}__starts": starts(n) for n in names})
    summed = {
        n: F.flatten(
            F.transform(
                F.arrays_zip(F.col(n).alias("b"), F.slice(F.col(f"{n}__starts"), 1, F.size(n)).alias("s")),
                lambda x: running(x["b"], x["s"]),
            )
        )
        for n in names
    }
    return held(df, **summed).drop(*[f"{n}__starts" for n in names])
