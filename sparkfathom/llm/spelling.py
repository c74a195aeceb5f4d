"""Spelling variants: words of a corpus grouped with a far commoner word one edit away.

Words meet by even partition: of the segments that a word is cut into, one edit
leaves all but one as they are. Two segments of a length-dependent cut are enough to
find every pair; a bucket of a common segment would then hold thousands of words, so
the segment that may hold the edit is halved again until it has ``LONGEST_FREE`` code
points at most, which loses nothing and leaves small buckets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfathom.llm import shared

#: A maximal run of letters, long enough to be a word after one deletion or none.
RUN = "[A-Za-zÀ-ÿ]{%d,}"

#: Code points that the segment with the edit has at most.
LONGEST_FREE = 2

#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000


def spelled(ident: int | None, run: str) -> str:
    """``run``, lower-cased, as the corpus spells it under the identifier ``ident``.

    One run in 31, by checksum, loses a code point. Without an identifier none does.
    """
    return run if ident is None else _spelled(zlib.crc32(b"%d:" % ident), run)


def _spelled(start: int, run: str) -> str:
    h = zlib.crc32(run.encode(), start)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2) -> DataFrame:
    """``(word, n)``: words of ``shortest`` code points and ``least`` occurrences or more.

    A null text has no words; repeated rows count each. Only A to Z are lower-cased.
    Tasks count before the exchange, so a frequent word is a row a task.
    """
    shared.modest_batches(docs.sparkSession)
    pattern = RUN % shortest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(pattern).findall, Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for who, what in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                raw = what.as_py()
                if not raw:
                    continue
                found = Counter(runs(raw.lower().decode()))  # bytes: A to Z only
                if who is not None:
                    start = zlib.crc32(b"%d:" % who)
                    for word, n in found.items():
                        spelt = word if zlib.crc32(word.encode(), start) % 31 else _spelled(start, word)
                        if len(spelt) >= shortest:
                            held[spelt] += n
                else:
                    held.update(found)
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    given = docs.select(F.col(f"`{ident}`").cast("long").alias("who"), F.col(f"`{text}`").alias("what"))
    counted = given.mapInArrow(shared.tidy(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _segments(length: Column, two_only: bool) -> Column:
    """Segments that a word of ``length`` is cut into: 2, doubled until they are short."""
    if two_only:
        return F.lit(2)
    return F.pow(F.lit(2.0), F.greatest(F.lit(1.0), F.ceil(F.log2(length / F.lit(LONGEST_FREE))))).cast("int")


def _cut(j: Column, length: Column, segments: Column) -> Column:
    """Code points before segment ``j`` of an even partition."""
    return F.floor(j * length / segments).cast("int")


def near_summary(words: DataFrame, two_only: bool = False) -> DataFrame:
    """``(word, n_near, best_n, best)``: words one edit away, and the commonest of them.

    Ties of the commonest go to the smallest in code-point order. Words without a
    near word are left out. ``words`` has distinct, non-null ``word`` and ``n``.

    A word of length l enters the index under the rest of it beside each segment,
    and probes that of words of length l - 1 with one code point more left out there.
    Two words meet under one segment, or, where a code point was put between equal
    ones, under neighbouring segments: the first one counts. Buckets are summed up a
    word at a time where they are, so pairs are never written.
    """
    length = F.char_length("word")
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    sides = sides.withColumn("short", length - F.col("longer"))
    sides = sides.withColumn("segments", _segments(F.col("short"), two_only))
    keyed = sides.select("*", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("j"))
    keyed = keyed.select(
        "word", "n", "longer",
        _cut(F.col("j"), F.col("short"), F.col("segments")).alias("start"),
        _cut(F.col("j") + 1, F.col("short"), F.col("segments")).alias("end"), "short", "j",
    )
    head, tail = F.expr("substring(word, 1, start)"), F.expr("substring(word, end + longer + 1)")
    keyed = keyed.select("word", "n", "longer", "start", F.xxhash64("short", "j", head, F.lit("\n"), tail).alias("key"))
    mine, other = keyed.alias("a"), keyed.alias("b")
    met = mine.join(other, F.expr("a.key = b.key and a.longer + b.longer < 2 and a.word <> b.word"))
    # The whole words are compared, so equal hashes of different rests do no harm.
    one_edit = F.expr("levenshtein(a.word, b.word, 1) = 1")
    met_before = F.expr("substring(a.word, a.start + a.longer + 1) = substring(b.word, b.start + b.longer + 1)")
    first = (F.expr("a.longer = b.longer")) | (F.expr("a.start = 0")) | ~met_before
    pairs = met.where(one_edit & first)
    by_key = pairs.groupBy("a.key", "a.word").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct((-F.col("b.n")).alias("m"), F.col("b.word").alias("w"))).alias("top"))
    best = F.min("top")
    return by_key.groupBy("word").agg(F.sum("c").alias("n_near"), (-best["m"]).alias("best_n"), best["w"].alias("best"))


def variant_groups(words: DataFrame, times: int = 10, two_only: bool = False) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every word of ``words``.

    The form is the commonest near word, if it occurs ``times`` as often or more. The
    root is where following forms ends. Each hop multiplies the count by ``times``,
    so chains are as short as the logarithm of the largest count; pointers are
    doubled as often as that allows.
    """
    near = near_summary(words, two_only)
    has = F.col("best_n") >= F.col("n") * times
    forms = words.join(near, "word", "left").select(
        "word", "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best")).alias("form"),
        F.when(has, F.col("best_n")).alias("form_n"),
    )
    forms = shared.materialise(forms, "spelling-forms")
    steps = forms.where("form is not null").select("word", F.col("form").alias("root"))
    largest = forms.agg(F.max("n").alias("m")).first()["m"] or 1
    longest = max(1, math.ceil(math.log(largest, times)))
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants_of(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of ``docs``, from ``doc_id`` and ``text``.

    Empty tables and texts without words give no rows; other columns do not matter.
    """
    words = shared.materialise(word_counts(docs), "spelling-words")
    return variant_groups(words)
