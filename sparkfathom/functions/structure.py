"""Structure of a text: words broken over lines, headings, page breaks, and chunks that keep to them.

All of it is expressions of the row alone, so nothing here shuffles but ``rebuilt``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.functions import chunking
from sparkfathom.functions import text as T

#: A word broken by a hyphen and a line end or blanks, and one that is whole.
BROKEN, INTACT = r"(\p{L}+)-(?:[ \t]*\n[ \t]*|[ \t]+)(\p{L}+)", r"\p{L}+-\p{L}+"

#: A heading line, and a line of form feeds only.
HEADING, PAGE_BREAK = r"(?dm)^#{1,6} \S", r"(?dm)^\f+[ \t]*\n"

#: Left halves of real compounds, without those that join (``multi-variate``).
COMPOUND_PREFIXES = "well self cross high low long short large small real state end first second".split()

#: A soft hyphen, and characters of a chunk's opening that place it in the one before.
SOFT_HYPHEN, OPENING = "­", 200

#: Marks a cut; texts lose their own NULs first.
_CUT = "\0"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is made once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _among(word: Column, listed: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in listed]), word)


def dehyphenated(text: Column) -> Column:
    """Words broken at a line end are joined, real compounds are kept, soft hyphens go.

    A break is kept if a letter beside it is no lower-case one, the left half is a
    single letter, the right half is a function word, the same text spells the
    compound whole, or the left half begins compounds and the joined word does not
    occur. Null stays null.
    """

    def halves(clean: Column) -> Column:
        part = lambda i: F.regexp_extract_all(clean, F.lit(BROKEN), F.lit(i))
        return F.struct(part(0).alias("met"), part(1).alias("left"), part(2).alias("right"), F.split(clean, BROKEN).alias("between"))

    def known(clean: Column, b: Column) -> Column:
        paired = lambda sep: F.zip_with(b["left"], b["right"], lambda x, y: F.concat(x, F.lit(sep), y))
        spelled = lambda pattern: F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
        return F.struct(
            F.array_intersect(paired(""), spelled(r"\p{L}+")).alias("words"), F.array_intersect(paired("-"), spelled(INTACT)).alias("compounds")
        )

    def mended(b: Column, k: Column) -> Column:
        def one(x: Column) -> Column:
            left, right = x["left"], x["right"]
            whole = F.concat(left, right)
            kept = (
                ~(left.rlike(r"\p{Ll}$") & right.rlike(r"^\p{Ll}"))
                | (F.char_length(left) < 2)
                | _among(right, T.FUNCTION_WORDS)
                | F.array_contains(k["compounds"], F.concat(left, F.lit("-"), right))
                | (_among(left, COMPOUND_PREFIXES) & ~F.array_contains(k["words"], whole))
            )
            return F.when(kept, x["met"]).otherwise(whole)

        pieces = F.concat(F.transform(F.arrays_zip(b["met"], b["left"], b["right"]), one), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(b["between"], pieces, lambda x, y: F.array(x, y))), "")

    def of(clean: Column) -> Column:
        joined = _let(halves(clean), lambda b: _let(known(clean, b), lambda k: mended(b, k)))
        return F.when(clean.rlike(BROKEN), joined).otherwise(clean)

    return _let(F.replace(text, F.lit(SOFT_HYPHEN), F.lit("")), of)


def sections(text: Column) -> Column:
    """An array of ``heading, segments``: a section starts at a heading line, a segment at a page break too.

    Segments are verbatim, without NULs; blank ones are left out. The heading is null
    before the first heading line. An empty or null text has no segments.
    """
    cut = F.regexp_replace(T.without_nul(F.coalesce(text, F.lit(""))), r"(?dm)^(?=#{1,6} \S)", _CUT)

    def of(section: Column) -> Column:
        title = F.when(section.rlike(r"^#{1,6} \S"), F.trim(F.regexp_extract(section, r"^#{1,6} ([^\n]*)", 1)))
        segments = F.split(F.regexp_replace(section, r"(?dm)^(\f+[ \t]*\n)", "$1" + _CUT), r"\x00")
        return F.struct(title.alias("heading"), F.filter(segments, lambda s: ~T.is_blank(s)).alias("segments"))

    return F.transform(F.split(cut, r"\x00"), of)


def _windows(segment: Column, size: int, overlap: int) -> Column:
    """A short segment as it is; of a long one windows of words, joined by spaces."""
    step = size - overlap

    def of(words: Column) -> Column:
        n = chunking.window_count(F.size(words), size, overlap)
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
        return F.when(F.size(words) <= size, F.array(segment)).otherwise(cut)

    return _let(T.words(segment), of)


def structure_chunks(
    docs: DataFrame, keys: list[str], text_col: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, punctuation: bool = True
) -> DataFrame:
    """``keys, chunk_index, section, heading, content``: chunks that start at headings and page breaks.

    A segment of over ``size`` words falls back to windows; each chunk carries its
    section's heading and number. Without ``punctuation`` chunks go of whose words half
    or more have no letter or digit, and positions number what is left. Null and blank
    texts have no chunks.
    """
    chunking.check_window(size, overlap)

    def of_section(section: Column, number: Column) -> Column:
        own = F.flatten(F.transform(section["segments"], lambda s: _windows(s, size, overlap)))
        return F.transform(own, lambda c: F.struct(number.alias("section"), section["heading"].alias("heading"), c.alias("content")))

    chunks = F.flatten(F.transform(sections(F.col(text_col)), of_section))
    if not punctuation:
        chunks = F.filter(chunks, lambda c: T.punctuation_share(c["content"]) < T.PUNCTUATION_SHARE)
    return docs.select(*keys, F.posexplode(chunks).alias("chunk_index", "__c")).select(
        *keys, "chunk_index", F.col("__c.section").alias("section"), F.col("__c.heading").alias("heading"), F.col("__c.content").alias("content")
    )


def rider_chunks(docs: DataFrame, keys: list[str], text_col: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Broken words joined, then chunks by structure, then without mere punctuation."""
    joined = docs.select(*keys, dehyphenated(F.col(text_col)).alias("__text"))
    return structure_chunks(joined, keys, "__text", size, overlap, punctuation=False)


def rebuilt(chunks: DataFrame, keys: list[str], index: str, content: str, step: int | None = None) -> DataFrame:
    """``keys, text``: the text that overlapping chunks of a document were cut from.

    A chunk gives what stands before the last place where the next one's opening is
    found in it, or all of itself if it is not found: chunks must share ``OPENING`` characters.
    That place is a guess where a text goes on repeating itself. ``step`` says how many words lie between the starts of
    windows of words, and makes it exact. Chunks must follow each other by ``index``.
    """
    following = F.substring(F.lead(content).over(Window.partitionBy(*keys).orderBy(index)), 1, OPENING)
    placed = chunks.select(*keys, index, F.col(content).alias("__c"), following.alias("__next"))
    back = F.instr(F.reverse("__c"), F.reverse("__next"))
    before = F.char_length("__c") - back - F.char_length("__next") + 1
    found, opening = back > 0, F.substring(F.col("__c"), F.lit(1), before)
    if step is not None:
        found, opening = F.col("__next").isNotNull(), F.concat(F.array_join(F.slice(T.words(F.col("__c")), 1, step), " "), F.lit(" "))
    own = F.when(found, opening).otherwise(F.col("__c"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), own.alias("c"))))
    return placed.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("text"))


def census(spans: DataFrame, text_col: str) -> DataFrame:
    """One row: how often each of the riders has something to act on."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    facts = {
        "heading_lines": count(raw, HEADING), "spans_with_heading": raw.rlike(HEADING).cast("int"), "page_breaks": count(raw, PAGE_BREAK),
        "form_feeds": count(raw, r"\f"), "broken_words": count(raw, BROKEN), "joined": count(raw, BROKEN) - count(dehyphenated(raw), BROKEN),
        "soft_hyphens": count(raw, SOFT_HYPHEN),
    }
    return spans.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in facts.items()])
