"""Spans of regular-expression matches, in DataFrame functions only.

A span is ``(start, ord, end, kind, body)``: code points, end exclusive; ``ord``
is the place of the kind in its list, so that structs sort by start, then kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfathom.llm.shared import held, with_prefix_sums

#: The Spark type of a list of spans.
SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string,body:string>>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], possible: dict[str, Column], prefix: str) -> DataFrame:
    """``df`` with ``<prefix><kind>``: the spans of each pattern in the column ``text``.

    Matches are leftmost and do not overlap; patterns are Java's. What lies
    between the matches has known lengths, and so the matches have known places.
    ``possible`` has cheap conditions without which a kind has no match. Each
    step is held, so each pattern runs a fixed number of times over a text,
    however many matches it has.
    """
    body = F.col(text)
    name = {k: f"{prefix}{k}" for k in patterns}
    none = F.array().cast("array<string>")

    def hits(kind: str) -> Column:
        can = body.rlike(patterns[kind])
        can = possible[kind] & can if kind in possible else can
        return F.when(can, F.regexp_extract_all(body, F.lit(patterns[kind]), F.lit(0))).otherwise(none)

    def steps(kind: str) -> Column:
        found = F.col(name[kind])
        gaps = F.when(F.size(found) > 0, F.split(body, patterns[kind], -1)).otherwise(none)
        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.char_length(g) + F.char_length(h))
        return F.transform(pairs, lambda n: n.cast("long"))

    def spans(kind: str, order: int) -> Column:
        both = F.arrays_zip(F.col(name[kind]).alias("body"), F.col(f"{name[kind]}__end").alias("end"))
        return F.transform(
            both,
            lambda s: F.struct(
                (s["end"] - F.char_length(s["body"])).cast("long").alias("start"),
                F.lit(order).alias("ord"),
                s["end"].cast("long").alias("end"),
                F.lit(kind).alias("kind"),
                s["body"].alias("body"),
            ),
        ).cast(SPANS)

    df = held(df, **{name[k]: hits(k) for k in patterns})
    df = held(df, **{f"{name[k]}__end": steps(k) for k in patterns})
    df = with_prefix_sums(df, [f"{name[k]}__end" for k in patterns])
    df = held(df, **{name[k]: spans(k, i) for i, k in enumerate(patterns)})
    return df.drop(*[f"{name[k]}__end" for k in patterns])


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
