"""Secret scanning by two character Markov models.

Fixed expressions give the base kinds (assignments, access keys, hexadecimal
runs). The method adds ``random`` spans: long unbroken strings that a model of
random strings explains better than one of ordinary identifiers, by the
log-likelihood ratio of their character transitions.

Both models are trained from labelled samples in DataFrame functions. Samples
are bounded by ``SAMPLES`` strings a label; the model is one number for each
pair of characters of a fixed alphabet, so it may be a literal in the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.llm import spans as S
from sparkfathom.llm.shared import held

ASSIGN = (
    r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
)
_ASSIGN_VALUE = r"^(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
RANDOM = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])"

KINDS = ["assign", "access", "hex", "random"]
BASE = KINDS[:3]

#: Characters the models tell apart; pairs are numbered row by row.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Labelled strings of each label that train the models, at most.
SAMPLES = 4000

#: Mean log-likelihood ratio of a transition above which a string is random.
LEAST_RATIO = 0.3

#: Words that ordinary identifiers are made of in the samples.
PARTS = (
    "get set is has to from make build create update delete remove find load save read write open close "
    "start stop run init parse format encode decode user name item list index count total value key map "
    "node tree file path line text word page table row column field type kind class object method "
    "function module package config option default handler manager service client server request "
    "response session message event queue buffer stream reader writer cache store version result error "
    "warning debug test sample data model view controller factory provider adapter wrapper helper"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """``(text, random)``: random strings and ordinary identifiers, ``n`` of each.

    Samples are numbered; ``first`` is the number of the first one, so that others
    than those of the training can be drawn.

    Random strings are digests in base 64 or hexadecimal; identifiers join words
    in camel case, with underscores or hyphens, some with a number at the end.
    """
    ids = spark.range(first, first + n)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    randoms = ids.select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40))
        .otherwise(F.substring(F.base64(F.unhex(digest)), 1, 40))
        .alias("text"),
        F.lit(True).alias("random"),
    )
    parts = F.array(*[F.lit(p) for p in PARTS])
    size = (F.pmod(F.xxhash64("id"), F.lit(4)) + 2).cast("int")
    picked = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.get(parts, F.pmod(F.xxhash64("id", i), F.lit(len(PARTS))).cast("int")),
    )
    camel = F.array_join(F.transform(picked, F.initcap), "")
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(4))
    joined = (
        F.when(style == 0, camel)
        .when(style == 1, F.array_join(picked, "_"))
        .when(style == 2, F.array_join(picked, "-"))
        .otherwise(F.upper(F.array_join(picked, "_")))
    )
    tail = F.when(F.pmod(F.xxhash64("id", F.lit("tail")), F.lit(5)) == 0, F.col("id").cast("string")).otherwise("")
    return randoms.unionByName(ids.select(F.concat(joined, tail).alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of characters, row by row.

    Transitions are counted in the cluster; what comes back has one row for each
    pair at most. Counts start at one half, so no pair is impossible. Null texts,
    null labels and characters outside the alphabet are left out.
    """
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    pairs = (
        samples.where("text is not null and random is not null")
        .select("random", chars.alias("cs"))
        .select("random", F.explode(F.arrays_zip(F.col("cs").alias("a"), F.slice("cs", 2, F.size("cs")).alias("b"))).alias("p"))
        .where("p.a is not null and p.b is not null")
    )
    both = lambda label: F.count_if(F.col("random") == F.lit(label))
    place_a = F.expr(f"instr('{ALPHABET}', p.a)")
    place_b = F.expr(f"instr('{ALPHABET}', p.b)")
    counts = (
        pairs.select("random", place_a.alias("a"), place_b.alias("b"))
        .where("a > 0 and b > 0")
        .groupBy("a", "b")
        .agg(both(True).alias("r"), both(False).alias("o"))
        .collect()
    )
    k = len(ALPHABET)
    seen = {(row["a"] - 1, row["b"] - 1): (row["r"], row["o"]) for row in counts}
    ratio = []
    for a in range(k):
        line = [seen.get((a, b), (0, 0)) for b in range(k)]
        n_random, n_ordinary = sum(x for x, _ in line) + k / 2, sum(y for _, y in line) + k / 2
        ratio += [math.log((x + 0.5) / n_random) - math.log((y + 0.5) / n_ordinary) for x, y in line]
    return ratio


def mean_ratio(text: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of the transitions of a string of the alphabet."""
    codes = F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1
    )
    moves = F.zip_with(
        F.slice(codes, 1, F.size(codes) - 1),
        F.slice(codes, 2, F.size(codes) - 1),
        lambda a, b: F.get(ratios, a * len(ALPHABET) + b),
    )
    total = F.aggregate(moves, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return total / F.greatest(F.size(codes) - 1, F.lit(1))


def model_column(ratios: list[float]) -> Column:
    """The model as a constant array."""
    return F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")


def find_secrets(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_base``, ``secret_all`` (spans) and ``secret_ratios``.

    Null texts count as empty and have no spans; texts are scanned whole. A
    ``random`` span has a letter and a digit, 20 characters or more, a mean ratio
    of LEAST_RATIO at least over its whole length, and lies in no base span. ``secret_ratios`` holds
    the mean ratio of each span of ``secret_all``.
    """
    body, model = F.col("__sec_text"), model_column(ratios)
    out = docs.withColumn("__sec_text", F.coalesce(docs[text_col], F.lit("")))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RANDOM}
    possible = {
        "assign": F.contains(body, F.lit("=")) | F.contains(body, F.lit(":")),
        "access": F.contains(body, F.lit("AKIA")),
    }
    out = S.with_matches(out, "__sec_text", patterns, possible, "__sec_")
    value = lambda s: F.regexp_extract(s["body"], _ASSIGN_VALUE, 1)
    out = held(
        out,
        __sec_assign=F.filter("__sec_assign", lambda s: F.length(value(s)) >= 12),
        __sec_access=F.filter("__sec_access", lambda s: F.length(s["body"]) >= 18),
        __sec_random=F.filter(
            "__sec_random",
            lambda s: s["body"].rlike("[0-9]")
            & s["body"].rlike("[A-Za-z]")
            & (mean_ratio(s["body"], model) >= LEAST_RATIO),
        ),
    )
    out = held(out, secret_base=F.array_sort(F.concat(*[F.col(f"__sec_{k}") for k in BASE])))
    apart = F.filter(
        "__sec_random",
        lambda s: ~F.exists("secret_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    out = held(out, secret_all=F.array_sort(F.concat("secret_base", apart)))
    out = held(out, secret_ratios=F.transform("secret_all", lambda s: mean_ratio(s["body"], model)))
    return out.drop("__sec_text", *[f"__sec_{k}" for k in KINDS])
