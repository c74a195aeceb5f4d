"""A quality classifier: a factorisation machine over words and structure.

Features of a text are its words, hashed into ``BUCKETS`` buckets, and a few
statistics of its structure and of its length. A factorisation machine scores
them with a weight for each and a low-rank interaction of each pair,

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ],

which takes time linear in the number of features. Language, source, identifier
and labels are never features.

The machine is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows,
chosen by a hash of their identifier; nothing else is bounded. Scoring is a map
over whole texts, so nothing is shuffled.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfathom.llm import shared

#: Labelled rows that the machine is fitted on, at most.
TRAIN_ROWS = 6000

BUCKETS, RANK, EPOCHS, BATCH, SEED = 1 << 14, 8, 12, 64, 11

#: Distinct words whose hash and shape a worker remembers.
REMEMBERED = 100_000

STATISTICS = [
    "log_words", "word_length", "upper", "repeated_next", "symbol_tail", "symbol_only", "distinct", "alnum",
    "digits", "line_breaks", "sentence_tail", "top_word", "line_length", "repeated_lines", "empty",
]

_SYMBOL_TAIL = re.compile(r"[^\w\s]{2,}$")
_UPPER, _TAIL, _ONLY, _STOP = 1, 2, 4, 8


class Words(dict):
    """Word -> (bucket, shape flags), computed once for each distinct word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        bare = word.strip("!?.,;:")
        flags = (
            (len(bare) > 1 and bare.isupper()) * _UPPER
            | bool(_SYMBOL_TAIL.search(word)) * _TAIL
            | (not any(map(str.isalnum, word))) * _ONLY
            | (word[-1] in ".,;:?!") * _STOP
        )
        known = (zlib.crc32(word.lower().encode()) % BUCKETS, flags)
        if len(self) < REMEMBERED:
            self[word] = known
        return known


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values; an empty text has its statistics only."""
    tokens = text.split()
    n = len(tokens)
    counts = Counter(tokens)
    lines = text.split("\n")
    per_line = Counter(lines)
    stats = np.zeros(len(STATISTICS))
    if n:
        keys = [words[w] for w in counts]
        times = np.fromiter(counts.values(), np.float64, len(counts))
        flags = np.fromiter((f for _, f in keys), np.int64, len(keys))
        share = lambda flag: float(times[(flags & flag) > 0].sum()) / n
        letters = sum(map(len, re.findall(r"[^\W_]+", text)))
        stats[:] = [
            np.log1p(n) / 5,
            sum(map(len, tokens)) / n / 8,
            share(_UPPER),
            sum(map(operator.eq, tokens, tokens[1:])) / n,
            share(_TAIL),
            share(_ONLY),
            len(counts) / n,
            letters / len(text),
            sum(map(text.count, "0123456789")) / len(text) * 4,
            (len(lines) - 1) / n * 8,
            share(_STOP),
            times.max() / n,
            np.log1p(len(text) / len(lines)) / 6,
            1 - len(per_line) / len(lines),
            0.0,
        ]
        buckets = np.fromiter((b for b, _ in keys), np.int64, len(keys))
        ids, back = np.unique(buckets, return_inverse=True)
        values = np.log1p(np.bincount(back, times))
        values /= np.sqrt((values**2).sum())
    else:
        stats[-1] = 1.0
        ids, values = np.empty(0, np.int64), np.empty(0)
    return (
        np.concatenate([ids, BUCKETS + np.arange(len(STATISTICS))]).astype(np.int32),
        np.concatenate([values, stats]),
    )


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, ids: np.ndarray, x: np.ndarray) -> float:
        """Linear time: the square of the sum less the sum of the squares."""
        vx = self.factors[ids] * x[:, None]
        pairs = 0.5 * float((vx.sum(0) ** 2).sum() - (vx**2).sum())
        return self.bias + float(self.weights[ids] @ x) + pairs

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids, x), -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Machine:
    """Adaptive gradient descent on the logistic loss, reproducible.

    Without rows every score is one half; with one label only, scores are near it.
    """
    size = BUCKETS + len(STATISTICS)
    rng = np.random.default_rng(SEED)
    y = np.array(labels, np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if not rows:
        return m
    sum_w, sum_v, sum_b = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sizes = np.array([len(rows[i][0]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            vx = m.factors[ids] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            logits = m.bias + np.add.reduceat(m.weights[ids] * x, starts) + pairs
            slope = (1 / (1 + np.exp(-np.clip(logits, -35, 35))) - y[batch]) / len(batch)
            g = np.repeat(slope, sizes) * x
            touched, back = np.unique(ids, return_inverse=True)
            grad_w = np.bincount(back, g) + 1e-5 * m.weights[touched]
            raw_v = g[:, None] * (np.repeat(sums, sizes, 0) - vx)
            grad_v = np.stack([np.bincount(back, raw_v[:, f]) for f in range(RANK)], 1) + 1e-5 * m.factors[touched]
            sum_w[touched] += grad_w**2
            sum_v[touched] += grad_v**2
            sum_b += slope.sum() ** 2
            m.weights[touched] -= 0.1 * grad_w / np.sqrt(sum_w[touched])
            m.factors[touched] -= 0.05 * grad_v / np.sqrt(sum_v[touched])
            m.bias -= float(0.1 * slope.sum() / np.sqrt(sum_b))
    return m


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the identifier's text mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, quality, text)`` of ``limit`` labelled rows outside the held-out fold.

    Labels are chosen first, without texts, so the table that is broadcast has
    ``limit`` rows at most. Rows with a null identifier or label are left out.
    """
    chosen = (
        labels.select(labels["doc_id"], labels["quality"])
        .where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(limit)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Machine:
    """Fit a machine; features are computed in the cluster."""
    shared.modest_batches(docs.sparkSession)
    schema = "doc_id long, quality int, ids array<int>, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            made = [features(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([i for i, _ in made], pa.list_(pa.int32())),
                    pa.array([x for _, x in made], pa.list_(pa.float64())),
                ],
                ["doc_id", "quality", "ids", "x"],
            )

    got = training_rows(docs, labels, limit).mapInArrow(shared.tidy(run), schema).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    arrays = lambda name: [np.array(v.values) for v in got.column(name)]
    rows = list(zip(arrays("ids"), arrays("x"), strict=True))
    return fit(rows, [int(q > 0) for q in got.column("quality").to_pylist()])


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1], higher for better; null texts count as empty.

    Texts are scored whole. An existing column named as the score is replaced.
    """
    names = [c for c in docs.columns if c != score_col]
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def start():
        words, m = Words(), model.value
        return lambda texts: [pa.array([m.score(*features(t.as_py(), words)) for t in texts], pa.float64())]

    text = F.coalesce(docs[text_col], F.lit(""))
    return shared.with_arrow_columns(docs, names, text, [T.StructField(score_col, T.DoubleType())], start)
