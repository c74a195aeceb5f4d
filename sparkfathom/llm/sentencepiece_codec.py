"""SentencePiece encoding and decoding on the tokenizers library.

``backend`` rebuilds a model of the SentencePiece format in the tokenizers
library: normaliser, metaspace marker, unigram scores or pair merges, byte
fallback and decoder. Texts are split where no merge can cross, distinct
pre-tokens are encoded in multithreaded batches, and texts are put together from
ids of their pre-tokens. Each pre-token is checked against the sentencepiece
library when it is met: where the two differ, the latter's ids are taken and the
rows that hold it say so.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkfathom.llm import piece_model, shared, token_counts
from sparkfathom.llm.piece_model import BPE, BYTE, CONTROL, MARK, UNKNOWN, PieceModel

#: Distinct pre-tokens whose ids a worker remembers, and their longest.
REMEMBERED, LONGEST = 150_000, 64

#: Pre-tokens that are encoded as one string, and characters of text at a time.
PARTS, CHARACTERS = 512, 1 << 18

#: Threads that a worker encodes batches with, unless its environment says so.
THREADS = "2"

#: Fixed value: what an unknown piece decodes to in this format.
UNKNOWN_SURFACE = " ⁇ "


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """Pair merges in the order in which the model prefers their results."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == piece_model.NORMAL}
    found = []
    for piece, score, kind in model.pieces:
        if kind == piece_model.NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in rank and right in rank:
                    found.append((-score, rank[piece], rank[left], rank[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def backend(model: PieceModel, dummy_prefix: bool | None = None, cache: int = 10_000):
    """The model as a tokenizer of the tokenizers library.

    ``cache`` is how many strings a pair-merge model remembers with their ids.
    """
    from tokenizers import Tokenizer, decoders, models, normalizers

    prefix = model.add_dummy_prefix if dummy_prefix is None else dummy_prefix
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.model_type == BPE:
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(model.pieces)},
            merges=merges_of(model),
            unk_token=model.pieces[unknown][0] if unknown is not None else None,
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
            cache_capacity=cache,
        )
    elif model.model_type == piece_model.UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        raise ValueError("only unigram and pair-merge models can be rebuilt")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(" {2,}", " ")]
    steps += [normalizers.Prepend(MARK)] * prefix + [normalizers.Replace(" ", MARK)] * model.escape_whitespaces
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if prefix else []
    named = [decoders.Replace(model.pieces[unknown][0], UNKNOWN_SURFACE)] if unknown is not None else []
    tokenizer.decoder = decoders.Sequence(
        [*named, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip]
    )
    return tokenizer


def cut_at(ids: list[int], mark: int) -> list[bytes]:
    """The ids between the marks, each run as the bytes of 32-bit integers."""
    flat = np.array(ids, np.int32)
    raw, cuts = flat.tobytes(), (4 * np.flatnonzero(flat == mark)).tolist()
    return [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]


@shared.cached
def parts_backend(path: str):
    """For strings of many pre-tokens, which never come twice: nothing to remember."""
    return backend(piece_model.load(path), dummy_prefix=False, cache=0)


def encoder(path: str) -> Callable[[list[str]], list[tuple[bytes, bool, bool]]]:
    """A function from texts to the bytes of their 32-bit ids, parity and round trip.

    Unknown pre-tokens of all texts go to the rebuilt tokenizer in strings of
    PARTS of them, with a line feed between two, which is a byte token that
    nothing merges with. Its ids count; the same strings go to the library and
    the ids back through the decoder. Merges and byte sequences never cross
    pre-tokens, so a text has parity, and comes back, if its pre-tokens do.
    The memory of pre-tokens lives as long as the function: one task.
    """
    model, library = piece_model.load(path), token_counts.processor(path)
    if not model.splits_safely():
        whole, to_texts = backend(model), decoder(path)

        def whole_texts(texts: list[str]) -> list[tuple[bytes, bool, bool]]:
            ours = [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = library.encode(texts, num_threads=1)
            back = to_texts(theirs)
            return [
                (np.array(b, np.int32).tobytes(), a == b, got == text.replace(MARK, " "))
                for a, b, got, text in zip(ours, theirs, back, texts, strict=True)
            ]

        return whole_texts
    parts_only = parts_backend(path)
    line_feed = next(i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE and p == "<0x0A>")
    start = {"\n": np.int32(line_feed).tobytes()}
    memory: dict[str, bytes] = dict(start)
    repaired: set[str] = set()
    lost: set[str] = set()

    def learn(fresh: list[str]) -> dict[str, bytes]:
        joined = ["\n".join(fresh[i : i + PARTS]) for i in range(0, len(fresh), PARTS)]
        ours = [x.ids for x in parts_only.encode_batch_fast(joined, add_special_tokens=False)]
        # The library puts a dummy space first: a line feed of its own shields the first part.
        theirs = library.encode(["\n" + x for x in joined], num_threads=1)
        back = parts_only.decode_batch(ours, skip_special_tokens=False)
        known: dict[str, bytes] = {}
        for at, (got, want, text) in enumerate(zip(ours, theirs, back, strict=True)):
            some = fresh[at * PARTS : (at + 1) * PARTS]
            known.update(zip(some, cut_at(got, line_feed), strict=True))
            if got != want[2:]:
                other = {p: x for p, x in zip(some, cut_at(want[2:], line_feed), strict=True) if x != known[p]}
                repaired.update(other)
                known.update(other)
            if text != joined[at]:
                lost.update(p for p in some if parts_only.decode(np.frombuffer(known[p], np.int32).tolist()) != p)
        return known

    def to_ids(texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        split = [[p for parts in piece_model.pretokens(t) for p in parts] for t in texts]
        fresh = set(chain.from_iterable(split)).difference(memory)
        if len(memory) + len(fresh) > REMEMBERED:
            memory.clear()
            memory.update(start)
            repaired.clear()
            lost.clear()
            fresh = set(chain.from_iterable(split)).difference(memory)
        if fresh:
            memory.update(learn(list(fresh)))
        free = lambda bad, parts: not bad or bad.isdisjoint(parts)
        out = [(b"".join(map(memory.__getitem__, parts)), free(repaired, parts), free(lost, parts)) for parts in split]
        for p in fresh:
            if len(p) > LONGEST:
                del memory[p]
        return out

    return to_ids


@shared.cached
def decoder(path: str) -> Callable[[list[list[int]]], list[str]]:
    """A function from lists of ids to their texts, by the rebuilt tokenizer.

    Control pieces give nothing, as in the format's own library.
    """
    model = piece_model.load(path)
    whole = backend(model)
    silent = {i for i, (_, _, kind) in enumerate(model.pieces) if kind == CONTROL}

    def decode(lists: list[list[int]]) -> list[str]:
        heard = [ids if silent.isdisjoint(ids) else [i for i in ids if i not in silent] for ids in lists]
        return whole.decode_batch(heard, skip_special_tokens=False)

    return decode


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of about CHARACTERS characters; null is empty."""
    group, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        group.append(text)
        size += len(text)
        if size > CHARACTERS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens``, ``parity`` and ``round_trip``.

    Ids are those of the rebuilt tokenizer, without begin or end tokens;
    ``parity`` says whether the sentencepiece library gives the same (its ids
    stand in for pre-tokens where it does not). ``round_trip`` says whether
    decoding the ids gives the text again, the marker character, if it occurs,
    read as a space. Null and empty texts have no ids and are true in
    both. Texts of any length are encoded whole. Rows are
    independent: nothing is shuffled. Columns with the new names are replaced.
    """
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType(), T.BooleanType())
    made = [T.StructField(n, k) for n, k in zip(("token_ids", "n_tokens", "parity", "round_trip"), kinds, strict=True)]
    names = [c for c in docs.columns if c not in [f.name for f in made]]

    def start():
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        path = piece_model.vocabulary_path(vocabulary)
        to_ids = encoder(path)

        def compute(texts: pa.Array) -> list[pa.Array]:
            flat, ends, parity, same = [], [0], [], []
            for group in groups(texts):
                for raw, alike, back in to_ids(group):
                    flat.append(raw)
                    ends.append(ends[-1] + len(raw) // 4)
                    parity.append(alike)
                    same.append(back)
            values = pa.array(np.frombuffer(b"".join(flat), np.int32))
            counts = pa.array(np.diff(np.array(ends, np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            return [lists, counts, pa.array(parity, pa.bool_()), pa.array(same, pa.bool_())]

        return compute

    return shared.with_arrow_columns(docs, names, docs[text_col], made, start)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with ``text_col`` decoded from ``ids_col``; null ids give null."""
    names = [c for c in encoded.columns if c != text_col]

    def start():
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        to_texts = decoder(piece_model.vocabulary_path(vocabulary))

        def compute(rows: pa.Array) -> list[pa.Array]:
            given = rows.to_pylist()
            texts = iter(to_texts([x for x in given if x is not None]))
            return [pa.array([None if x is None else next(texts) for x in given], pa.string())]

        return compute

    return shared.with_arrow_columns(encoded, names, encoded[ids_col], [T.StructField(text_col, T.StringType())], start)
