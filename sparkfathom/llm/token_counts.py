"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as exactly one token is proved once for a
vocabulary by encoding each of them. A text is split where no merge can cross;
pre-tokens that are such strings count one without being merged, and only the
rest go to the tokenizer, each distinct one once while a bounded memory keeps it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkfathom.llm import piece_model, shared

#: Distinct pre-tokens whose counts a worker remembers, and their longest.
REMEMBERED, LONGEST = 150_000, 64


@shared.cached
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def alone(path: str, parts: list[str]) -> list[int]:
    """Tokens of each pre-token by itself.

    They are encoded as one string with a line feed before each, which is a byte
    token that nothing merges with; the dummy space comes before the first.
    """
    if not parts:
        return []
    library = processor(path)
    ids = library.encode("".join("\n" + p for p in parts))
    feed = library.piece_to_id("<0x0A>")
    marks = [i for i, x in enumerate(ids) if x == feed]
    return [b - a - 1 for a, b in zip(marks, [*marks[1:], len(ids)], strict=True)]


@shared.cached
def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that are proved to encode as one token."""
    strings = [
        p.replace(piece_model.MARK, " ") for p, _, kind in piece_model.load(path).pieces if kind == piece_model.NORMAL
    ]
    return frozenset(s for s, n in zip(strings, alone(path, strings), strict=True) if n == 1)


def counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text as the library would.

    Its memory of pre-tokens lives as long as it does: one task.
    """
    if not piece_model.load(path).splits_safely():
        return lambda text: len(processor(path).encode(text))
    shortcut = dict.fromkeys(whole_tokens(path), 1) | {"\n": 1}
    memory: dict[str, int] = dict(shortcut)

    def count(text: str) -> int:
        total = 0
        for parts in piece_model.pretokens(text):
            counts = list(map(memory.get, parts))
            if None in counts:
                rest = [p for p, n in zip(parts, counts, strict=True) if n is None]
                fresh = list(dict.fromkeys(rest))
                known = dict(zip(fresh, alone(path, fresh), strict=True))
                total += sum(map(known.__getitem__, rest))
                if len(memory) > REMEMBERED:
                    memory.clear()
                    memory.update(shortcut)
                memory.update((p, n) for p, n in known.items() if len(p) <= LONGEST)
                total += sum(n for n in counts if n is not None)
            else:
                total += sum(counts)
        return total

    return count


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` (long) in place of the text.

    Counts are those of the sentencepiece library without begin, end or added
    tokens. Null and empty texts have 0 bytes and 0 tokens. Texts are counted
    whole, in windows if they are very long. Rows are independent, so nothing is
    shuffled and a lost task is simply run again. Columns of ``docs`` named
    ``n_bytes`` or ``n_tokens`` are replaced.
    """
    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def start():
        count = counter(piece_model.vocabulary_path(vocabulary))

        def compute(texts: pa.Array) -> list[pa.Array]:
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            return [sizes, pa.array([count(t.as_py() or "") for t in texts], pa.int64())]

        return compute

    return shared.with_arrow_columns(docs, names, docs[text_col], made, start)
