"""Word shingles and their MinHash signatures, in numpy.

Words are runs of bytes other than ASCII white space, A to Z lower-cased. A shingle
is ``width`` words in a row; a text of fewer words is one shingle. Words and shingles
are 64-bit hashes, computed for many texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Bytes of text that are hashed at a time; a longer text goes by itself.
TOGETHER = 1 << 20

#: Bytes of a word up to which words are hashed side by side, byte by byte.
SHORT = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Start and factor of the FNV-1a hash.
_FNV_START, _FNV_FACTOR = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts, and its 64-bit hash."""
    low = _LOWER[text]
    space = np.concatenate([[True], _SPACE[text], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    order = np.argsort(-sizes, kind="stable")
    first, longest = starts[order], sizes[order]
    value = np.full(len(order), _FNV_START)
    # Words that are longer than k come first; how many these are shrinks with k.
    more = len(order) - np.searchsorted(longest[::-1], np.arange(SHORT), "right")
    for k in range(SHORT):
        if not more[k]:
            break
        part = value[: more[k]]
        part ^= low[first[: more[k]] + k]
        part *= _FNV_FACTOR
    for i in range(len(order) - int(np.searchsorted(longest[::-1], SHORT, "right"))):
        value[i] = xxhash.xxh64_intdigest(low[first[i] : first[i] + longest[i]].tobytes())
    out = np.empty_like(value)
    out[order] = mixed(value)
    return starts, out


def _sets_of(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    starts, hashes = word_hashes(joined)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, begins)

    def rolled(values: np.ndarray, size: int) -> np.ndarray:
        out = np.full(max(0, len(values) - size + 1), size, np.uint64)
        for i in range(size):
            out = mixed(out * _ODD + values[i : i + len(out)])
        return out

    shingles, found = rolled(hashes, width), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = shingles[a : b - width + 1] if b - a >= width else rolled(hashes[a:b], b - a) if b > a else hashes[:0]
        part = np.sort(part)
        if len(part):
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        found.append(part)
    return found


def shingle_sets(texts: Sequence[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, whole; none without words."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > TOGETHER:
            yield from _sets_of(held, width)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield from _sets_of(held, width)


def digest_of(text: bytes) -> bytes | None:
    """SHA-256 of the word sequence: equal for equal sequences only; null without words.

    ``bytes.lower`` and ``bytes.split`` do exactly what the word rule says.
    """
    words = text.lower().split()
    return hashlib.sha256(b" ".join(words)).digest() if words else None


class MinHash:
    """``size`` minima of a set under as many hash functions, ``bits`` of each kept."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.multipliers = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 2**63, size, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """16 bits of each minimum; multiply-add hashes, compared by their upper bits."""
        out = np.full(len(self.multipliers), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            np.minimum(out, (part[None, :] * self.multipliers[:, None] + self.offsets[:, None]).min(1), out)
        return (mixed(out) >> np.uint64(48)).astype(np.uint16)
