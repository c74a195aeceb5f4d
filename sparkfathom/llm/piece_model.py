"""Reading a SentencePiece model file and splitting texts where no merge can cross.

The file is a protocol buffer; the few fields needed are read straight from its
wire format, so no generated code is required.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from sparkfathom.llm.shared import cached

#: The metaspace marker that stands for a space inside pieces.
MARK = "▁"

#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Model types of the model format.
UNIGRAM, BPE = 1, 2

#: Texts are split in windows of about so many characters, to bound memory.
WINDOW = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (field number, value) pairs of one protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind} is not supported")
        yield number, value


@dataclass(frozen=True)
class PieceModel:
    """Pieces and the settings of the normaliser and trainer that matter here."""

    pieces: list[tuple[str, float, int]] = field(repr=False)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = field(default=b"", repr=False)
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, settings = [], {}
        for number, value in wire_fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(wire_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                trainer = dict(wire_fields(value))
                settings |= {"model_type": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0))}
            elif number == 3:
                spec = dict(wire_fields(value))
                settings |= {
                    "charsmap": spec.get(2, b""),
                    "add_dummy_prefix": bool(spec.get(3, 1)),
                    "remove_extra_whitespaces": bool(spec.get(4, 1)),
                    "escape_whitespaces": bool(spec.get(5, 1)),
                }
        return cls(pieces, **settings)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    def splits_safely(self) -> bool:
        """Whether texts may be split before spaces and around line feeds.

        Merges never cross such places if spaces are kept as they are and no
        piece holds a line feed or a marker after another character. Unigram
        models choose a best path over the whole text, which these places cut
        in the same way.
        """
        plain = not self.charsmap and self.add_dummy_prefix and self.escape_whitespaces
        return (
            plain
            and self.byte_fallback
            and not self.remove_extra_whitespaces
            and all(MARK not in p.lstrip(MARK) and "\n" not in p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
            and all(kind != USER_DEFINED for _, _, kind in self.pieces)
        )


@cached
def load(path: str) -> PieceModel:
    return PieceModel.load(path)


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a vocabulary: a path, or the name of a public one."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_PRETOKEN = re.compile(r" *[^ \n]+| +|\n")
_CUT = re.compile(r"(?<=[^ ]) |\n")


def windows(text: str) -> Iterator[str]:
    """The text in pieces of about WINDOW characters, cut where no merge crosses."""
    at = 0
    while len(text) - at > WINDOW:
        cut = _CUT.search(text, at + WINDOW)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pretokens(text: str) -> Iterator[list[str]]:
    """Lists of pre-tokens: spaces before a word, a word, a line feed.

    Their concatenation is the text as the model sees it, with the dummy space
    in front and the marker read as a space. An empty text has none.
    """
    if text:
        seen = " " + (text.replace(MARK, " ") if MARK in text else text)
        for part in windows(seen):
            yield _PRETOKEN.findall(part)
