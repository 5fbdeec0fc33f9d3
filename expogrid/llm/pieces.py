"""SentencePiece models in plain Python: the parts of the model file that encoding depends on.

The wire format is protocol buffers; field numbers are those of the public sentencepiece_model.proto.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of one message; varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    normalizer: str = ""
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_blanks: bool = True
    escape_blanks: bool = True
    suffix_mark: bool = False
    unk_id: int = 0

    @property
    def plain(self) -> bool:
        """Characters are encoded as they stand: only blanks change, one for one, and one mark goes in front."""
        return not self.charsmap and self.dummy_prefix and not self.collapse_blanks and self.escape_blanks and not self.suffix_mark

    def joined(self) -> set[tuple[str, str]]:
        """Pairs of neighbouring characters inside any piece. No token ever spans a pair that is not among them."""
        return {pair for text, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED) for pair in zip(text, text[1:])}


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix_mark = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:
            for n, v in fields(value):
                if n == 1:
                    model.normalizer = v.decode("utf-8")
                elif n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.collapse_blanks = bool(v)
                elif n == 5:
                    model.escape_blanks = bool(v)
    return model
