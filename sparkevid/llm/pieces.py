"""A SentencePiece model file: pieces, scores, kinds and the settings that encoding depends on."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

SPACE = "▁"
#: The kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield number, data[i : i + size]
            i += size


@dataclass
class Pieces:
    ids: dict[str, int] = field(default_factory=dict)  # of normal, user-defined and unused pieces
    names: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    byte_ids: dict[int, int] = field(default_factory=dict)
    longest: int = 1
    dummy_prefix: bool = True
    alone: frozenset[str] = frozenset()  # white space and control characters that occur in no piece

    def runs(self) -> re.Pattern[str]:
        """Cuts a text where no piece can lie across: at the start of a row of spaces, around ``alone`` characters, and between signs and
        others. Signs are the ASCII characters other than letters, with all that stand beside signs in some piece; if these come to
        include a letter, there are none."""
        pairs = {(a, b) for n in self.ids for a, b in zip(n, n[1:], strict=False) if SPACE not in (a, b)}
        apart = {chr(i) for i in range(33, 127) if not chr(i).isalpha()}
        while joined := {c for a, b in pairs if (a in apart) != (b in apart) for c in (a, b)} - apart:
            apart |= joined
        signs = "" if any(c.isalpha() for c in apart) else "".join(sorted(map(re.escape, apart)))
        stop = "".join(sorted(map(re.escape, self.alone)))
        if not signs:
            return re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+|[{stop}]+")
        return re.compile(f"{SPACE}*[^{SPACE}{signs}{stop}]+|{SPACE}*[{signs}]+|{SPACE}+|[{stop}]+")

    def normalized(self, text: str) -> str:
        """Spaces escaped, with the dummy prefix; an empty text stays empty."""
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """Models with identity normalisation, kept white space and byte fallback; others are refused."""
    if path in _loaded:
        return _loaded[path]
    out = Pieces()
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            name, kind = x[1].decode(), x.get(3, NORMAL)
            i = len(out.names)
            out.names.append(name)
            out.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
            out.kinds.append(kind)
            if kind in (NORMAL, USER_DEFINED, UNUSED):
                out.ids[name] = i
                out.longest = max(out.longest, len(name))
            elif kind == BYTE:
                out.byte_ids[int(name[3:5], 16)] = i
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2) or normalizer.get(4, 1) or len(out.byte_ids) != 256 or trainer.get(24) or any(k in (USER_DEFINED, UNUSED) for k in out.kinds):
        raise ValueError("not a plain model: identity normalisation, kept white space and byte fallback are supported")
    if any(SPACE in n.lstrip(SPACE) for n in out.ids):
        raise ValueError("a piece has a space inside")
    out.dummy_prefix = bool(normalizer.get(3, 1))
    used = {c for n in out.ids for c in n}
    out.alone = frozenset(chr(i) for i in (*range(32), 127)) - used
    _loaded[path] = out
    return out
