"""Batch encoding with the tokenizers library, one call per distinct pre-token.

Byte-pair encoding works on pre-tokens that never reach across certain places
in a text.  Texts are cut at such places into units; a unit's ids are made once,
from its pre-tokens' ids, which are made once by the library's model, and both
are kept in bounded caches as little-endian unsigned 32-bit ids.  So a text is
mostly dictionary look-ups and one join.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries in each of two generations of a worker's caches.  Bounds memory, not results.
CACHE_UNITS, CACHE_PIECES = 400_000, 300_000
#: Longer units and pre-tokens are encoded each time.
CACHE_CHARS = 48
#: Pre-tokens of byte-level encoding with the library's own pattern (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that end a word.
MARKS = frozenset(".,;:!?")
#: A space with white space on both sides is no safe cut.  Told widely: a text with any of these goes whole.
_RUNS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
_ODD_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f")
_ODD = ("\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")


def _unsafe(text: str) -> bool:
    if text[0] == " " or text[-1] == " " or any(r in text for r in _RUNS) or any(c in text for c in _ODD_ASCII):
        return True
    return not text.isascii() and any(c in text for c in _ODD)


def _byte_chars() -> dict[int, str]:
    """How byte-level models write each byte: itself where printable, else the next free character from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Cache(dict):
    """Makes missing entries; an entry of the older generation moves up when it is asked for."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes] | None = None):
        self.make, self.older = make, older or {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= CACHE_CHARS:
            self[key] = ids
        return ids

    def next(self, most: int) -> _Cache:
        """This cache, or a new generation if it is full."""
        if len(self) <= most:
            return self
        self.older = {}
        return _Cache(self.make, self)


class UnitEncoder:
    """Encodes texts like ``Tokenizer.encode(text, add_special_tokens=False)``.

    Three ways, told by the tokenizer's own description: ``lead`` (byte level
    with the library's pattern: a single space between two others starts a
    unit), ``drop`` (white space never reaches a token: a space or line feed
    separates units) and ``whole`` (anything else: no units, each text is
    encoded by the library).  Texts that hold an added token's string, and for
    ``lead`` texts with runs of white space around a space, go whole as well;
    so do units with characters from U+0250 on.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = [p["type"] for p in (norm or {}).get("normalizers", [])]
        # texts may only be cut at white space if that is what the file makes of it
        spaces = [(p.get("pattern"), p.get("content")) for p in (norm or {}).get("normalizers", []) if p["type"] == "Replace"] == [({"Regex": r"\s+"}, " ")]
        split = (pre.get("pretokenizers") or [{}])[0]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.way, pattern = "lead", BYTE_LEVEL
        elif parts == ["NFC", "Replace", "Lowercase"] and spaces and split.get("behavior") == "Removed" and split.get("invert"):
            self.way, pattern = "drop", split["pattern"]["Regex"]
        else:
            self.way, pattern = "whole", r"\X"
        self.find = regex.compile(pattern).findall
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.chars = _byte_chars()
        self.pieces = _Cache(self._piece)
        self.units = _Cache(self._led if self.way == "lead" else self._unit)
        self.heads = _Cache(self._unit)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token, by the library's model."""
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.chars[0x20])
        else:
            shown = piece.encode().decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.tok.model.tokenize(shown)]).tobytes()

    def _led(self, unit: str) -> bytes:
        """Ids of a unit after a space.  Letters are one pre-token with the space, a mark after them another."""
        if unit.isascii() or (max(unit) < "ɐ" and "İ" not in unit):
            if unit.isalpha():
                return self.pieces[" " + unit]
            if unit[-1:] in MARKS and unit[:-1].isalpha():
                return self.pieces[" " + unit[:-1]] + self.pieces[unit[-1]]
        return self._unit(" " + unit)

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if not unit.isascii():
            if max(unit) >= "ɐ" or "İ" in unit:  # no Latin letter, or one that lower case makes two of
                return self._whole(unit)
            if self.way == "drop":
                unit = unicodedata.normalize("NFC", unit)
        if self.way == "drop":
            unit = unit.lower()
        return b"".join(map(self.pieces.__getitem__, self.find(unit)))

    def rest(self) -> None:
        """Let the older generations go: a worker that is kept for other work need not hold them."""
        for cache in (self.units, self.heads, self.pieces):
            cache.older = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit bytes."""
        self.units, self.heads = self.units.next(CACHE_UNITS), self.heads.next(CACHE_UNITS // 8)
        self.pieces = self.pieces.next(CACHE_PIECES)
        known, out = self.units.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.way == "whole" or (self.added and "<" in text and self.added.search(text)):
                out.append(self._whole(text))
            elif self.way == "drop":
                out.append(b"".join(map(known, text.replace("\n", " ").split(" "))))
            elif _unsafe(text):
                out.append(self._whole(text))
            else:
                head, *units = text.split(" ")
                out.append(self.heads[head] + b"".join(map(known, units)))
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
