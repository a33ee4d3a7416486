"""Encoding with a public tokenizer, piece by piece.

For a tokenizer that lower-cases, drops white space and splits texts by a pattern before its merges, a text's ids are
those of its pieces in a row. Texts of Latin-1 characters are split here, and the library's model merges each piece
once; whatever else there is (other characters, special tokens' strings, other kinds of tokenizers) goes through the
library as a whole.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np
from tokenizers import Tokenizer

# Pieces of each of two generations: those still in use when the younger one is full outlive the older one.
KNOWN_PIECES = 300_000
LONG_PIECE = 64
# Bytes of texts whose ids are remembered, for copies; longer ones are encoded each time.
KNOWN_TEXTS, LONG_TEXT = 16 << 20, 1 << 17

# The pattern between white space of the lower-casing tokenizer, and its letters and digits in Latin-1.
LETTERS, DIGITS, SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\x09-\x0d\x20\x85\xa0"
PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACE}{LETTERS}{DIGITS}]+"
LIBRARY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; a bounded number of short pieces and of texts is remembered."""

    def __init__(self, path: str, special: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        made = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.split_here = kinds == ["NFC", "Replace", "Lowercase"] and splits == [LIBRARY_PATTERN, None]
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"]) or r"(?!)")
        self.pieces = re.compile(PIECES).findall
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, piece: str) -> bytes:
        if "Ā" > max(piece) and not piece.isascii():
            piece = piece.encode().decode("latin-1")
        tokens = self.tokenizer.model.tokenize(piece.translate(self.letters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if len(text) > LONG_TEXT:
            return self._ids(text)
        found = self.texts.get(text)
        if found is None:
            found = self._ids(text)
            self.held += 2 * len(text) + len(found)
            if self.held > KNOWN_TEXTS:
                self.texts.clear()
                self.held = 0
            self.texts[text] = found
        return found

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.split_here or not latin(text) or ("<" in text and self.marks.search(text)):
            return self._whole(text)
        found = self.pieces(text.lower())
        try:
            return b"".join([self.known[p] for p in found])
        except KeyError:
            pass
        if len(self.known) > KNOWN_PIECES:
            self.known, self.older = {}, self.known
        known, older, long = self.known, self.older, {}
        for piece in set(found).difference(known):
            if piece in older:
                known[piece] = older[piece]
            else:
                (long if len(piece) > LONG_PIECE else known)[piece] = self._merged(piece)
        return b"".join([known[p] if p in known else long[p] for p in found])


def latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def worker_encoder(path: str, special: bool = True) -> Encoder:
    """The process's encoder of a tokenizer: this module travels by value and is new in each task, a worker lives on."""
    name = "tallyforge_worker"
    encoders = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("encoders", {})
    if (path, special) not in encoders:
        encoders[path, special] = Encoder(path, special)
    return encoders[path, special]
