"""Shingle sets of many texts at once, as sorted arrays of 64-bit fingerprints (numpy, for use inside tasks)."""

from __future__ import annotations

import re

import numpy as np

_U = np.uint64
_SPAN = 1 << 12
_LETTER = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=_U)
_BASE = np.full(_SPAN, _U(0x9E3779B97F4A7C15))
_BASE[0] = 1
_POWER = np.multiply.accumulate(_BASE)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
# Bytes of text that are hashed at once; each takes about 50 bytes of arrays meanwhile.
PIECE = 256 << 10


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def word_prints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and start of each word of a run of bytes, A-Z lower-cased."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    opens = inside.copy()
    opens[1:] &= space[:-1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.empty(0, _U), starts
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(opens) - 1, 0)]
    terms = np.where(inside, _LETTER[lower] * _POWER[place & (_SPAN - 1)], _U(0))
    return mix(np.add.reduceat(terms, starts)), starts


def _parts(text: bytes):
    """A long text in parts cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Distinct ``size``-word shingles of each text; the whole text where it has fewer words; none without words."""
    out: list[np.ndarray] = [np.empty(0, _U)] * len(texts)
    held: list[int] = []
    length = 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            found = np.concatenate([word_prints(np.frombuffer(p, np.uint8))[0] for p in _parts(text)])
            out[i] = _sets(found, np.array([0, len(found)]), size)[0]
        elif text:
            if length + len(text) > PIECE:
                _together(texts, held, size, out)
                held, length = [], 0
            held.append(i)
            length += len(text) + 1
    _together(texts, held, size, out)
    return out


def _together(texts: list[bytes], held: list[int], size: int, out: list[np.ndarray]) -> None:
    if not held:
        return
    joined = np.frombuffer(b" ".join([texts[i] for i in held]) + b" ", np.uint8)
    found, starts = word_prints(joined)
    edges = np.cumsum([0] + [len(texts[i]) + 1 for i in held])
    for i, made in zip(held, _sets(found, np.searchsorted(starts, edges), size)):
        out[i] = made


def _sets(found: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    rolled = found.copy()
    for j in range(1, size):
        rolled = mix(rolled[:-1] * _U(0x9FB21C651E98DF25) + found[j:]) if len(rolled) > 1 else rolled[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = found[a : a + 1]
            for j in range(a + 1, b):
                whole = mix(whole * _U(0x9FB21C651E98DF25) + found[j : j + 1])
            out.append(mix(whole + _U(b - a)))
        else:
            out.append(found[:0])
    return out
