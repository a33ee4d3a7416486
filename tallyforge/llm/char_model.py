"""A character language model counted over a whole corpus, and the decoding of disguised words under it.

Disguises are seen as a noisy channel: a writer meant letters, and put signs for some of them (leetspeak), repeated
some, or set separators between them. A disguised piece of text is a lattice of what each sign may stand for, and the
Viterbi path through it, scored by channel and language model together, is the text that was meant.

The model conditions a letter on the three before it in its word. Letters are a-z; every character beyond ASCII is
of one further class, and whatever else there is ends a word. Counts of all 28^4 sequences come from all documents; higher
orders fall back on lower ones in proportion to what was seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS, ORDER = 28, 4
SIZE = KINDS**ORDER
BEFORE = SIZE // KINDS
OTHER = KINDS - 1
SLICE = 1 << 20

# Classes of UTF-8 bytes: a letter beyond ASCII counts by its first byte, the others are left out.
FOLLOWING = bytes(range(0x80, 0xC0))
CLASSES = bytes(
    b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else OTHER if b >= 0xC0 else 0 for b in range(256)
)

# The letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "§": "s", "*": "aeiou",
}
SEPARATORS = " .-_/~'·"

# Logarithms of what the channel does.
SIGN_MEANT, SIGN_KEPT = np.log(0.5), np.log(0.02)
ONE_OF_TWO, TWO_OF_TWO, OF_MANY = np.log(0.1), np.log(0.9), np.log(0.5)
DROPPED, PARTED = np.log(0.6), np.log(0.4)

BEAM = 24


class Counts:
    """Counts of class sequences of UTF-8 texts, gathered in slices of bounded size."""

    def __init__(self):
        self.counts = np.zeros(SIZE, np.int64)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        """Texts are set apart by ends of words; what is held is counted from ``SLICE`` bytes on."""
        self.held += [bytes(ORDER - 1), text.translate(CLASSES, FOLLOWING)]
        self.size += len(text)
        if self.size >= SLICE:
            self.flush()

    def flush(self) -> None:
        found = np.frombuffer(b"".join([*self.held, bytes(ORDER - 1)]), np.uint8)
        self.held, self.size = [], 0
        for at in range(0, max(len(found) - ORDER + 1, 0), SLICE):
            part = found[at : at + SLICE + ORDER - 1].astype(np.int32)
            codes = ((part[:-3] * KINDS + part[1:-2]) * KINDS + part[2:-1]) * KINDS + part[3:]
            self.counts += np.bincount(codes, minlength=SIZE)


def within_words(counts: np.ndarray) -> np.ndarray:
    """Counts whose context ends at the beginning of the word: what lies before is all end-of-word."""
    grid = counts.reshape((KINDS,) * ORDER).copy()
    second = grid[:, 0, 1:, :].sum(axis=0)
    grid[:, 0, 1:, :] = 0
    grid[0, 0, 1:, :] = second
    first = grid[:, :, 0, :].sum(axis=(0, 1))
    grid[:, :, 0, :] = 0
    grid[0, 0, 0, :] = first
    grid[0, 0, 0, 0] = 0
    return grid.ravel()


def sequence_counts(text: Column, docs: DataFrame) -> np.ndarray:
    """Counts over all ``docs``; 28^4 sums, however many documents there are, reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counts()
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    found.add(value.as_py())
        found.flush()
        seen = np.flatnonzero(found.counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found.counts[seen])], names=["code", "n"])

    parts = docs.select(text.cast("binary").alias("text")).mapInArrow(counted, "code bigint, n bigint")
    sums = parts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE, np.int64)
    counts[sums["code"].to_numpy()] = sums["n"].to_numpy()
    return within_words(counts)


def log_chances(counts: np.ndarray, pull: float = 4.0) -> np.ndarray:
    """log P(letter | three before), each order pulled towards the next lower one by ``pull`` sequences."""
    grid = counts.reshape((KINDS,) * ORDER).astype(np.float64)
    chance = np.full(KINDS, 1 / KINDS)
    for order in range(1, ORDER + 1):
        seen = grid.sum(axis=tuple(range(ORDER - order)))
        total = seen.sum(axis=-1, keepdims=True)
        chance = (seen + pull * chance) / (total + pull)
    return np.log(chance).astype(np.float32).ravel()


RUNS = re.compile(r"(.)\1*", re.S)
# Signs at the edges that are punctuation, however often.
EDGES = re.compile(r"^[^\w$@!|+(€£¡¢§*]+|[^\w$@+€£¢§*]+$|^([$@!|+(*])\1+|([$@+*])\2+$")
# A piece that may be disguised: a sign beside a letter, one letter three times, or single characters set apart.
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£¡¢§*]|[0-9@$!|+(€£¡¢§*][^\W\d_]|([^\W\d_])\1\1|(?:^|[^\w])\w[.\-_/~'·*]+\w[.\-_/~'·*]+\w(?:[^\w]|$)")
SPACED = re.compile(r"(?<!\S)[^\W_](?: {1,3}[^\W_]){2,}(?!\S)")


def kind_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter < "\x80" else OTHER


def options(piece: str) -> list[list[tuple[str, float]]]:
    """What each run of equal characters of a lower-cased piece may stand for, with its logarithm."""
    out = []
    for run in RUNS.finditer(piece):
        sign, n = run.group(1), len(run.group())
        if sign in SIGNS:
            meant = [(letter, SIGN_MEANT) for letter in SIGNS[sign]]
            if n > 1:
                meant += [(letter * 2, SIGN_MEANT + OF_MANY) for letter in SIGNS[sign]]
            out.append([*meant, (run.group(), SIGN_KEPT)])
        elif kind_of(sign):
            if n == 1:
                out.append([(sign, 0.0)])
            elif n == 2:
                out.append([(sign * 2, TWO_OF_TWO), (sign, ONE_OF_TWO)])
            else:
                out.append([(sign, OF_MANY), (sign * 2, OF_MANY)])
        elif sign in SEPARATORS:
            out.append([("", DROPPED), (run.group(), PARTED)])
        else:
            out.append([(run.group(), 0.0)])
    return out


def decode(piece: str, chances: np.ndarray) -> str:
    """The most likely text behind a lower-cased piece; at equal scores the one that comes first by its characters."""
    best: dict[int, tuple[float, str | None, tuple | None]] = {0: (0.0, "", None)}
    for choices in options(piece):
        after: dict[int, tuple] = {}
        for state, path in best.items():
            for text, cost in choices:
                score, now = path[0] + cost, state
                for letter in text:
                    code = now * KINDS + kind_of(letter)
                    if now or code:
                        score += float(chances[code])
                    now = code % BEFORE if code % KINDS else 0
                if now not in after or score > after[now][0] or (score == after[now][0] and text < after[now][1]):
                    after[now] = (score, text, path)
        if len(after) > BEAM:
            after = dict(sorted(after.items(), key=lambda x: (-x[1][0], x[0]))[:BEAM])
        best = after
    ended = {s: p[0] + (float(chances[s * KINDS]) if s else 0.0) for s, p in best.items()}
    path = best[max(ended, key=lambda s: (ended[s], -s))]
    parts = []
    while path is not None:
        parts.append(path[1])
        path = path[2]
    return "".join(reversed(parts))


def restored(piece: str, chances: np.ndarray) -> str:
    """A lower-cased piece without white space as it was meant; the piece itself if nothing in it may be a disguise."""
    if piece.isalpha() and not SUSPECT.search(piece):
        return piece
    core = EDGES.sub("", piece)
    if not SUSPECT.search(core):
        return piece
    return decode(core, chances)


def restored_text(text: str, chances: np.ndarray, known: dict[str, str] | None = None) -> str:
    """A lower-cased text as it was meant, its white space kept but within words that were spaced out."""
    known = {} if known is None else known
    text = SPACED.sub(lambda m: decode(re.sub(" +", " ", m.group()), chances), text)

    def one(match: re.Match) -> str:
        piece = match.group()
        if piece not in known:
            known[piece] = restored(piece, chances)
        return known[piece]

    return re.sub(r"\S+", one, text)
