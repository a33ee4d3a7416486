"""Personal data: patterns, and a character-level tagger for what the patterns leave out.

The patterns find emails, IP addresses, card numbers and phone numbers. A bidirectional LSTM with CRF transitions is
trained on spans that the patterns label in a bounded sample of the documents, some of them varied (other separators,
no plus sign), and reads overlapping windows around every digit and ``@``: no personal data of these kinds is without
one. Where windows overlap their scores are averaged, and each stretch of touching windows is decoded as a whole, so
that a span is never cut by a window. Decoded spans count if they have the digits or signs of their kind, score
well above the outside, and touch no pattern span; those always stay.

Scale: texts are searched inside their own rows, in one pass without a shuffle; windows are scored in batches of
bounded size. Training reads at most ``sample`` distinct snippets (by hash of the snippet, each kind of span with its
share), 64 characters each, whatever the size of the corpus and its copies; each task passes on a bounded number of
them. The weights, some 20 kB, travel with the task.

Defined results: NULL text is empty and has no spans; repeated documents are searched each; where nothing is labelled
there is no tagger and only pattern spans remain; added columns take a trailing underscore if the name is taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .tagger import KINDS, Tagger, codes
from .words import spare

WINDOW, STRIDE = 64, 32
SAMPLE = 1000
EPOCHS = 14
MARGIN = 5.0

ANCHOR = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost emails: the local part is the whole run before its ``@``, back to the email before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the pattern spans, by kind, then start."""
    if not ANCHOR.search(text):
        return []
    found = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or ``@``."""
    at = np.array([m.start() for m in ANCHOR.finditer(text)], np.int64) // STRIDE
    return np.unique(np.concatenate([at, np.maximum(at - 1, 0)])) * STRIDE


def stretches(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Runs of overlapping windows as (start, end)."""
    if len(starts):
        breaks = np.flatnonzero(np.diff(starts) >= WINDOW)
        for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(starts) - 1)):
            yield int(starts[a]), min(int(starts[b]) + WINDOW, length)


def plausible(kind: int, text: str) -> bool:
    """What the characters of a span of each kind must have, patterns apart."""
    n = len(digits_of(text))
    if kind == 0:
        name, sign, domain = text.partition("@")
        return bool(name and sign and re.fullmatch(r"[^\s@]+\.[^\s@]{2,}", domain) and not re.search(r"\s", name))
    if kind == 1:
        parts = re.split(r"[.\x20:]+", text)
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= n <= 19 and luhn(digits_of(text)) and not re.search(r"[^0-9\x20./_-]", text)
    return 8 <= n <= 15 and bool(re.fullmatch(r"\(?[0-9][\x20()./0-9-]*[0-9]", text)) and len(re.findall("[^0-9]+", text)) >= 2


def added_spans(texts: list[str], bases: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Spans that the tagger adds to each text's pattern spans."""
    places, windows = [], []
    out: list[list[Span]] = [[] for _ in texts]

    def decide() -> None:
        letters = np.concatenate(windows)
        emit = np.concatenate([tagger.scores(letters[i : i + 2048]) for i in range(0, len(letters), 2048)])
        row = 0
        for i, starts in places:
            length = len(texts[i])
            for a, b in stretches(starts, length):
                total, times = np.zeros((b - a, emit.shape[2])), np.zeros((b - a, 1))
                for s in starts[(starts >= a) & (starts < b)].tolist():
                    end = min(s + WINDOW, b)
                    total[s - a : end - a] += emit[row, : end - s]
                    times[s - a : end - a] += 1
                    row += 1
                out[i] += accepted(texts[i], bases[i], a, total / times, tagger)

    size = 0
    for i, text in enumerate(texts):
        starts = window_starts(text)
        if len(starts):
            known = codes(text)
            padded = np.concatenate([known, np.zeros(WINDOW, np.int16)])
            windows.append(padded[starts[:, None] + np.arange(WINDOW)])
            places.append((i, starts))
            size += len(starts)
            if size > 8192:
                decide()
                places, windows, size = [], [], 0
    if places:
        decide()
    return out


def accepted(text: str, base: list[Span], at: int, emit: np.ndarray, tagger: Tagger) -> list[Span]:
    tags = tagger.decode(emit)
    opens = np.flatnonzero((tags % 2 == 1) & (tags > 0))
    out = []
    for start in opens.tolist():
        kind, end = (int(tags[start]) - 1) // 2, start + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        gain = np.take_along_axis(emit[start:end], tags[start:end, None].astype(int), 1)[:, 0] - emit[start:end, 0]
        span = kind, at + start, at + end
        apart = all(span[2] <= a or b <= span[1] for _, a, b in base)
        if gain.sum() >= MARGIN and apart and plausible(kind, text[span[1] : span[2]]):
            out.append(span)
    return out


def tagged(text: str, start: int, spans: list[Span]) -> np.ndarray:
    """Tags of the window of ``text`` at ``start``."""
    tags = np.zeros(WINDOW, np.int8)
    for kind, a, b in spans:
        a, b = max(a - start, 0), min(b - start, WINDOW)
        if a < b:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


def varied(text: str, spans: list[Span], r: np.random.Generator) -> tuple[str, list[Span]]:
    """The window with some spans written otherwise: a card with other separators, a phone without its plus sign."""
    out, moved, at = [], [], 0
    where = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        out.append(text[at:a])
        where += a - at
        new = text[a:b]
        if kind == 2 and r.random() < 0.6:
            sign = r.choice([" ", "-", ".", "/", "_"])
            digits = digits_of(new)
            new = sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        elif kind == 3 and r.random() < 0.4:
            new = new.lstrip("+")
        if kind in (2, 3):
            new = "".join(str(r.integers(10)) if c.isdecimal() and r.random() < 0.5 else c for c in new)
        moved.append((kind, where, where + len(new)))
        out.append(new)
        where += len(new)
        at = b
    out.append(text[at:])
    return "".join(out), moved


class Smallest:
    """The ``n`` smallest distinct rows, by unsigned hash with its sign bit turned, then the rest."""

    def __init__(self, n: int):
        self.n, self.held, self.bound = n, set(), None

    def add(self, row: tuple[int, str, str]) -> None:
        row = (row[0] ^ 1 << 63, *row[1:])
        if self.bound is None or row <= self.bound:
            self.held.add(row)
            if len(self.held) >= 2 * self.n + 100:
                self.cut()

    def cut(self) -> None:
        kept = sorted(self.held)[: self.n]
        self.held = set(kept)
        if len(kept) == self.n and kept:
            self.bound = kept[-1]

    def rows(self) -> list[tuple[int, str, str]]:
        self.cut()
        return [(h ^ 1 << 63, *rest) for h, *rest in sorted(self.held)]


def snippets(docs: DataFrame, text: str, sample: int) -> list[tuple[str, str]]:
    """At most ``sample`` distinct windows with their pattern spans, the smallest by hash.

    Half of them have spans: an equal number of each kind first, then any. A task passes on what it could give to these.
    """
    half, each = sample // 2, sample // 2 // len(KINDS)
    pools = {"some": half, "none": half, **{k: each for k in KINDS}}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = {p: Smallest(n) for p, n in pools.items()}
        for batch in batches:
            for value in batch.column(0):
                whole = value.as_py() or ""
                spans = base_spans(whole)
                for s in window_starts(whole).tolist():
                    inside = [(k, a - s, b - s) for k, a, b in spans if a < s + WINDOW and b > s]
                    if all(0 <= a and b <= WINDOW for _, a, b in inside):
                        snippet = whole[s : s + WINDOW]
                        row = xxhash.xxh64_intdigest(snippet.encode(), 42), snippet, joined(inside)
                        for p in ["some", *{KINDS[k] for k, _, _ in inside}] if inside else ["none"]:
                            smallest[p].add(row)
        rows = [(p, h - (1 << 64) * (h >> 63), *row) for p, held in smallest.items() for h, *row in held.rows()]
        columns = zip(*rows) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    schema = pa.schema([("pool", pa.string()), ("h", pa.int64()), ("snippet", pa.string()), ("spans", pa.string())])
    found = docs.select(text).mapInArrow(cut, "pool string, h bigint, snippet string, spans string").distinct()
    found = materialize(found, "snippets")

    def first(pool: str) -> list[tuple[str, str]]:
        ordered = found.where(F.col("pool") == pool).orderBy("h", "snippet", "spans")
        return [(r["snippet"], r["spans"]) for r in ordered.limit(pools[pool]).collect()]

    labelled = dict.fromkeys(row for k in KINDS for row in first(k))
    spread = [row for row in first("some") if row not in labelled]
    return [*labelled, *spread[: half - len(labelled)], *first("none")]


def trained(labelled: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 5) -> Tagger | None:
    """A tagger from snippets with spans as text, each also varied; None if no span is labelled."""
    r = np.random.default_rng(seed)
    letters, tags = [], []
    for text, spans in labelled:
        base = [(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
        for words, found in [(text, base), *([varied(text, base, r)] if base else [])]:
            padded = np.zeros(WINDOW, np.int16)
            known = codes(words)[:WINDOW]
            padded[: len(known)] = known
            letters.append(padded)
            tags.append(tagged(words, 0, found))
    if not any(t.any() for t in tags):
        return None
    tagger = Tagger()
    tagger.losses = tagger.train(np.array(letters), np.array(tags).astype(np.int64), epochs)
    return tagger


def find(docs: DataFrame, text: str = "text", sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans``.

    Counts are of pattern spans; ``spans`` lists all, as kind:start:end in code points, by kind, then start.
    """
    tagger = trained(snippets(docs, text, sample), epochs)
    names = spare(docs, *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
    (held,) = spare(docs, "_found")

    @F.pandas_udf("n0 bigint, n1 bigint, n2 bigint, n3 bigint, base string, spans string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, tagger) if tagger else [[] for _ in texts]
            rows = []
            for base, extra in zip(bases, more):
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in range(4)], digest, joined(base + extra)))
            yield pd.DataFrame(rows, columns=["n0", "n1", "n2", "n3", "base", "spans"])

    found = docs.withColumn(held, search(F.col(text)))
    parts = ["n0", "n1", "n2", "n3", "base", "spans"]
    return found.select(*docs.columns, *[F.col(held)[p].alias(n) for p, n in zip(parts, names)])
