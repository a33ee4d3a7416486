"""Plain versions of what the operators compute."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    found = words((text or "").translate(LOWER))
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def groups(rows, size, percent):
    """For each row (id, text): its root row and its number of links."""
    sets = [shingles(t, size) for _, t in rows]
    root, links, holders = list(range(len(rows))), [0] * len(rows), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            holders[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sets, [find(i) for i in range(len(rows))], links


def near_copies(rows, size, percent):
    sets, roots, links = groups(rows, size, percent)
    smallest = {}
    for (key, _), r in zip(rows, roots):
        if key is not None:
            smallest[r] = min(key, smallest.get(r, key))
    return [(k, len(s), smallest.get(r), n) for (k, _), s, r, n in zip(rows, sets, roots, links)]


def cut_repeats(rows, length):
    """(id, bytes, removed, spans, digest of what stays) of each row."""
    starts = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for j in range(len(d) - length + 1):
            starts[d[j : j + length]] = starts.get(d[j : j + length], 0) + 1
    out = []
    for (key, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for j in range(len(d) - length + 1):
            if starts[d[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((key, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cut_lines(rows, min_lines):
    """(id, lines, removed, runs, kept text) of each distinct row, in order of id."""
    seen, out = set(), []
    for key, text in rows:
        lines = (text or "").split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines) - min_lines + 1):
            window = tuple(lines[i : i + min_lines])
            if window in seen:
                gone[i : i + min_lines] = [True] * min_lines
            seen.add(window)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(lines), sum(gone), runs, "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def longest_runs(rows):
    """(id, lines of the longest run that starts in the row and stands elsewhere too) of each row."""
    docs = [(key, (text or "").split("\n")) for key, text in rows]
    longest, length = [0] * len(docs), 0
    while length == max(longest):
        length += 1
        places = {}
        for i, (_, lines) in enumerate(docs):
            for at in range(len(lines) - length + 1):
                places.setdefault(tuple(lines[at : at + length]), []).append(i)
        for holders in places.values():
            if len(holders) > 1:
                for i in holders:
                    longest[i] = length
    return [(key, n) for (key, _), n in zip(docs, longest)]


def repeated_words(text):
    found = words(text)
    places = {}
    for i in range(len(found) - 2):
        places.setdefault(tuple(found[i : i + 3]), []).append(i)
    return len({j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})


def quality(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated_words(text)
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])
