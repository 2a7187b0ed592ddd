"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(ws, width=5):
    if len(ws) >= width:
        return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)}
    return {tuple(ws)} if ws else set()


def similar(a, b, percent=80):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def quality(docs, max_docs=50, min_left=30, min_words=50, max_repeat=50):
    """{id: (signals..., base_failed, kept, lost lines as a set)} of unique ids (id, text, host)."""
    norm = lambda line: line.translate(FOLD).translate({ord(c): None for c in SPACES})
    lines = {i: {norm(x) for x in (t or "").split("\n")} - {""} for i, t, _ in docs}
    at = defaultdict(set)
    for i, _, host in docs:
        for line in lines[i]:
            at[host, line].add(i)
    out = {}
    for i, text, host in docs:
        ws = words(text)
        grams = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        rep = {k + j for k in range(len(ws) - 2) if grams[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        with_word = [x for x in (text or "").split("\n") if words(x)]
        failed = len(ws) < min_words or 100 * len(rep) > max_repeat * len(ws)
        lost = {x for x in lines[i] if len(at[host, x]) > max_docs and min(at[host, x]) != i}
        chars, gone = sum(map(len, lines[i])), sum(map(len, lost))
        kept = not failed and not 100 * (chars - gone) < min_left * chars
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        out[i] = (len(ws), sum(map(len, ws)), symbols, len(with_word) - len(set(with_word)), len(rep), failed, kept, lost)
    return out, norm


def repeated_lines(docs):
    """{(id, line number)} to remove, of unique ids (id, text)."""
    seen, gone = [], set()
    for i, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            ws = words(line.translate(FOLD))
            if ws:  # fewer than five words are one shingle
                s = shingles(ws)
                if any(similar(s, x) for x in seen):
                    gone.add((i, k))
                seen.append(s)
    return gone


def groups(docs):
    """{id: (set size, component)} of unique ids (id, text)."""
    sets = {i: shingles(words((t or "").translate(FOLD))) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if similar(sets[a], sets[b]):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def hits(docs, items, width=10):
    """{id: (words, hit words, sorted items)}."""
    windows = defaultdict(set)
    for item, text in items:
        ws = alnum_words(text)
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            windows[tuple(ws[k : k + width])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        ws, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if (got := windows.get(tuple(ws[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out[i] = (len(ws), len(hit), sorted(found - {None}))
    return out


def repeats(docs, length=100):
    """{id: (bytes, removed, spans, kept bytes)} of unique ids (id, text)."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(data)))
        out[i] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out
