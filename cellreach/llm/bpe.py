"""Bulk encoding of whole texts by a word-level byte BPE tokenizer file.

`BulkEncoder.encode` gives the ids that the tokenizers library gives without special tokens. Texts
of plain letters, digits and signs (code points below U+0300 and common dashes and quotes) are
cut into words and merged with numpy, many different words at a time; any other text goes through the
library itself. The words of a vocabulary file never change, so a bounded table of words already
merged is kept between calls.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from cellreach.llm.shingles import mix, powers

_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_PUNCT_LO, _PUNCT_HI = 0x2010, 0x2027
_PLAIN = re.compile("[\x00-įı-˿‐-‧]*\\Z")
_LETTER, _DIGIT, _SIGN, _SPACE = 0, 1, 2, 3
#: Places of the table of words already merged (a word takes one by its hash), and ids kept in all.
SLOT_BITS = 20
SLOTS, KEPT_IDS = 1 << SLOT_BITS, 8_000_000


def _class_of(code: int) -> int:
    c = chr(code)
    if c in "\t\n\x0b\x0c\r \x85\xa0":
        return _SPACE
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _SIGN)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character class by code point, up to the last plain one."""
    out = np.full(_PUNCT_HI + 1, _SIGN, np.uint8)
    out[:0x300] = [_class_of(c) for c in range(0x300)]
    return out


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable Latin-1, else the next free code point from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class BulkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self._forget()

    def _forget(self) -> None:
        self.slot_hash = np.zeros(SLOTS, np.uint64)
        self.slot_at, self.slot_count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.flat, self.filled = np.zeros(1 << 20, np.int32), 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols; very large where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], 1 << 40)

    def merge_words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[start:end], one after another, and how many each has."""
        size = end - start
        word = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        chars = raw[np.arange(len(word)) - np.repeat(first - start, size)]
        sym = self.inner[chars]
        sym[first + size - 1] = self.final[chars[first + size - 1]]
        done_word, done_sym = [], []
        place = np.arange(len(sym))
        done_place = []
        rank = np.full(len(sym), 1 << 40)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        while len(sym):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(rank, begin)
            over = np.repeat(best >= 1 << 40, length)
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                done_place.append(place[over])
                word, sym, rank, place = word[~over], sym[~over], rank[~over], place[~over]
                if not len(sym):
                    break
                length, best = length[best < 1 << 40], best[best < 1 << 40]
                begin = np.cumsum(length) - length
            hit = np.flatnonzero(rank == np.repeat(best, length))
            hit = hit[np.concatenate(([True], word[hit][1:] != word[hit][:-1]))]  # the leftmost of each word
            sym[hit] = self.made[best]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            word, sym, rank, place = word[keep], sym[keep], rank[keep], place[keep]
            now = hit - np.arange(len(hit))  # one symbol fewer for each word before
            touched = np.unique(np.concatenate((now, now[now > 0] - 1)))
            last = touched[touched == len(word) - 1]
            rank[last] = 1 << 40
            touched = touched[touched < len(word) - 1]
            same = word[touched] == word[touched + 1]
            rank[touched] = np.where(same, self._rank(sym[touched], sym[touched + 1]), 1 << 40)
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(size), np.int64)
        words, syms, places = np.concatenate(done_word), np.concatenate(done_sym), np.concatenate(done_place)
        order = np.argsort(places)
        return syms[order].astype(np.int32), np.bincount(words, minlength=len(size))

    def _words(self, data: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, each word's range, its hash, and each text's first word (one more at the end)."""
        joined = "\n".join(data) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _classes()[code]
        starts = kind != _SPACE
        starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for p in np.flatnonzero(starts & (code == 0x27)) if "'" in joined else ():
            for tail in _CONTRACTIONS:
                if joined.startswith(tail, p + 1):
                    starts[p + 1] = False
                    q = p + 1 + len(tail)
                    starts[q] = kind[q] != _SPACE
                    break
        start = np.flatnonzero(starts)
        # A word ends where the next one starts or at white space.
        stops = starts
        stops[1:] |= (kind[1:] == _SPACE) & (kind[:-1] != _SPACE)
        stops = np.append(np.flatnonzero(stops), len(code))
        end = stops[np.searchsorted(stops, start) + 1] if len(start) else start
        up, down = powers(len(code))
        total = np.cumsum(code * up)
        left = total[start - 1]
        if len(start) and start[0] == 0:
            left[0] = 0
        hashes = mix((total[end - 1] - left) * down[start] + (end - start).astype(np.uint64))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in data])))
        return code, start, end, hashes, np.searchsorted(start, bounds)

    def _learn(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge new words; where their ids begin in self.flat, and how many there are."""
        size = end - start
        first = np.cumsum(size) - size
        own = code[np.arange(int(size.sum())) - np.repeat(first - start, size)]
        width = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800)
        raw = np.frombuffer(own.tobytes().decode("utf-32-le").encode(), np.uint8)
        stop = np.cumsum(np.add.reduceat(width, first))
        flat, count = self.merge_words(raw, np.concatenate(([0], stop[:-1])), stop)
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(flat)), np.int32)))
        self.flat[self.filled : self.filled + len(flat)] = flat
        at = np.cumsum(count) - count + self.filled
        self.filled += len(flat)
        return at, count

    def _plain(self, data: list[str]) -> list[np.ndarray]:
        if self.filled > KEPT_IDS:
            self._forget()
        code, start, end, hashes, first = self._words(data)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, count = self.slot_at[slot], self.slot_count[slot].astype(np.int64)
        missed = np.flatnonzero(self.slot_hash[slot] != hashes)
        if len(missed):
            unique, where, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            chosen = missed[where]
            new_at, new_count = self._learn(code, start[chosen], end[chosen])
            at[missed], count[missed] = new_at[inverse], new_count[inverse]
            into = slot[chosen]
            self.slot_hash[into], self.slot_at[into], self.slot_count[into] = unique, new_at, new_count
        stop = np.cumsum(count)
        ids = self.flat[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - count - at, count)]
        cuts = np.concatenate(([0], stop))[first]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (int32); null is an empty text."""
        texts = [t or "" for t in texts]
        plain = [i for i, t in enumerate(texts) if _PLAIN.match(t) and not any(a in t for a in self.added)]
        out: list = [None] * len(texts)
        size, some = 0, []
        for i in plain:
            some.append(i)
            size += len(texts[i])
            if size > 1 << 19 or i == plain[-1]:
                for k, ids in zip(some, self._plain([texts[j].lower() for j in some]), strict=True):
                    out[k] = ids
                size, some = 0, []
        odd = [i for i, x in enumerate(out) if x is None]
        for i in odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out
