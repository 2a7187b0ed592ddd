"""Near-duplicate passages by compact windows over token min-hashes.

The tokens of a text are its 5-word shingles in order. For each of HASHES hash functions a Cartesian tree over the tokens' values
gives the compact windows (l, c, r) of at least `span` tokens: every passage inside l..r that covers c has token c as its min-hash. A
value is led by a rank of how often the token's bucket occurs in all documents, the lowest up to COMMON times above the average, so that common
lines do not decide min-hashes where anything rarer is near. Windows are grouped by function and min-hash, and joined where
they lie on each other over `span` tokens or more about it, and where enough further hashes agree: a sketch of SLOTS min-hashes, of four bits each,
of the span / 2 tokens on either side of c, of which ENOUGH of one side must be equal (a passage of `span` tokens has all of one side).

1. Each window of a group with a representative of like sketch, representatives of like sketch with each other, and windows of equal content with
   the first of these. Representatives are chosen in turn, REPRESENTATIVES at most: of the windows that none is like yet, the one nearest
   to the sketch that most of them have, so that families of like passages have one each.
2. The passages that are verified are united: those of a pair, and those of one document that overlap by MERGE tokens or more. Then windows of
   a group whose places are not in passages so connected, each pair of contents once. So all pairs of contents are tried but
   those that are connected already. Left out are verified pairs whose sides overlap connected passages by MERGE tokens or more, and, before they
   are verified, ranges whose common tokens leave no room for another pair.

3. Exact repeats of `span` tokens that no passage so far holds are joined (`exact_passages`), so that each is in a passage in either document.

Joined windows are gathered by pair of documents and diagonal. Verified are all parts of the joined ranges that are dense in common
tokens, the longest first: their exact Jaccard similarity must reach the threshold. Equal texts are found beforehand; each is a
passage of the first of them and takes no other part.

Scale: three passes over the texts; the shuffle of windows is some HASHES * 2 / span rows a token. A window that crowds a batch of documents
is dealt out and compared with the batch's first one only, which takes part in the group for it. Only documents of candidate pairs are
fetched again, by a checked broadcast of their ids or by a shuffle. Pairs across components grow with the square of the components that share a
min-hash. The driver sees the fixed-size bucket counts alone.

Defined results: null, empty and short texts (fewer than span + 4 words) have no passages; null ids are ignored. Rows equal in id and text are one
document; rows of one id and different texts are different documents. Passages that repeat within one document are not reported; an empty
table gives an empty result; other columns are ignored. Exact repeats are always found: each 50 words that two documents share lie in a row's passage in
either, if not in one row of both. For the rest the search is by min-hash: a passage of similarity s is found if one of HASHES functions agrees, which at 0.8 holds for 99.8 %, and its sketch does. Limit: of passages whose common tokens occur
more than COMMON times above the average, the rarer tokens of an edit decide the min-hashes, and near copies without an equal window can be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.llm.common import RowKey, equal_texts, released, small_side, space_words, written
from cellreach.llm.components import connected_components
from cellreach.llm.exact_passages import exact_passages
from cellreach.llm.shingles import BUCKETS, COUNT_DDL, add_up, buckets, count_columns, mix, rolled_hashes, text_chunks, texts_of, word_hashes

WIDTH, SPAN, PERCENT = 5, 46, 80
HASHES, SLOTS, ENOUGH = 4, 8, 4
#: Tokens by which the places of two joined windows may shift against each other within one candidate.
DIAGONAL = 64
#: A window content that occurs more often in one batch of documents is dealt, but for the first time, to one of so many parts.
CROWD, SALTS = 64, 1023
#: Tokens of buckets up to so much above the average all have the lowest rank: else the tokens that an edit made, which are
#: rarer than those that the copies share, would decide the min-hashes of all near copies.
COMMON = 1000
#: Pairs of documents that a task holds at once while it verifies them.
PAIRS_PER_BATCH = 200
#: Tokens that passages of one document share if they are one passage.
MERGE = 34

_PAIR = ["doc", "th", "o_doc", "o_th"]


def token_run(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts one after another: the hash of the shingle that starts there (0 if it would leave its text),
    whether there is one, and each text's first word (one more at the end)."""
    words, first = word_hashes(data)
    tokens = np.zeros(len(words), np.uint64)
    rolled = rolled_hashes(words, width)
    tokens[: len(rolled)] = rolled
    inside = np.arange(len(words)) + width <= np.repeat(first[1:], np.diff(first))
    tokens[~inside] = 0
    return tokens, inside, first


def token_rows(data: list[bytes], width: int) -> list[np.ndarray]:
    """The shingle hashes of each text in order, repeats and all."""
    tokens, _, first = token_run(data, width)
    return [tokens[a : max(a, b - width + 1)] for a, b in zip(first[:-1], first[1:], strict=True)]


def compact_windows(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (inclusive) of the Cartesian tree's nodes that hold at least span tokens; equal values: the leftmost is least.

    Only a token that is the least of some span tokens has such a node, and whatever bounds it is one, too, so the
    tree is built over those few alone.
    """
    n = len(values)
    if n < span:
        return (np.empty(0, np.int64),) * 3
    order = values
    step = 1
    while step * 2 <= span:
        order = np.minimum(order[:-step], order[step:])
        step *= 2
    least = np.minimum(order[: n - span + 1], order[span - step :][: n - span + 1])
    edge = np.zeros(span - 1, np.uint64)
    most = np.concatenate((edge, least, edge))
    step, want = 1, span
    while step * 2 <= want:
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    most = np.maximum(most[:n], most[want - step :][:n])
    at = np.flatnonzero(most == values)
    picked = values[at].tolist()
    left, right, stack = [0] * len(at), [n - 1] * len(at), []
    for k, (p, v) in enumerate(zip(at.tolist(), picked, strict=True)):
        while stack and picked[stack[-1]] > v:
            right[stack.pop()] = p - 1
        left[k] = int(at[stack[-1]]) + 1 if stack else 0
        stack.append(k)
    lo, hi = np.array(left, np.int64), np.array(right, np.int64)
    wide = hi - lo + 1 >= span
    return lo[wide], at[wide], hi[wide]


def _token_counts(texts: DataFrame, width: int) -> np.ndarray:
    """Occurrences of tokens by bucket, over all texts."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data in text_chunks(range(batch.num_rows), texts_of(batch.column(0))):
                tokens, inside, _ = token_run(data, width)
                counts += np.bincount(buckets(tokens[inside]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(list(count_columns(counts)), names=["part", "counts"])

    return add_up(texts.select("text").mapInArrow(run, COUNT_DDL))


_PLACE = [("doc", pa.int64()), ("th", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())]
_WINDOW = (
    "key long, salt int, doc long, th long, c int, l int, r int, cls long, sketch long,"
    " o struct<doc: bigint, th: bigint, c: int, l: int, r: int>, borne boolean"
)


def sketches(tokens: np.ndarray, inside: np.ndarray, first: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place the sketch (SLOTS times four bits) of the `reach` tokens before it and of those after it, within its text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    spaced = np.arange(len(tokens)) + (text + 1) * reach  # so far apart that no reach has tokens of two texts
    before, after = np.zeros(len(tokens), np.uint32), np.zeros(len(tokens), np.uint32)
    for factor in mix(np.arange(101, 101 + SLOTS, dtype=np.uint64)) | np.uint64(1):
        values = np.full(len(tokens) + (len(first) + 1) * reach, 2**32 - 1, np.uint32)
        values[spaced] = np.where(inside, (tokens * factor) >> np.uint64(32), 2**32 - 1)
        step = 1
        while step * 2 <= reach:
            values = np.minimum(values[:-step], values[step:])
            step *= 2
        values = np.minimum(values[: len(values) - (reach - step)], values[reach - step :])
        before = (before << np.uint32(4)) | (values[spaced - reach] & np.uint32(15))
        after = (after << np.uint32(4)) | (values[spaced + 1] & np.uint32(15))
    return before, after


_LOW = int("1" * SLOTS, 16)


def _agree(x: str, y: str) -> str:
    """Whether ENOUGH slots of one side are equal in two sketches, as SQL."""
    other = f"({x}.sketch ^ {y}.sketch)"
    unequal = f"({other} | shiftrightunsigned({other}, 1) | shiftrightunsigned({other}, 2) | shiftrightunsigned({other}, 3))"
    sides = (f"bit_count({unequal} & {mask}L) <= {SLOTS - ENOUGH}" for mask in (_LOW, _LOW << 32))
    return f"({' or '.join(sides)})"


def _agree_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of two arrays of sketches."""
    other = x ^ y
    unequal = other | (other >> np.uint64(1)) | (other >> np.uint64(2)) | (other >> np.uint64(3))
    sides = [np.bitwise_count(unequal & np.uint64(mask)) <= SLOTS - ENOUGH for mask in (_LOW, _LOW << 32)]
    return sides[0] | sides[1]


def chunk_windows(data: list[bytes], ranks: np.ndarray, width: int, span: int, hashes: int) -> list[np.ndarray]:
    """Of all windows of the texts: number of the text, c, l, r in its words, key, content, sketch."""
    tokens, inside, first = token_run(data, width)
    before, after = sketches(tokens, inside, first, span // 2)
    sketch = (before.astype(np.uint64) << np.uint64(32)) | after
    led = ranks[buckets(tokens)]
    places = mix(np.arange(1, len(tokens) + 2, dtype=np.uint64)) | np.uint64(1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens))))
    out = []
    for f in range(hashes):
        values = led | (mix(tokens ^ mix(np.array([f + 1], np.uint64))) >> np.uint64(7)) | np.uint64(1)
        values[~inside] = 0  # less than all others, so no window goes beyond its text
        lo, at, hi = compact_windows(values, span)
        real = values[at] > 0
        lo, at, hi = lo[real], at[real], hi[real]
        # Content: the sum of the tokens, their number, the place of c, and the tokens beside it and at the ends.
        content = total[hi + 1] - total[lo]
        content = mix(content + places[hi - lo]) ^ mix(tokens[lo] + places[at - lo]) ^ mix(tokens[hi] ^ tokens[at])
        text = np.searchsorted(first, at, "right") - 1
        begin = first[text]
        out.append((text, at - begin, lo - begin, hi - begin, mix(values[at] + np.uint64(f)), content, sketch[at]))
    return [np.concatenate([x[k] for x in out]) for k in range(7)]


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """By bucket of tokens the upper bits of their values: how often they occur, the lowest up to COMMON times above the average."""
    ranks = np.clip(np.round(8 * np.log2(np.maximum(counts, 1) / (counts.mean() + COMMON))), 0, 127).astype(np.uint64)
    return ranks << np.uint64(57)


def _windows(texts: DataFrame, held, width: int, span: int, hashes: int) -> DataFrame:
    """_WINDOW rows; a window whose content crowds its batch is salted and carries the batch's first one (o), which is borne. held: ranks_of, broadcast."""

    def run(batches):
        for batch in batches:
            ids, ths = (batch.column(k).to_numpy() for k in (0, 1))
            found = []
            for rows, data in text_chunks(range(len(ids)), texts_of(batch.column(2))):
                part = chunk_windows(data, held.value, width, span, hashes)
                part[0] = np.array(rows, np.int64)[part[0]]
                found.append(part)
            if not found:
                continue
            row, at, lo, hi, key, content, sketch = (np.concatenate([p[k] for p in found]) for k in range(7))
            del found
            _, first, inverse, times = np.unique(mix(key) + content, return_index=True, return_inverse=True, return_counts=True)
            origin = first[inverse]
            again = (times[inverse] > CROWD) & (origin != np.arange(len(row)))
            own = ~again | (row[origin] != row)  # a repeat within the same document adds nothing
            borne = np.zeros(len(row), bool)
            borne[origin[again & own]] = True
            places = ids[row], ths[row], at.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)
            keep = np.flatnonzero(own)
            spread = (mix(np.arange(len(keep), dtype=np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1
            again, source = again[keep], origin[keep]
            other = pa.StructArray.from_arrays(
                [pa.array(x[source], k) for x, (_, k) in zip(places, _PLACE, strict=True)], [n for n, _ in _PLACE], mask=pa.array(~again)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[keep].view(np.int64)),
                    pa.array(np.where(again, spread, 0).astype(np.int32)),
                    *[pa.array(x[keep]) for x in places],
                    pa.array(content[keep].view(np.int64)),
                    pa.array(sketch[keep].view(np.int64)),
                    other,
                    pa.array(borne[keep]),
                ],
                names=["key", "salt", "doc", "th", "c", "l", "r", "cls", "sketch", "o", "borne"],
            )

    return texts.mapInArrow(run, _WINDOW)


#: Members of groups (o_doc null), and the ranges of joined pairs, the later document first.
_LIVE = (
    "key long, cls long, sketch long, doc long, th long, c int, l int, r int,"
    " o_doc long, o_th long, o_l int, o_r int, diagonal int"
)
REPRESENTATIVES = 12
#: Of groups up to this size, members that resemble no other content of the group are left out of the second join at once.
SMALL_GROUP = 32


def _grouped(windows: DataFrame, span: int) -> DataFrame:
    """_LIVE rows of _WINDOW rows: pairs of the first join, and the first and last window of each content for the second."""
    names = ["doc", "th", "c", "l", "r", "cls", "sketch"]

    def alike(w: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least = np.minimum(w["c"][i] - w["l"][i], w["c"][j] - w["l"][j]) + np.minimum(w["r"][i] - w["c"][i], w["r"][j] - w["c"][j])
        return (least + 1 >= span) & ((w["cls"][i] == w["cls"][j]) | _agree_of(w["sketch"][i], w["sketch"][j]))

    def apart(w: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (w["doc"][i] != w["doc"][j]) | (w["th"][i] != w["th"][j])

    def representatives(w: dict, group: np.ndarray, size: np.ndarray, n_old: int):
        """Of every window its representative (-1: none yet), and the pairs of like representatives."""
        chosen = np.full(len(group), -1, np.int64)
        chosen[:n_old] = np.arange(n_old)  # the carried ones are representatives of the first group
        todo = np.flatnonzero(size[group] > 1)
        todo = todo[todo >= n_old]
        so_far: list[np.ndarray] = []
        leaders = []
        for old in range(n_old):
            mine = todo[group[todo] == 0]
            like = mine[alike(w, mine, np.full(len(mine), old))]
            chosen[like] = old
            todo = todo[chosen[todo] < 0]
            so_far.append(np.where(np.arange(len(size)) == 0, old, -1))
        for _ in range(REPRESENTATIVES):
            if not len(todo):
                break
            new = np.concatenate(([True], group[todo][1:] != group[todo][:-1]))
            own, start = np.cumsum(new) - 1, np.flatnonzero(new)
            score = np.zeros(len(todo), np.int64)
            for slot in range(2 * SLOTS):
                value = ((w["sketch"][todo] >> np.uint64(4 * slot)) & np.uint64(15)).astype(np.int64)
                times = np.bincount(own * 16 + value, minlength=16 * len(start)).reshape(-1, 16)
                score += value == times.argmax(1)[own]
            best = np.maximum.reduceat(score * (len(todo) + 1) + len(todo) - np.arange(len(todo)), start)
            leader = todo[len(todo) - best % (len(todo) + 1)]
            mine = leader[own]
            like = (todo == mine) | alike(w, todo, mine)
            chosen[todo[like]] = mine[like]
            led = np.full(len(size), -1, np.int64)
            led[group[leader]] = leader
            for earlier in so_far:
                i = earlier[group[leader]]
                fit = (i >= 0) & ((leader >= n_old) | (i >= n_old))
                i, j = leader[fit], i[fit]
                both = apart(w, i, j) & alike(w, i, j)
                leaders.append((i[both], j[both]))
            so_far.append(led)
            todo = todo[~like]
        return chosen, leaders

    def grouped(w: dict, n_old: int, open_end: bool):
        """Of windows sorted by key and document, the first n_old of them carried over: pairs, members, and what to carry over."""
        n = len(w["key"])
        every = np.arange(n)
        new = np.concatenate(([True], w["key"][1:] != w["key"][:-1]))
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.append(start, n))
        order = np.lexsort((every, w["cls"], group))
        run = np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (w["cls"][order][1:] != w["cls"][order][:-1])))
        begins = np.flatnonzero(run)
        ends = np.append(begins[1:], n) - 1
        own = np.empty(n, np.int64)  # the first window of equal content
        own[order] = np.repeat(order[begins], np.diff(np.append(begins, n)))
        fresh = every >= n_old
        chosen, leaders = representatives(w, group, size, n_old)
        pairs = []
        for other in (chosen, own):
            i = np.flatnonzero(fresh & (other >= 0) & (other != every) & ((other is chosen) | (own != chosen)))
            i = i[apart(w, i, other[i]) & alike(w, i, other[i])]
            pairs.append((i, other[i]))
        pairs += leaders
        contents = np.bincount(group[order[begins]], minlength=len(start))
        last = start + size - 1
        several = apart(w, start, last) | (np.maximum.reduceat(w["borne"].astype(np.int8), start) > 0)
        spans = np.zeros(len(start), bool)  # groups that other batches have parts of
        spans[0] = n_old > 0
        spans[-1] |= open_end
        mixed = ((contents > 1) & several) | spans
        member = np.zeros(n, bool)
        member[order[begins]] = member[order[ends]] = True
        member &= mixed[group] & fresh
        small = (size <= SMALL_GROUP) & ~spans
        like = ~small[group]
        some = np.flatnonzero(member & ~like)
        if len(some):
            for step in range(1, min(SMALL_GROUP, len(some))):
                i, j = some[:-step], some[step:]
                same = group[i] == group[j]
                if not same.any():
                    break
                i, j = i[same], j[same]
                hit = (w["cls"][i] != w["cls"][j]) & alike(w, i, j)
                like[i[hit]] = like[j[hit]] = True
        # The last group may go on: a few of its representatives are carried over, so that what a batch costs does not grow with the group.
        keep = np.unique(chosen[(group == len(start) - 1) & (chosen >= 0)])[:REPRESENTATIVES] if open_end else np.empty(0, np.int64)
        if open_end and not len(keep):
            keep = start[-1:]
        return pairs, np.flatnonzero(member & like), {k: v[keep] for k, v in w.items()}

    def ranges(x: dict, y: dict) -> list:
        """The columns of _LIVE of joined windows x and y."""
        back = (x["doc"] < y["doc"]) | ((x["doc"] == y["doc"]) & (x["th"] < y["th"]))
        p, q = ({k: np.where(back, two[k], one[k]) for k in names[:5]} for one, two in ((x, y), (y, x)))
        before, after = np.minimum(p["c"] - p["l"], q["c"] - q["l"]), np.minimum(p["r"] - p["c"], q["r"] - q["c"])
        none = [pa.nulls(len(back), pa.int64())] * 3
        sides = [[pa.array(z["doc"]), pa.array(z["th"]), *lead, pa.array(z["c"] - before), pa.array(z["c"] + after)] for z, lead in ((p, [pa.array(p["c"])]), (q, []))]
        return [*none, *sides[0], *sides[1], pa.array((p["c"] - q["c"]) // np.int32(DIAGONAL))]

    def members_of(w: dict, i: np.ndarray) -> list:
        """The columns of _LIVE of single windows."""
        own = [pa.array(w["key"][i]), pa.array(w["cls"][i]), pa.array(w["sketch"][i].view(np.int64)), *[pa.array(w[k][i]) for k in names[:5]]]
        return [*own, *[pa.nulls(len(i), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]]

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _LIVE.split(", ")])

    def run(batches):
        held = None
        for batch in batches:
            w = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "salt", "borne", *names)}
            w["sketch"] = w["sketch"].view(np.uint64)
            known = np.flatnonzero(w["salt"] > 0)
            if len(known):
                o = batch.column("o").take(pa.array(known))
                other = {k: pa.compute.struct_field(o, k).to_numpy() for k in names[:5]}
                yield batch_of(ranges({k: w[k][known] for k in names[:5]}, other))
            plain = w["salt"] == 0
            w = {k: v[plain] for k, v in w.items()}
            if not len(w["key"]):
                continue
            n_old = 0
            if held is not None and held["key"][0] == w["key"][0]:
                n_old = len(held["key"])
                w = {k: np.concatenate((held[k], w[k])) for k in w}
            pairs, members, held = grouped(w, n_old, True)
            i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            yield batch_of(ranges({k: w[k][i] for k in names[:5]}, {k: w[k][j] for k in names[:5]}))
            yield batch_of(members_of(w, members))

    return windows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "th", "c").mapInArrow(run, _LIVE)


_PASSAGE = "doc long, th long, s int, e int, o_doc long, o_th long, o_s int, o_e int, percent int"


def longest_dense(flags: np.ndarray, share: float) -> tuple[int, int]:
    """The longest range [a, b) whose mean is at least share; (0, 0) if there is none."""
    height = np.concatenate(([0.0], np.cumsum(flags - share)))
    low = np.minimum.accumulate(height)
    best = (0, 0)
    # The last place not lower than a start: suffix maxima fall, so each start's end is found by binary search.
    high = np.maximum.accumulate(height[::-1])[::-1]
    ends = len(height) - np.searchsorted(high[::-1], low - 1e-9, "left")
    starts = np.searchsorted(-low, -low, "left")
    k = int(np.argmax(ends - 1 - starts))
    if ends[k] - 1 > starts[k]:
        best = int(starts[k]), int(ends[k] - 1)
    return best


def _matched(a: np.ndarray, b: np.ndarray, s: int, e: int, shift: int, share: float, span: int, percent: int) -> tuple | None:
    """(s, e, p, q, similarity) of the part of a[s:e] that is similar enough to a part b[p:q] near its diagonal, if there is one."""
    while e - s >= span:
        slack = DIAGONAL + (e - s) // 4  # a dense range cannot drift further
        at = max(0, s - shift - DIAGONAL - slack)
        near = b[at : max(at, e - shift + slack)]
        p, q = longest_dense(np.isin(near, a[s:e]), share)
        if q - p < span:
            return None
        x, y = np.unique(a[s:e]), np.unique(near[p:q])
        both = len(np.intersect1d(x, y, True))
        union = len(x) + len(y) - both
        if 100 * both >= percent * union:
            return s, e, at + p, at + q, 100 * both // union
        u, v = longest_dense(np.isin(a[s:e], near[p:q]), share)
        if v - u == e - s:
            return None
        s, e = s + u, s + v
    return None


def similar_parts(a: np.ndarray, b: np.ndarray, shift: int, span: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(s, e, p, q, similarity) of all parts a[s:e] similar to a part b[p:q], the longest first, each with a common token of its own.

    Token i of a is at some i - shift - DIAGONAL + 1 to i - shift of b. What is left beside a part is searched again, with
    span - 1 tokens of the part itself, so that no range of span tokens is cut.
    """
    loosest = 2 * percent / (100 + percent)  # equally long sets of that similarity share so much of each
    common = np.isin(a, b)
    if common.sum() < loosest * span - 1e-6:
        return []
    fresh = common.copy()
    out, todo = [], [(0, len(a))]
    while todo:
        i, j = todo.pop()
        if j - i < span or not fresh[i:j].any():
            continue
        part, dense = None, None
        for share in (loosest, (1 + 2 * loosest) / 3, (2 + loosest) / 3, 1.0):  # the longest part first
            s, e = longest_dense(common[i:j], share)
            if e - s < span:
                break
            dense = dense or (i + s, i + e)
            part = _matched(a, b, i + s, i + e, shift, share, span, percent)
            if part:
                break
        if part:
            if fresh[part[0] : part[1]].any():
                out.append(part)
            fresh[part[0] : part[1]] = False
            dense = part[:2]
        elif dense and dense[1] - dense[0] >= 2 * span:
            middle = sum(dense) // 2
            todo += [(i, middle + span - 1), (middle, j)]
            continue
        if dense:
            todo += [(i, dense[0] + span - 1), (dense[1] - span + 1, j)]
    return out


#: Tokens of joined ranges that a task looks at together.
TOKENS_AT_ONCE = 1 << 18


def _least_common(span: int, percent: int) -> float:
    """So many tokens of either range are in the other one if any parts of span tokens or more are similar."""
    return 2 * percent / (100 + percent) * span - 1e-6


def shared_tokens(a: tuple, b: tuple) -> np.ndarray:
    """Of joined ranges (token values, where each range starts in them, where it ends) the number of a's tokens that are in b, or a little more.

    Tokens are marked by hashes of token and range, so equal tokens are never missed.
    """
    n = len(a[1])
    names = mix(np.arange(1, n + 1, dtype=np.uint64))
    shift = np.uint64(64 - max(16, int(16 * (b[2] - b[1]).sum()).bit_length()))

    def marks(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        which = np.repeat(np.arange(n), size)
        at = np.arange(len(which)) + np.repeat(start - np.cumsum(size) + size, size)
        return which, ((values[at].view(np.uint64) ^ names[which]) >> shift).astype(np.int64)

    seen = np.zeros(1 << (64 - int(shift)), bool)
    seen[marks(*b)[1]] = True
    which, mark = marks(*a)
    return np.bincount(which[seen[mark]], minlength=n)


def _by_label(passages: list[dict] | None) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for x in passages or ():
        out.setdefault(x["label"], []).append((x["s"], x["e"]))
    return {label: sorted(parts) for label, parts in out.items()}


def _has_room(flags: np.ndarray, start: int, parts: list[tuple[int, int]], span: int, percent: int, shared: int) -> bool:
    """Whether a range that is dense in flags (of the tokens from start on) and overlaps each of the sorted parts by less than `shared` can have span tokens."""
    share, left = 2 * percent / (100 + percent), 0
    for s, e in [*parts, (start + len(flags) + shared, 0)]:
        piece = flags[left : max(0, s + shared - 1 - start)]
        if len(piece) >= span and piece.sum() >= _least_common(span, percent):
            x, y = longest_dense(piece, share)
            if y - x >= span:
                return True
        left = max(left, e - shared + 1 - start)
    return False


def may_be_new(a: np.ndarray, b: np.ndarray, starts: tuple[int, int], known: tuple[dict, dict], span: int, percent: int) -> bool:
    """Whether ranges a and b of two texts (from `starts` on) can have similar parts that do not both overlap passages of one label by `merge_of(span)`.

    known: of either text the sorted passages by label. A part that overlaps a passage by less reaches beyond it on one side, so it lies between two of them.
    """
    shared, flags = merge_of(span), {}
    for label in known[0].keys() & known[1].keys():
        flags = flags or {0: np.isin(a, b), 1: np.isin(b, a)}
        if not any(_has_room(flags[k], starts[k], known[k][label], span, percent, shared) for k in (0, 1)):
            return False
    return True


def is_known(part: tuple[int, int, int, int], known: tuple[dict, dict], shared: int) -> bool:
    """Whether both sides of part (s, e, p, q) overlap passages of one label by `shared` tokens or more."""
    def held(s: int, e: int, parts: list[tuple[int, int]]) -> bool:
        return any(min(e, y) - max(s, x) >= shared for x, y in parts)

    s, e, p, q = part
    return any(held(s, e, known[0][label]) and held(p, q, known[1][label]) for label in known[0].keys() & known[1].keys())


def merge_of(span: int) -> int:
    return MERGE * span // SPAN


def _verified(pairs: DataFrame, span: int, percent: int) -> DataFrame:
    """_PASSAGE rows of pairs (doc, th, lo, o_doc, o_th, o_lo, spots, ta, tb) with token slices ta and tb: all similar parts of the spots' ranges.

    With columns ha and hb, the passages (s, e, label) of either document there, parts whose two sides are in passages of one label are left out.
    """
    kinds = [pa.int64() if x.split()[1] == "long" else pa.int32() for x in _PASSAGE.split(", ")]
    names = [x.split()[0] for x in _PASSAGE.split(", ")]

    def parts(batch: pa.RecordBatch):
        spots = batch.column(6)
        row = np.repeat(np.arange(batch.num_rows), np.diff(spots.offsets.to_numpy()))
        spots = spots.flatten()
        lo, hi, o_lo, o_hi, diagonal = (pa.compute.struct_field(spots, n).to_numpy().astype(np.int64) for n in _RANGE)
        sides = []
        for k, first, last, begin in ((7, lo, hi, 2), (8, o_lo, o_hi, 5)):
            at = batch.column(k).offsets.to_numpy().astype(np.int64)
            start = at[row] + first - batch.column(begin).to_numpy()[row]
            sides.append((batch.column(k).values.to_numpy(), start, np.minimum(start + last - first + 1, at[row + 1])))
        ids = [batch.column(k).to_pylist() for k in (0, 1, 3, 4)]
        cuts = np.cumsum(sum(end - start for _, start, end in sides)) // TOKENS_AT_ONCE
        for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(cuts)) + 1):
            shared = shared_tokens(*[(values, start[some], end[some]) for values, start, end in sides])
            for i in some[shared >= _least_common(span, percent)].tolist():
                a, b = (values[start[i] : end[i]] for values, start, end in sides)
                x, y, r = int(lo[i]), int(o_lo[i]), row[i]
                known = tuple(_by_label(batch.column(k)[r].as_py()) for k in (9, 10)) if batch.num_columns > 9 else ({}, {})
                if not may_be_new(a, b, (x, y), known, span, percent):
                    continue
                for s, e, p, q, same in similar_parts(a, b, int(diagonal[i]) * DIAGONAL - x + y, span, percent):
                    part = x + s, x + e, y + p, y + q
                    if not is_known(part, known, merge_of(span)):
                        yield (ids[0][r], ids[1][r], *part[:2], ids[2][r], ids[3][r], *part[2:], same)

    def run(batches):
        for batch in batches:
            columns = list(zip(*parts(batch), strict=True)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns or [()] * len(kinds), kinds, strict=True)], names=names)

    return pairs.mapInArrow(run, _PASSAGE)


def _tokens(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, ths = (batch.column(k).to_numpy() for k in (0, 1))
            for rows, data in text_chunks(range(len(ids)), texts_of(batch.column(2))):
                at = np.array(rows, np.int64)
                lists = pa.array([t.view(np.int64) for t in token_rows(data, width)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ths[at]), lists], names=["doc", "th", "tokens"])

    return texts.mapInArrow(run, "doc long, th long, tokens array<long>")


def _alike(x: str, y: str, span: int) -> str:
    """Whether two windows of a group lie on each other over span tokens and have like sketches, as SQL."""
    overlap = f"least({x}.c - {x}.l, {y}.c - {y}.l) + least({x}.r - {x}.c, {y}.r - {y}.c) + 1 >= {span}"
    return f"({overlap} and {_agree(x, y)})"


def _apart(x: str, y: str) -> str:
    return f"({x}.doc <> {y}.doc or {x}.th <> {y}.th)"


def _sided(joined: DataFrame) -> DataFrame:
    """The ranges of joined windows (x, y), the later document first."""
    back = F.expr("struct(x.doc, x.th) < struct(y.doc, y.th)")
    p, q = F.when(back, F.col("y")).otherwise(F.col("x")), F.when(back, F.col("x")).otherwise(F.col("y"))
    before, after = "least(p.c - p.l, q.c - q.l)", "least(p.r - p.c, q.r - q.c)"
    return joined.select(p.alias("p"), q.alias("q")).selectExpr(
        *[f"{z}.{n} as {lead}{n}" for z, lead in (("p", ""), ("q", "o_")) for n in ("doc", "th")],
        *[x for z, lead in (("p", ""), ("q", "o_")) for x in (f"{z}.c - {before} as {lead}l", f"{z}.c + {after} as {lead}r")],
        f"int(floor((p.c - q.c) / {DIAGONAL})) as diagonal",
    )


_RANGE = ["lo", "hi", "o_lo", "o_hi", "diagonal"]


def _spots(ranges: DataFrame) -> DataFrame:
    """Ranges (doc, th, l, r, o_doc, o_th, o_l, o_r, diagonal) of each pair of documents and diagonal as one of either."""
    return ranges.groupBy(*_PAIR, "diagonal").agg(
        F.min("l").alias("lo"), F.max("r").alias("hi"), F.min("o_l").alias("o_lo"), F.max("o_r").alias("o_hi")
    )


def _connected(found: DataFrame) -> DataFrame:
    """(doc, th, s, e, label) of the united passages of each document in _PASSAGE rows; passages of one label are connected."""
    sides = found.select("doc", "th", "s", "e").union(found.select("o_doc", "o_th", "o_s", "o_e")).distinct()
    by = Window.partitionBy("doc", "th").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("s") > reach - MERGE, 1).otherwise(F.when(reach.isNull(), 1).otherwise(0))
    one = sides.withColumn("new", new).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    named = written(one.select("doc", "th", "s", "e", F.xxhash64("doc", "th", "part").alias("node")), "windows-passages")
    mine = named.withColumnRenamed("node", "a")
    theirs = named.select(F.col("doc").alias("o_doc"), F.col("th").alias("o_th"), F.col("s").alias("o_s"), F.col("e").alias("o_e"), F.col("node").alias("b"))
    pairs = found.join(mine, ["doc", "th", "s", "e"]).join(theirs, ["o_doc", "o_th", "o_s", "o_e"]).select("a", "b")
    comps = connected_components(written(pairs.distinct(), "windows-links"))
    united = named.groupBy("doc", "th", "node").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    labelled = united.join(comps, "node", "left").select("doc", "th", "s", "e", F.coalesce("component", "node").alias("label"))
    return written(labelled, "windows-labels")


def _by_pair(spots: DataFrame) -> DataFrame:
    """(doc, th, o_doc, o_th, lo, hi, o_lo, o_hi, spots) of every pair of documents."""
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("o_lo").alias("o_lo"), F.max("o_hi").alias("o_hi")]
    return spots.groupBy(*_PAIR).agg(*ends, F.collect_list(F.struct(*_RANGE)).alias("spots"))


def _similar(texts: DataFrame, pairs: DataFrame, width: int, span: int, percent: int, passages: DataFrame | None = None) -> DataFrame:
    """The distinct _PASSAGE rows of the pairs, whose documents are fetched again; a written table. Those whose two sides are in passages
    (doc, th, s, e, label) of one label are left out."""
    ids = written(pairs.select("doc", "th").union(pairs.select("o_doc", "o_th")).distinct(), "windows-ids")
    tokens = written(_tokens(texts.join(small_side(ids), ["doc", "th"], "left_semi").select("doc", "th", "text"), width), "windows-tokens")
    texts_of_pairs, held, o_held = tokens, [], []
    if passages is not None:
        own = passages.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e", "label")).alias("held"))
        texts_of_pairs = tokens.join(own, ["doc", "th"], "left")
        near = lambda lo, hi: F.filter("held", lambda h: (h["s"] <= F.col(hi)) & (h["e"] > F.col(lo)))
        held, o_held = [near("lo", "hi").alias("ha")], [near("o_lo", "o_hi").alias("hb")]
    cut = lambda lo, hi: F.slice("tokens", F.col(lo) + 1, F.col(hi) - F.col(lo) + 1)
    one = pairs.join(texts_of_pairs, ["doc", "th"]).select(*_PAIR, "lo", "o_lo", "o_hi", "spots", cut("lo", "hi").alias("ta"), *held)
    two = one.join(texts_of_pairs.withColumnsRenamed({"doc": "o_doc", "th": "o_th"}), ["o_doc", "o_th"])
    slices = two.select("doc", "th", "lo", "o_doc", "o_th", "o_lo", "spots", "ta", cut("o_lo", "o_hi").alias("tb"), *[F.col("ha")] * len(held), *o_held)
    # Slices of long texts are large: fewer of them at a time keep the tasks' memory small, whatever the texts.
    spark, rows = pairs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(PAIRS_PER_BATCH))
    try:
        found = written(_verified(slices, span, percent).distinct(), "windows-found")
    finally:
        spark.conf.set(rows, before)
    released(ids, tokens)
    return found


def near_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    percent: int = PERCENT,
    width: int = WIDTH,
    hashes: int = HASHES,
) -> DataFrame:
    """A row per passage and passage of another document that it is joined with: id, start_word, n_words, other_id,
    other_start_word, other_n_words, percent (similarity, rounded down), component. Passages that are similar are joined, if not directly, through
    others; those so connected have one component, as have equal texts (apart from the passages in them).
    """
    named = docs.where(F.col(f"`{id_col}`").isNotNull())
    key, text = RowKey(named, id_col), F.col(f"`{text_col}`")
    every = named.select(*key.columns(F.col(f"`{id_col}`"), text), text.alias("text")).where("text is not null")
    copies = written(equal_texts(every), "windows-copies")
    alike = small_side(copies)
    texts = key.once(every.join(alike, ["doc", "th"], "left_anti"))
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(_token_counts(texts, width)))
    live = written(_grouped(_windows(texts, ranks, width, span, hashes), span), "windows-live")
    spots = written(_spots(live.where("o_doc is not null")), "windows-spots")
    found = _similar(texts, _by_pair(spots), width, span, percent)
    passages = _connected(found)
    # Of each content its first and its last window, as a pair may not be of one document.
    own = F.struct("doc", "th", "c", "l", "r", "cls", "sketch")
    members = live.where("o_doc is null").groupBy("key", F.col("cls").alias("node")).agg(F.min(own).alias("x"), F.max(own).alias("last"))
    place = passages.select(F.col("doc").alias("p_doc"), F.col("th").alias("p_th"), F.col("s").alias("p_s"), F.col("e").alias("p_e"), "label")
    here = (F.col("x.doc") == F.col("p_doc")) & (F.col("x.th") == F.col("p_th")) & (F.col("x.c") >= F.col("p_s")) & (F.col("x.c") < F.col("p_e"))
    contents = (
        members.join(small_side(place), here, "left")
        .groupBy("key", "node", "x", "last")
        .agg(F.min("label").alias("label"))
        .withColumn("label", F.coalesce("label", "node"))
    )
    loose = contents.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    apart = written(contents.join(loose, "key", "left_semi"), "windows-apart")
    crossed = (
        apart.alias("p")
        .join(apart.alias("q"), F.col("p.key") == F.col("q.key"))
        .where(f"p.node < q.node and p.label <> q.label and {_alike('p.x', 'q.x', span)}")
        .where(f"{_apart('p.x', 'q.x')} or {_apart('p.last', 'q.x')} or {_apart('p.x', 'q.last')}")
        .selectExpr(
            f"if({_apart('p.x', 'q.x')} or not {_apart('p.last', 'q.x')}, p.x, p.last) as x",
            f"if({_apart('p.x', 'q.x')} or {_apart('p.last', 'q.x')}, q.x, q.last) as y",
        )
    )
    tried = spots.select(*_PAIR, "diagonal", *[F.col(x).alias(f"t_{x}") for x in _RANGE[:4]])
    fresh = (
        _spots(_sided(crossed))
        .join(tried, [*_PAIR, "diagonal"], "left")
        .where("not coalesce(t_lo <= lo and t_hi >= hi and t_o_lo <= o_lo and t_o_hi >= o_hi, false)")
        .select(*_PAIR, *_RANGE)
    )
    second = written(_by_pair(fresh), "windows-pairs")
    released(live, apart)
    if second.head(1):
        found = found.union(_similar(texts, second, width, span, percent, passages)).distinct()
    released(spots, second)
    exact = exact_passages(texts, ranks, found, width, span)
    ranks.destroy()
    found = found.union(exact)
    labels = _connected(found).select(*[F.col(c).alias(f"l_{c}") for c in ("doc", "th", "s", "e")], F.col("label").alias("component"))
    mine = (F.col("doc") == F.col("l_doc")) & (F.col("th") == F.col("l_th")) & (F.col("s") >= F.col("l_s")) & (F.col("e") <= F.col("l_e"))
    found = found.join(labels, mine).drop("l_doc", "l_th", "l_s", "l_e")
    words = lambda s, e: (F.col(e) - F.col(s) + width - 1).cast("long")
    result = found.select(
        F.col("doc").alias(id_col),
        F.col("s").cast("long").alias("start_word"),
        words("s", "e").alias("n_words"),
        F.col("o_doc").alias("other_id"),
        F.col("o_s").cast("long").alias("other_start_word"),
        words("o_s", "o_e").alias("other_n_words"),
        "percent",
        "component",
    )
    size, none = F.size(space_words(F.col("text"))).cast("long"), F.lit(0).cast("long")
    whole = key.once(every.join(alike, ["doc", "th"])).select("doc", "o_doc", "o_th", size.alias("n")).where(F.col("n") >= span + width - 1)
    return result.union(whole.select("doc", none, "n", "o_doc", none, "n", F.lit(100), F.xxhash64("o_doc", "o_th", F.lit("text"))))
