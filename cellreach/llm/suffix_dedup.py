"""Exact removal of repeated byte strings by suffix arrays.

A byte is removed if a string of `length` bytes that covers it also starts earlier (in an earlier document, or earlier in
the same one). Equal texts are found first: all but the first of them go as a whole. Of the others, only places that may repeat are suffix-sorted:

1. Every window of `length` bytes has anchors, the positions of its least 40-byte hash, so equal windows have equal
   anchors at equal places. Anchors (some 3 % of all positions) are dealt out by hash; those whose hash occurs once are dropped.
2. An anchor's label is the place (document and 8 KB region of it) where its hash occurs first. The bytes that windows through a document's anchors of one
   label can reach are cut out, overlapping ones as one stretch. Equal windows have an anchor in common, so they lie in stretches of one
   label. Of equal stretches of a label all but the first go as a whole, and the first stands for them.
3. Stretches are dealt by label into shards of bounded size; each shard gets a suffix array by Larsson-Sadakane refinement
   (doubling, sorted groups left alone) and common prefixes by Kasai's bound; suffixes with a common prefix of `length`
   bytes or more are one string, and all of them but the one that starts first are repeats.
4. A label with more bytes than a shard holds is dealt to several shards, each in a task that may be another's. Each gives the digests of its distinct
   strings in as many blocks as there are shards; the blocks of one digest range are merged in one task by binary
   search, and all but the first start of a string are repeats.

Scale: the anchor shuffle is about half a byte per byte of text; texts are read four times, and shuffled only for documents
with repeated anchors. Hashes only choose candidates; which windows are equal is decided on bytes within shards, and on 128-bit digests for
whole texts, stretches (64 bits, beside the label's 64), and across the shards of one label.

Defined results: null and empty texts lose nothing, nor do texts shorter than `length`. Documents are rows: their order is by id, null
ids last, then by a hash of the text where an id repeats; rows equal in id and text are one document and lose the same bytes.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.llm.common import RowKey, equal_texts, is_small, released, small_side, written
from cellreach.llm.shingles import mix, powers, text_chunks, texts_of

LENGTH, ANCHOR = 100, 40
SHARD_BYTES = 1 << 21
#: Bytes of a document, as bits, whose anchors have one label.
REGION_BITS = 13
#: An anchor that occurs more often in one batch of documents is dealt, but for the first time, to one of so many parts.
CROWD, SALTS = 64, 1023


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i : i + width], for every i that has so many."""
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def anchors_of(data: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts: number of the text, position in it, and hash."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(b) for b in data])
    first = np.cumsum(sizes) - sizes
    nothing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(raw) < length:
        return nothing
    up, down = powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up)))
    n = len(raw) - anchor + 1
    hashes = mix((total[anchor:] - total[:-anchor]) * down[:n])
    short = (hashes >> np.uint64(33)).astype(np.int32)
    width = length - anchor + 1
    least = _sliding(short, width, np.minimum)
    valid = np.zeros(len(least), bool)  # windows within one text
    for a, size in zip(first, sizes, strict=True):
        if size >= length:
            valid[a : a + size - length + 1] = True
    edge = np.full(width - 1, -1, np.int32)
    most = _sliding(np.concatenate((edge, np.where(valid, least, -1), edge)), width, np.maximum)
    at = np.flatnonzero(most == short)
    text = np.searchsorted(first, at, "right") - 1
    return text, at - first[text], hashes[at]


def _anchor_rows(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, salt, doc, th, pos, known) of (doc, th, text): known if the anchor crowds its batch; then the further ones are salted."""

    def run(batches):
        for batch in batches:
            docs, ths = (batch.column(k).to_numpy() for k in (0, 1))
            found = []
            for rows, data in text_chunks(range(len(docs)), texts_of(batch.column(2))):
                text, pos, hashes = anchors_of(data, length, anchor)
                found.append((np.array(rows, np.int64)[text], pos, hashes))
            if not found:
                continue
            row, pos, hashes = (np.concatenate([f[k] for f in found]) for k in range(3))
            _, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            crowd = count[inverse] > CROWD
            repeat = crowd.copy()
            repeat[first] = False
            spread = (mix(np.arange(len(hashes), dtype=np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.view(np.int64)),
                    pa.array(np.where(repeat, spread, 0).astype(np.int32)),
                    pa.array(docs[row]),
                    pa.array(ths[row]),
                    pa.array(pos.astype(np.int32)),
                    pa.array(crowd),
                ],
                names=["h", "salt", "doc", "th", "pos", "known"],
            )

    return texts.mapInArrow(run, "h long, salt int, doc long, th long, pos int, known boolean")


def _labelled(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(doc, th, pos, label) of every anchor whose hash occurs more than once."""
    group = Window.partitionBy("h", "salt")
    live = written(
        _anchor_rows(texts, length, anchor)
        .withColumn("times", F.count(F.lit(1)).over(group))
        .withColumn("any", F.max("known").over(group))
        .withColumn("first", F.min(F.struct("doc", "th", "pos")).over(group))
        .where("salt > 0 or times > 1 or any")
        .select(
            F.when(F.col("any"), F.col("h")).alias("h"),
            "salt",
            "doc",
            "th",
            "pos",
            F.xxhash64("first.doc", "first.th", F.shiftright("first.pos", REGION_BITS)).alias("label"),
        ),
        "suffix-live",
    )
    own = live.where("salt = 0")
    heads = own.where("h is not null").select("h", "label").distinct()
    spread = live.where("salt > 0").drop("label").join(heads, "h")
    return own.select("doc", "th", "pos", "label").union(spread.select("doc", "th", "pos", "label"))


_STRETCH = "label long, cls long, doc long, th long, begin int, size int, content binary"


def _stretches(placed: DataFrame, length: int, anchor: int) -> DataFrame:
    """_STRETCH rows of (doc, th, text, places); of equal stretches of a label in a batch only the first has the bytes."""
    reach = length - anchor

    def run(batches):
        for batch in batches:
            docs, ths = (batch.column(k).to_pylist() for k in (0, 1))
            at = batch.column(3).offsets.to_numpy()
            every_pos, every_label = (batch.column(3).values.field(k).to_numpy() for k in (0, 1))
            seen: set = set()
            rows: list[tuple] = []
            for k, text in enumerate(texts_of(batch.column(2))):
                data = text.encode()
                pos, label = every_pos[at[k] : at[k + 1]], every_label[at[k] : at[k + 1]]
                order = np.lexsort((pos, label))
                pos, label = pos[order].astype(np.int64), label[order]
                begin, end = np.maximum(pos - reach, 0), np.minimum(pos + length, len(data))
                cut = np.flatnonzero((label[1:] != label[:-1]) | (begin[1:] > end[:-1])) + 1
                starts = begin[np.concatenate(([0], cut))].tolist()
                ends = end[np.concatenate((cut - 1, [len(end) - 1]))].tolist()
                for s, e, own in zip(starts, ends, label[np.concatenate(([0], cut))].tolist(), strict=True):
                    if e - s < length:
                        continue
                    content = data[s:e]
                    cls = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
                    new = (own, cls) not in seen
                    seen.add((own, cls))
                    rows.append((own, cls, docs[k], ths[k], s, e - s, content if new else None))
                if len(rows) > 5000:
                    yield _batch(rows, _STRETCH)
                    rows = []
            if rows:
                yield _batch(rows, _STRETCH)

    return placed.mapInArrow(run, _STRETCH)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def _words8(raw: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number, zeros beyond the end; eight more places at the end."""
    n = len(raw) + 8
    padded = np.concatenate((raw.astype(np.uint64), np.zeros(16, np.uint64)))
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    return word


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of raw in the order of their first `depth` bytes or more, by Larsson-Sadakane refinement.

    The first eight bytes are sorted at once; then each round doubles the sorted depth by sorting, within groups that are still equal,
    by the group of the suffix that far ahead. Groups of one are left alone.
    """
    n = len(raw)
    word = _words8(raw)[:n]
    sa = np.argsort(word).astype(np.int32)
    ordered = word[sa]
    begins = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.empty(n + 1, np.int32)  # of a suffix: the place in sa where its group begins
    group[n] = -1
    group[sa] = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    h = 8
    while h < depth:
        alone = begins & np.append(begins[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        some = sa[open_at]
        own, ahead = group[some], group[np.minimum(some + h, n)]
        both = own.astype(np.int64) * (n + 1) + ahead + 1
        order = np.argsort(both)
        some, both = some[order], both[order]
        sa[open_at] = some
        begins[open_at] = np.concatenate(([True], both[1:] != both[:-1]))
        starts = np.where(begins[open_at], open_at, 0)
        group[some] = np.maximum.accumulate(starts)
        h *= 2
    return sa


def common_prefixes(raw: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each place in sa, the length (up to cap) of the common prefix with the suffix before it.

    Kasai's bound: if a suffix of the text shares m bytes with the one before it in order, the text's next suffix shares m - 1 or
    more with its own. Every eighth suffix is compared from its start, the others from the bound that gives.
    """
    n = len(raw)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    word = _words8(raw)
    lcp = np.zeros(n, np.int32)

    def extend(which: np.ndarray) -> None:
        """By eight bytes while they are equal, then by the equal leading bytes of the words that differ."""
        which = which[before[which] >= 0]
        while len(which):
            a, b = which + lcp[which], before[which] + lcp[which]
            differ = word[a] ^ word[b]
            same = (differ == 0) & (np.maximum(a, b) + 8 <= n) & (lcp[which] + 8 <= cap)
            stop, bits = which[~same], differ[~same]
            equal = sum((bits >> np.uint64(8 * (7 - k)) == 0).astype(np.int64) for k in range(8))
            lcp[stop] = np.minimum(lcp[stop] + equal, np.minimum(cap, n - np.maximum(stop, before[stop])))
            which = which[same]
            lcp[which] += 8

    heads = np.arange(0, n, 8)
    extend(heads)
    rest = np.flatnonzero(np.arange(n) % 8)
    head = rest - rest % 8
    # sa is sorted to a finite depth: at the cap the bound holds only for the neighbour that moved on with the head's.
    sure = (lcp[head] < cap) | (before[rest] == before[head] + rest % 8)
    lcp[rest] = np.where(sure, np.maximum(lcp[head] - rest % 8, 0), 0)
    lcp[before < 0] = 0
    extend(rest)
    return lcp[sa]


_RANGE = "doc long, th long, s int, e int, label long, block int, digests binary, places binary"
#: A place of a distinct string, as it goes from a shard to the merge.
_PLACE = np.dtype([("doc", "<i8"), ("th", "<i8"), ("s", "<i4")])


def _shard_repeats(rows: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """Of stretches (label, parts, doc, th, begin, content): ranges (doc, th, s, e) of the bytes that an earlier place of the shard has, too,
    and, for labels in several shards (parts), blocks (label, block, digests, places) of their distinct strings with the first place of each."""
    rows = sorted(rows, key=lambda r: r[2:5])
    raw = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    sizes = np.array([len(r[5]) for r in rows])
    first = np.cumsum(sizes) - sizes
    begin = np.array([r[4] for r in rows])
    document = np.cumsum([k == 0 or rows[k][2:4] != rows[k - 1][2:4] for k in range(len(rows))])
    # (document, place in it) of every byte as one number: stretches of a document may overlap
    place = np.repeat((document << 32) + begin - first, sizes) + np.arange(len(raw))
    inside = np.repeat(first + sizes - length, sizes) >= np.arange(len(raw))
    sa = suffix_array(raw, length)
    lcp = common_prefixes(raw, sa, length)
    number = np.cumsum(lcp < length, dtype=np.int32)  # a shorter prefix anywhere between two suffixes parts them
    valid = inside[sa]
    sa, number = sa[valid], number[valid]
    heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    times = np.diff(np.append(heads, len(sa)))
    least = np.repeat(np.minimum.reduceat(place[sa], heads), times)
    late = np.zeros(len(raw) + 2, np.int8)  # one place further on
    late[sa + 1] = place[sa] > least
    edges = np.flatnonzero(np.diff(late))
    starts, ends = edges[::2], edges[1::2]  # the last bytes of a stretch start no window, so runs end within theirs
    owner = np.searchsorted(first, starts, "right") - 1
    at = begin[owner] + starts - first[owner]
    ranges = [(*rows[o][2:4], s, s + n - 1 + length) for o, s, n in zip(owner.tolist(), at.tolist(), (ends - starts).tolist(), strict=True)]

    blocks = []
    group = np.repeat(np.arange(len(heads)), times)
    firsts = sa[(late[sa + 1] == 0)]  # of a string that starts twice at its first place (overlapping stretches) either will do
    first_of = np.empty(len(heads), np.int64)
    first_of[group[late[sa + 1] == 0]] = firsts
    data = raw.tobytes()
    for label, parts in {(r[0], r[1]) for r in rows if r[1]}:
        mine = np.repeat(np.array([r[0] == label for r in rows]), sizes)
        spots = first_of[np.unique(group[mine[sa]])]
        digests = [hashlib.blake2b(data[p : p + length], digest_size=16).digest() for p in spots.tolist()]
        own = np.searchsorted(first, spots, "right") - 1
        places = np.empty(len(spots), _PLACE)
        places["doc"], places["th"] = (np.array([r[k] for r in rows], np.int64)[own] for k in (2, 3))
        places["s"] = begin[own] + spots - first[own]
        keys = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        dealt = keys[:, 0] % np.uint64(parts)
        blocks += [(label, k, keys[dealt == k].tobytes(), places[dealt == k].tobytes()) for k in range(parts)]
    return ranges, blocks


def _sharded(stretches: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """_RANGE rows of stretches (label, salt, parts, doc, th, begin, content) that come label by label."""

    def emitted(rows):
        ranges, blocks = _shard_repeats(rows, length)
        out = [(*r, None, None, None, None) for r in ranges] + [(None, None, None, None, *b) for b in blocks]
        for k in range(0, len(out), 50_000):
            yield _batch(out[k : k + 50_000], _RANGE)

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for label, salt, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= shard_bytes and (label, salt) != last:
                    yield from emitted(held)
                    held, size = [], 0
                held.append((label, *row))
                size += len(row[-1])
                last = label, salt
        if held:
            yield from emitted(held)

    return stretches.mapInArrow(run, _RANGE)


def _merged(blocks: DataFrame, length: int) -> DataFrame:
    """(doc, th, s, e) of the strings in blocks (label, block, digests, places) that start earlier in another shard of the label."""
    ddl = "doc long, th long, s int, e int"

    def ranges(keys: bytes, places: bytes):
        key = np.frombuffer(keys, "<u8").reshape(-1, 2)
        at = np.frombuffer(places, _PLACE)
        order = np.lexsort((at["s"], at["th"], at["doc"], key[:, 1], key[:, 0]))
        key, at = key[order], at[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]).any(1)))
        head = np.flatnonzero(new)
        source = head[np.searchsorted(head, np.arange(len(key)), "right") - 1]
        late = np.sort(at[at != at[source]])
        if not len(late):
            return
        go = np.concatenate(([True], (late["doc"][1:] != late["doc"][:-1]) | (late["th"][1:] != late["th"][:-1]) | (late["s"][1:] > late["s"][:-1] + 1)))
        begins = np.flatnonzero(go)
        ends = np.append(begins[1:], len(late)) - 1
        b, e = late[begins], late[ends]
        yield pa.RecordBatch.from_arrays(
            [pa.array(b["doc"]), pa.array(b["th"]), pa.array(b["s"]), pa.array((e["s"] + length).astype(np.int32))], names=["doc", "th", "s", "e"]
        )

    def run(batches):
        last, held = None, ([], [])
        for batch in batches:
            for label, block, digests, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last not in (None, (label, block)):
                    yield from ranges(*map(b"".join, held))
                    held = [], []
                last = label, block
                held[0].append(digests)
                held[1].append(places)
        if last:
            yield from ranges(*map(b"".join, held))

    return blocks.repartition("label", "block").sortWithinPartitions("label", "block").mapInArrow(run, ddl)


def repeated_ranges(
    docs: DataFrame,
    key: RowKey,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc, th, ranges): the byte ranges, array<struct<s, e>>, that each document with repeats loses; they may overlap."""
    text = F.col(f"`{text_col}`")
    every = docs.select(*key.columns(F.col(f"`{id_col}`"), text), F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    copies = written(equal_texts(every).select("doc", "th", F.lit(0).alias("s"), F.col("size").alias("e")), "suffix-copies")
    texts = key.once(every.join(small_side(copies.select("doc", "th")), ["doc", "th"], "left_anti"))

    labelled = _labelled(texts, length, anchor)
    places = written(labelled.groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "label")).alias("places")), "suffix-places")
    placed = texts.join(places, ["doc", "th"]).select("doc", "th", "text", "places")
    seen = written(_stretches(placed, length, anchor), "suffix-stretches")
    released(places)
    classes = written(
        seen.groupBy("label", "cls").agg(
            F.min(F.struct("doc", "th", "begin")).alias("p"), F.count(F.lit(1)).alias("times"), F.max("content").alias("content")
        ),
        "suffix-classes",
    )
    size = F.octet_length("content").cast("long")
    large = written(
        classes.groupBy("label").agg(F.sum(size).alias("size")).where(F.col("size") > shard_bytes).select("label", F.ceil(F.col("size") / shard_bytes).alias("parts")),
        "suffix-large",
    )
    dealt = (
        classes.join(small_side(large), "label", "left")
        .select(
            "label",
            F.coalesce(F.pmod(F.xxhash64("cls"), "parts").cast("int"), F.lit(0)).alias("salt"),
            F.coalesce(F.col("parts").cast("int"), F.lit(0)).alias("parts"),
            "p.*",
            "content",
        )
        .repartition("label", "salt")
        .sortWithinPartitions("label", "salt")
    )
    found = written(_sharded(dealt, length, shard_bytes), "suffix-found")
    names = ["doc", "th", "s", "e"]
    across = _merged(found.where("label is not null").select("label", "block", "digests", "places"), length)
    again = (
        seen.select("label", "cls", "doc", "th", "begin", "size")
        .join(classes.where("times > 1").select("label", "cls", "p"), ["label", "cls"])
        .where(F.struct("doc", "th", "begin") != F.col("p"))
        .select("doc", "th", F.col("begin").alias("s"), (F.col("begin") + F.col("size")).alias("e"))
    )
    every_range = found.where("label is null").select(names).union(across).union(again).union(copies)
    ranges = written(every_range.groupBy("doc", "th").agg(F.collect_set(F.struct("s", "e")).alias("ranges")), "suffix-ranges")
    released(copies, seen, classes, large, found)
    return ranges


def _kept(rows: DataFrame) -> DataFrame:
    """(id, text, ranges) rows with the ranges united and taken out: (id, n_bytes, n_removed, spans, kept)."""
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    schema = pa.schema(
        [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())]
    )

    def run(batches):
        for batch in batches:
            out = []
            for key, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                spans: list[list[int]] = []
                for s, e in sorted((r["s"], r["e"]) for r in ranges):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                edges = [0, *(x for span in spans for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                named = [{"s": s, "e": e} for s, e in spans]
                out.append({"id": key, "n_bytes": len(data), "n_removed": len(data) - len(kept), "spans": named, "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, _KEPT)


_KEPT = "id long, n_bytes long, n_removed long, spans array<struct<s: int, e: int>>, kept binary"


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of every row: the byte ranges taken out, and the bytes that stay."""
    key = RowKey(docs, id_col)
    ranges = repeated_ranges(docs, key, id_col, text_col, length, anchor, shard_bytes)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(own.cast("long").alias("id"), *key.columns(own, text), F.coalesce(text, F.lit("")).alias("text"))
    ids = ranges.select("doc", "th")
    size = F.octet_length("text").cast("long")
    nothing = F.array().cast("array<struct<s: int, e: int>>")
    untouched = [F.col("id"), size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), nothing.alias("spans"), F.encode("text", "UTF-8").alias("kept")]
    if is_small(ids):  # only texts that lose something are shuffled
        cut = rows.join(F.broadcast(ids), ["doc", "th"], "left_semi").join(ranges, ["doc", "th"])
        whole = rows.join(F.broadcast(ids), ["doc", "th"], "left_anti")
    else:
        cut = rows.join(ranges, ["doc", "th"])
        whole = rows.join(ids, ["doc", "th"], "left_anti")
    return _kept(cut.select("id", "text", "ranges")).union(whole.select(*untouched)).withColumnRenamed("id", id_col)
