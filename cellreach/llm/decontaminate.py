"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of 10 consecutive words (a shorter item is one window). A window's set is that of its shingles of
SHINGLE words, or itself if it is shorter. Shingles are ordered by rarity: how often their hash bucket occurs in all documents. To contain a window a
document must have all of its shingles, so the rarest alone is the necessary prefix. The documents' shingles are joined
with these prefixes; a hit fixes where the window must start (positional bound) and whether it fits in (length
bound), and then the words of that place are compared exactly with the window.

Scale: two passes over the texts, each a map, whatever the size of the benchmark: one counts buckets, one looks shingles up in a bitmap of the prefixes
(BITMAP_BITS, fixed) and emits those that may be one, with the words around them. Only these are joined with the table of windows, which is
broadcast if its items have at most `block_bytes` of text, else by a shuffle. Documents are not shuffled but to drop
those that are hit, if there are too many of these to broadcast their ids. The driver holds the bitmap and the fixed-size counts.

Defined results: a null text has no words and is clean; an item without words has no windows; an item
with a null id marks documents but is not listed; equal items are each listed; rows equal in id and text are each
judged alike, rows of one id and different texts on their own; an empty benchmark leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.llm.common import RowKey, released, row_struct, small_side, unpack, written
from cellreach.llm.shingles import BUCKETS, COUNT_DDL, add_up, buckets, count_columns, mix, rolled_hashes, text_chunks, texts_of, word_runs

WINDOW, SHINGLE = 10, 5
#: Bytes of benchmark text up to which the windows are broadcast.
BLOCK_BYTES = 1 << 23
#: Bits of the bitmap of prefixes, as bits of a hash.
BITMAP_BITS = 24

#: Bytes of words as they are, A-Z lower-cased, all other bytes as spaces.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_GAP = np.frombuffer(_FOLD, np.uint8) == 0x20

_SCAN = "doc long, th long, id long, n_words long, h long, pos int, begin int, around array<binary>"


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and all non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


def _keys(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, told apart from those of other widths."""
    return mix(rolled_hashes(words, width) + np.uint64(width))


def _widths(benchmark: DataFrame) -> list[int]:
    """The numbers of words that shingles of the benchmark (i, t) have: SHINGLE of them, and fewer for shorter items."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([min(len(words_of(t)), SHINGLE) for t in batch.column(0).to_pylist()], pa.int32())], names=["k"]
            )

    found = benchmark.select("t").mapInArrow(run, "k int").where("k > 0").distinct()
    return sorted(r["k"] for r in found.collect())  # SHINGLE numbers at most


def _shingle_counts(texts: DataFrame, widths: list[int]) -> np.ndarray:
    """How often shingles of these widths occur in all texts, by bucket."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data in text_chunks(range(batch.num_rows), texts_of(batch.column(0))):
                words, _, _, first = word_runs(data, _GAP)
                ends = np.repeat(first[1:], np.diff(first))
                for k in widths:
                    inside = np.arange(len(words) - k + 1) + k <= ends[: max(0, len(words) - k + 1)]
                    counts += np.bincount(buckets(_keys(words, k)[inside]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(list(count_columns(counts)), names=["part", "counts"])

    return add_up(texts.select("text").mapInArrow(run, COUNT_DDL))


def _windows(benchmark: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """(h, at, n, words, item) of every window of the benchmark (i, t): its prefix shingle, where that begins, and its words."""
    held = benchmark.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = [(text or "").encode()]
                hashes = word_runs(data, _GAP)[0]
                if not len(hashes):
                    continue
                words = words_of(text)
                k = min(len(words), SHINGLE)
                keys = _keys(hashes, k)
                rank = held.value[buckets(keys)]
                for s in range(max(1, len(words) - width + 1)):
                    n = min(width, len(words))
                    span = range(s, s + n - k + 1)
                    best = min(span, key=lambda p: (int(rank[p]), int(keys[p])))
                    rows.append((int(keys[best].view(np.int64)), best - s, n, words[s : s + n], item))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["h", "at", "n", "words", "item"]
            )

    return benchmark.mapInArrow(run, "h long, at int, n int, words array<binary>, item long").distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Which upper BITMAP_BITS of hashes any prefix has, as bits; its size is fixed."""
    place = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    found = windows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - BITMAP_BITS}) & 63L))")).alias("bits"))
    table = found.toArrow()
    out = np.zeros((1 << BITMAP_BITS) // 64, np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _scan(rows: DataFrame, bitmap: np.ndarray, widths: list[int], width: int) -> DataFrame:
    """Of rows (doc, th, id, text): one of _SCAN for each (h null), and one for each place of a shingle that the bitmap has."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = held.value
        for batch in batches:
            docs, ths = (batch.column(k).to_numpy() for k in (0, 1))
            ids = batch.column(2).to_pylist()
            for at, data in text_chunks(range(len(docs)), texts_of(batch.column(3))):
                words, start, end, first = word_runs(data, _GAP)
                folded = (b"\n".join(data) + b"\n").translate(_FOLD)
                sizes = np.diff(first)
                out = [(int(docs[r]), int(ths[r]), ids[r], int(n), None, None, None, None) for r, n in zip(at, sizes.tolist(), strict=True)]
                ends = np.repeat(first[1:], sizes)
                for k in widths:
                    keys = _keys(words, k)
                    place = keys >> np.uint64(64 - BITMAP_BITS)
                    maybe = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
                    hits = np.flatnonzero((maybe > 0) & (np.arange(len(keys)) + k <= ends[: len(keys)]))
                    text = np.searchsorted(first, hits, "right") - 1
                    for p, t in zip(hits.tolist(), text.tolist(), strict=True):
                        a, b = max(int(first[t]), p - width + 1), min(int(first[t + 1]), p + width)
                        r, begin = at[t], int(first[t])
                        around = folded[start[a] : end[b - 1]].split()
                        out.append((int(docs[r]), int(ths[r]), None, None, int(keys[p].view(np.int64)), p - begin, a - begin, around))
                kinds = {"long": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary())}
                fields = [x.split() for x in _SCAN.split(", ")]
                columns = zip(*out, strict=True) if out else [()] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields]
                )

    return rows.mapInArrow(run, _SCAN)


def _hits(scan: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(doc, th, n_hit, items) of the documents that hold a window: how many of their words lie in one, and the items."""
    own = windows.select(F.col("h").alias("w_h"), "at", "n", "words", "item")
    both = scan.where("h is not null").join(F.broadcast(own) if small else own, F.col("h") == F.col("w_h"))
    begins = F.col("pos") - F.col("at")
    inside = F.slice("around", F.greatest(begins - F.col("begin") + 1, F.lit(1)), F.col("n"))
    exact = both.where((begins >= F.col("begin")) & (inside == F.col("words")))
    runs = exact.select("doc", "th", F.struct(begins.alias("s"), (begins + F.col("n")).alias("e")).alias("run"), "item")
    by = runs.groupBy("doc", "th").agg(F.sort_array(F.collect_set("run")).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "runs",
        start,
        lambda a, r: F.struct(
            F.greatest(a["to"], r["e"]).alias("to"),
            (a["n"] + F.greatest(r["e"] - F.greatest(a["to"], r["s"]), F.lit(0))).alias("n"),
        ),
    )
    return by.select("doc", "th", covered["n"].alias("n_hit"), "items")


def _judged(
    docs: DataFrame, key: RowKey, benchmark: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text_col: str, width: int, block_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """(doc, th, id, n_words) of every row, and _hits; both from written tables."""
    text = F.col(f"`{text_col}`")
    own = F.col(f"`{id_col}`")
    rows = docs.select(*key.columns(own, text), own.cast("long").alias("id"), text.alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    widths = _widths(items)
    counts = _shingle_counts(rows, widths) if widths else np.zeros(BUCKETS, np.int64)
    windows = written(_windows(items, counts, width), "decontaminate-windows")
    scan = written(_scan(rows, _bitmap(windows), widths, width), "decontaminate-scan")
    hits = written(_hits(scan, windows, size <= block_bytes), "decontaminate-hits")
    released(windows)
    return scan.where("h is null").select("doc", "th", "id", "n_words"), hits


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row: how many of its words lie in a window of an item, and the items."""
    rows, hits = _judged(docs, RowKey(docs, id_col), benchmark, id_col, text_col, item_col, item_text_col, width, block_bytes)
    return rows.join(small_side(hits), ["doc", "th"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
) -> DataFrame:
    """The rows of docs that hold no window of any item; same columns."""
    key = RowKey(docs, id_col)
    _, hits = _judged(docs, key, benchmark, id_col, text_col, item_col, item_text_col, width, block_bytes)
    packed = docs.select(row_struct(docs).alias("row"))
    keyed = packed.select("row", *key.columns(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    return unpack(keyed.join(small_side(hits.select("doc", "th")), ["doc", "th"], "left_anti"), "row", docs.columns)


def digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: the item list as a count and the SHA-256 of its sorted, comma-joined strings."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
